import math
import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import vectors as V
from tidewright.operators import chunking, scoring


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_ngrams(spark):
    assert one(spark, "Été, x_1 日本 don't", T.search_tokens) == ["été", "x_1", "日本", "don", "t"]
    assert one(spark, None, T.search_tokens) == []
    assert one(spark, "A b  C", T.eval_tokens) == ["a", "b", "c"]
    assert one(spark, "a b c", lambda c: T.ngrams(T.eval_tokens(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(T.eval_tokens(c), 2)) == []
    assert one(spark, "你 好A", T.char_tokens) == ["你", "好", "A"]
    assert one(spark, "  Hello,   World! ", T.exact_form) == "hello world"
    assert one(spark, "a b\nc", T.text_length).asDict() == {"chars": 5, "words": 3, "lines": 2}


def test_hash_embeddings_are_unit_counts(spark):
    v = one(spark, "the cat the", lambda c: V.word_embedding(c))
    want = [0.0] * 128
    for w in ("the", "cat", "the"):
        want[int(md5(w.encode()).hexdigest(), 16) % 128] += 1
    n = math.sqrt(sum(x * x for x in want))
    assert v == pytest.approx([x / n for x in want])
    assert sum(one(spark, "ab", lambda c: V.trigram_embedding(c))) == 0
    t = one(spark, "abcabc", lambda c: V.trigram_embedding(c, 256))
    assert sum(x * x for x in t) == pytest.approx(1)


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert [list(r[0]) for r in df.select(V.unit(F.col("a"))).collect()] == [[0.0, 0.0], [1.0, 0.0]]


PAIRS = [
    ("the cat sat on the mat", "the cat sat on the mat", {"bleu": 1.0, "exact_match": 1.0, "f1": 1.0}),
    ("completely different text here", "the cat sat on the mat", {"bleu": 0.0, "rouge1": 0.0}),
    ("hello world", "hello world", {"rouge1": 1.0, "bleu": 1.0}),
    ("the cat is on the mat", "there is a cat on the mat", {"rouge_l": 0.615385}),
    ("hello world today", "hello world", {"rouge2": 0.666667, "f1": 0.8}),
    ("The weather is beautiful today", "It is a lovely day outside", {"semantic": 0.158114}),
    ("Python programming language", "Chocolate cake recipe", {"semantic": 0.0}),
    ("The cat sat on the mat", "A cat was sitting on the mat", {"rouge1": 0.666667, "f1": 0.666667}),
    ("the the", "the the", {"rouge1": 2.0}),
    ("", "", {"bleu": 0.0, "exact_match": 1.0, "f1": 0.0}),
]


def test_golden_scores(spark):
    rows = [(i, c, r) for i, (c, r, _) in enumerate(PAIRS)]
    out = {r["pair_id"]: r for r in scoring.score(spark.createDataFrame(rows, "pair_id int, candidate string, reference string")).collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        for metric, value in want.items():
            assert out[i][metric] == pytest.approx(value, abs=1e-6), (PAIRS[i], metric)
    with pytest.raises(ValueError):
        scoring.score(spark.createDataFrame(rows, "pair_id int, candidate string, reference string"), ("custom",))


def test_lcs_and_overlap_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 15)))) for i in range(60)]
    out = {r["pair_id"]: r for r in scoring.score(spark.createDataFrame(rows, "pair_id int, candidate string, reference string"), ("rouge_l", "rouge2")).collect()}
    for i, c, r in rows:
        c, r = c.split(), r.split()
        t = [[0] * (len(r) + 1) for _ in range(len(c) + 1)]
        for x in range(len(c)):
            for y in range(len(r)):
                t[x + 1][y + 1] = t[x][y] + 1 if c[x] == r[y] else max(t[x][y + 1], t[x + 1][y])
        p, q = (t[-1][-1] / len(c) if c else 0), t[-1][-1] / len(r)
        assert out[i]["rouge_l"] == pytest.approx(2 * p * q / (p + q) if p + q else 0)
        a, b = Counter(zip(c, c[1:])), Counter(zip(r, r[1:]))
        hit = sum((a & b).values())
        p, q = hit / max(1, len(a)), hit / max(1, len(b))
        assert out[i]["rouge2"] == pytest.approx(2 * p * q / (p + q) if p + q else 0)


def test_score_aggregate(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "d e f", "d e x"), (3, "g h i", "g h i")], "pair_id int, candidate string, reference string")
    r = scoring.aggregate(scoring.score(df, ("f1",)), ("f1",)).first()
    assert r["mean"] == pytest.approx(0.888889, abs=1e-6) and r["std"] == pytest.approx(0.192450, abs=1e-6) and r["n"] == 3


def test_sliding_window_starts(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, ""), (3, None), (4, "a b")], "i int, t string")
    rows = chunking.sliding_window(df, "i", "t", 5, 2).orderBy("id", "chunk_index").collect()
    assert [(r["start_word"], r["end_word"]) for r in rows if r["id"] == 1] == [(0, 5), (3, 8), (6, 10)]
    assert {r["id"] for r in rows} == {1, 4}


def test_chunkers_keep_the_text_and_end():
    text = "Hello world. " * 200
    for chunks in (chunking.fixed_size(text, 200, 50), chunking.by_sentence(text, 200), chunking.recursive(text, 200, 50)):
        # separators between parts do not count towards the size
        assert len(chunks) > 5 and all(len(c[0]) <= 240 and c[0] in text for c in chunks)
    assert chunking.fixed_size("A " * 500, 100, 20)[-1][2] == 1000
    with pytest.raises(ValueError):
        chunking.fixed_size(text, 100, 50)
    paragraphs = chunking.by_paragraph("one para.\n\ntwo para.\n\n" + "long sentence here. " * 50, 200)
    assert paragraphs[0][0] == "one para.\n\ntwo para." and len(paragraphs) > 4
    assert chunking.split_sentences("A. B. A sentence that is long enough. C.") == ["A. B.", "A sentence that is long enough.", "C."]
    sections = chunking.markdown("intro\n# One\nbody one\n## Two\nbody two", 100)
    assert [s[3] for s in sections] == ["", "# One", "## Two"] and sections[1][0] == "# One\nbody one"
    assert chunking.recursive("x" * 250, 100, 20) == [("x" * 100, 0, 100), ("x" * 100, 100, 200), ("x" * 90, 200, 290), ("x" * 10, 290, 300)]


def test_unknown_strategy(spark):
    df = spark.createDataFrame([(1, "t")], "i int, t string")
    with pytest.raises(ValueError):
        chunking.chunk(df, "i", "t", "semantic")
    chunking.register("halves", lambda text: [(text[: len(text) // 2], 0, len(text) // 2)])
    assert chunking.chunk(spark.createDataFrame([(1, "abcd")], "i int, t string"), "i", "t", "halves").first()["text"] == "ab"
