import random

import tiktoken

from tidewright.llm import encode, pack

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [None, "", " ", "Hello world, it's 2024!  Two  spaces\n\n\ttabs ", "été 日本語のテキスト 🔧👩‍💻 ﬁne‑tuned", "<|endoftext|> is text", "a" * 5000, " \r\n\r\n x ", "\u00a0\u2003wide\u3000", "Ünïcode " * 3000]


def _own():
    return tiktoken.Encoding("own", pat_str=encode.WORD_PATTERN, mergeable_ranks=encode.ranks(PATH), special_tokens={})


def _df(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc string, body string, ids string")


def test_ids_equal_the_library_on_both_paths_and_decode_back(spark):
    own = _own()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc bigint, body string, ids string")
    for bound in (48 << 20, 400, 0):  # all words broadcast, only the frequent ones, none
        out = encode.encode(df, "doc", "body", table_bound=bound)
        got = {r["doc"]: r["ids"] for r in out.collect()}
        assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["doc"]: r["text"] for r in encode.decode(out, "doc", encode.pieces(spark)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_frequent_words_are_broadcast_as_far_as_the_bound_goes(spark):
    words = [" the"] * 5000 + [f" w{i}" for i in range(3000)] + [" often"] * 40
    df = spark.createDataFrame([("".join(words[i::50]),) for i in range(50)], "text string").selectExpr("monotonically_increasing_id() AS doc", "text")
    table = encode.word_table(encode.words(df, "doc", "text"), PATH)
    least = encode._least(table, 500)
    held = {r["word"] for r in table.where(f"n >= {least}").collect()}
    assert " the" in held and len(held) < 20 and encode._least(table, 48 << 20) is None
    own = _own()
    want = {r["doc"]: own.encode_ordinary(r["text"]) for r in df.collect()}
    assert {r["doc"]: r["ids"] for r in encode.encode(df, "doc", "text", table_bound=500).collect()} == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "null id")], "doc bigint, body string")
    for bound in (48 << 20, 0):
        got = encode.encode(df, "doc", "body", table_bound=bound).collect()
        assert sorted(str(r["doc"]) for r in got) == ["1", "1", "None"]
        assert encode.encode(df.where("false"), "doc", "body", table_bound=bound).count() == 0


def _pack(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc bigint, n int, container string").repartition(5)
    rows = pack.pack(df, "doc", "n", capacity).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["doc"], []).append(r)
    for i, s in enumerate(sizes):
        assert sum(r["size"] for r in parts[i]) == max(0, s or 0)
        assert len(parts[i]) == max(1, -(-(s or 0) // capacity))
    held = {}
    for r in rows:
        if r["container"] is not None:
            held.setdefault(r["container"], []).append((r["position"], r["size"]))
    for own in held.values():
        at = 0
        for position, size in sorted(own):
            assert position == at
            at += size
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))
    return len(held)


def test_packing_fills_containers_without_gaps(spark):
    rng = random.Random(3)
    sizes = [rng.choice([None, 0, -1, 3, 3, 3, 17, rng.randrange(1, 100), rng.randrange(1, 350)]) for _ in range(1500)]
    n = _pack(spark, sizes, 100)
    total = sum(max(0, s or 0) for s in sizes)
    assert n <= 1.03 * -(-total // 100) + 1


def test_packing_one_hot_length_exact_fits_and_nothing(spark):
    assert _pack(spark, [50] * 999, 100) == 500
    assert _pack(spark, [100] * 7 + [60, 40], 100) == 8
    assert pack.pack(spark.createDataFrame([], "doc bigint, n int"), "doc", "n", 100).count() == 0


def test_plan_uses_every_item_once():
    counts = {7: 5, 30: 11, 64: 2, 100: 1}
    slots = pack.plan(counts, 100)
    for size, n in counts.items():
        assert sum(s[2] for s in slots if s[0] == size) == n
