import random
import re

import numpy as np

from tidewright.llm import neardup, neighbours


def _words(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(*[w[i:] for i in range(k)]))


def _corpus(seed, groups=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)] + ["Ärger", "été", "日本", "x9"]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 90))]
        for _ in range(rng.choice([1, 2, 4, 7])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            rows.append((i, rng.choice([" ", "  ", ", "]).join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "two words"), (i + 3, "Same, text: here."), (i + 4, "same text HERE"), (i + 4, "same text HERE"), (i + 5, "long word " * 20000)]
    return rows


def _truth(rows, k, least):
    sets = {i: _words(t, k) for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_match_brute_force(spark):
    rows = _corpus(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, body string, same string").repartition(3)
    want = _truth(rows, 3, 0.5)
    for limit in (20_000, 64):  # with a small limit hot shards are cut into blocks
        members, pairs = neardup.similar(df, "k", "body", k=3, least=0.5, bands=32, rows=3, radius=70, shard_limit=limit)
        got = {tuple(r) for r in neardup.expand(members, pairs).collect()}
        assert not got - want and len(want - got) <= 0.02 * len(want)


def test_groups_are_linear_and_connected(spark):
    rows = _corpus(2, 30) + [(1000 + i, "one copy of a rather long and equal text") for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, body string")
    members, pairs = neardup.similar(df, "k", "body", k=3, least=0.5, bands=32, rows=3, radius=70)
    out = neardup.groups(members, pairs).collect()
    assert {(r["class_id"], r["group_id"]) for r in out if r["id"] >= 1000} == {(1000, 1000)} and sum(r["id"] >= 1000 for r in out) == 300
    group = {r["id"]: r["group_id"] for r in out}
    assert all(group[a] == group[b] for a, b in _truth(rows[:-300], 3, 0.5) if a in group)


def test_large_classes_keep_all_pairs(spark):
    rows = [(i, f"one copy of a rather{'!' * (i % 7)} long and equal text, which many rows have") for i in range(1100)]
    rows += [(2000 + i, "one copy of a rather long and equal text, which many rows had" + "." * i) for i in range(3)]
    df = spark.createDataFrame(rows, "k bigint, body string")
    members, pairs = neardup.similar(df, "k", "body", k=3, least=0.5, bands=32, rows=3, radius=70)
    for block in (1000, 100):
        out = neardup.expand(members, pairs, block=block)
        assert out.count() == out.distinct().count() == 1103 * 1102 // 2 and out.where("id_a >= id_b").isEmpty()


def test_hot_shards_lose_nothing_in_blocks(spark):
    rows = [(i, "shared opening words of every text in this shard " + " ".join(f"t{i}x{j}" for j in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, body string")
    prepared = neardup._prepare(df, "k", "body", 3, 4, 1)
    shards = neardup._shards(prepared, 4)
    listed = lambda x: spark.createDataFrame(x, "key bigint, blocks int")
    plain = {tuple(r) for r in neardup._candidates(neardup._blocks(shards, listed([])), 90).collect()}
    keys = [r["key"] for r in shards.groupBy("key").count().where("count > 50").collect()]
    cut = {tuple(r) for r in neardup._candidates(neardup._blocks(shards, listed([(k, 4) for k in keys])), 90).collect()}
    few = {tuple(r) for r in neardup._candidates(neardup._blocks(shards, listed([])), 90, chunk=50).collect()}
    assert keys and cut == plain == few


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k bigint, body string")
    members, pairs = neardup.similar(empty, "k", "body")
    assert members.count() == 0 and pairs.count() == 0 and neardup.expand(members, pairs).count() == 0


def test_trees_find_what_a_scan_finds_and_look_at_a_pair_once():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (20, 2)).astype(np.uint64)
    prints = base[rng.integers(0, 20, 400)] ^ (np.uint64(1) << rng.integers(0, 60, (400, 2)).astype(np.uint64))
    prints[::9] = prints[1]
    shard = np.sort(rng.integers(0, 5, 400))
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    all_pairs = {(i, j) for i in range(400) for j in range(i + 1, 400) if shard[i] == shard[j]}
    for radius in (0, 8, 70):
        got, visits = neardup.near_pairs(shard, prints, radius)
        assert {tuple(map(int, x)) for x in got} == {(i, j) for i, j in all_pairs if d[i, j] <= radius}
        assert len(got) == len({tuple(x) for x in got}) and visits <= len(all_pairs)


def test_share_of_a_shard_that_a_tree_looks_at():
    """Small radii prune a shard of 20,000 unrelated prints; the radius that similarity 0.5 needs does not (README)."""
    prints = np.random.default_rng(4).integers(0, 1 << 63, (20_000, 3)).astype(np.uint64)
    forest = neardup.Forest(np.zeros(20_000, np.int64), prints)
    share = {}
    for radius in (0, 2, 5):
        forest.visits = 0
        assert sum(len(a) for a, _ in forest.search(radius)) == 0
        share[radius] = forest.visits / (20_000 * 19_999 / 2)
    assert share[0] < 0.002 and share[2] < 0.1 and share[0] < share[2] < share[5]


def _vectors(seed, n=1500, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    return [list(map(float, v)) for v in (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)]


def _brute(rows, dim, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -s[n]))[:k]]] for n, i in enumerate(ids)}


def test_neighbours_recall_dirt_and_ties(spark):
    rows = list(enumerate(_vectors(3)))
    rows += [(5000 + i, rows[7][1]) for i in range(9)]  # equal vectors, more than k
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] + [1.0] * 15), (6003, [1.0] * 15), (6004, []), (6005, [None] + [1.0] * 15), (6006, [2 * x for x in rows[8][1]]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "k bigint, v array<double>, id double").repartition(4)
    for options in ({}, {"cell_limit": 40, "query_limit": 150}, {"train": 200}):  # full cells cut into sides and blocks; cells fitted in Spark
        out = neighbours.neighbours(df, "k", "v", 16, cell=100, **options).collect()
        got = {}
        for r in sorted(out, key=lambda r: r["place"]):
            got.setdefault(r["id"], []).append(r["neighbor_id"])
        want = _brute([r for r in rows if r[0] != 0] + [rows[0]], 16)
        assert set(got) == set(want)
        assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.95 * sum(map(len, want.values()))
        assert got[5000] == [7, 5001, 5002, 5003, 5004] and got[7] == [5000, 5001, 5002, 5003, 5004]
        assert got[8][0] == 6006


def test_neighbours_beyond_a_border_are_found_among_many_cells(spark):
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(600, 32)), 10, axis=0) + 0.6 * rng.normal(size=(6000, 32))).astype(np.float32)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    want, got = _brute(rows, 32), {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "k bigint, v array<double>"), "k", "v", 32, cell=10).collect():
        got.setdefault(r["id"], []).append(r["neighbor_id"])
    assert set(got) == set(want) and all(len(set(near)) == 5 for near in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * 5 * len(want)


def test_cells_are_fitted_on_different_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(70)], "k bigint, v array<double>")
    assert neighbours._sample(neighbours.units(df, "k", "v", 2), 7, 7).count() == 7


def test_neighbours_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None)], "k bigint, v array<double>")
    assert {(r["id"], r["neighbor_id"]) for r in neighbours.neighbours(few, "k", "v", 2).collect()} == {(1, 2), (2, 1)}
    assert neighbours.neighbours(few.where("k = 3"), "k", "v", 2).count() == 0


def test_additive_codes_come_close():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    one_cell = neighbours.Index(np.zeros((1, 8), np.float32), np.array([0, 1]), np.zeros((1, 8), np.float32), np.zeros((0, 0, 8), np.float32))
    books = neighbours.books_for(x, one_cell)
    one, four = (np.square(x - neighbours.encode(x, books[:m])[1]).sum() for m in (1, 4))
    greedy = np.square(x - neighbours.encode(x, books, beam=1)[1]).sum()
    assert four < 0.35 * one and four <= greedy


def test_cells_keep_their_size_as_the_collection_grows():
    for n in (150_000, 2_500_000, 10_000_000, 100_000_000):
        tops, cells = neighbours.cells_for(n, 64, 400)
        assert 380 <= n / cells <= 420 and tops * tops >= cells and tops <= cells
    tops, cells = neighbours.cells_for(10**9, 64, 400)  # the centres' bytes are used up
    assert cells * 64 * 4 == neighbours.CENTRE_BYTES and tops < 600


def test_near_cells_are_those_a_scan_finds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    top = rng.normal(size=(5, 8)).astype(np.float32)
    first = np.array([0, 3, 4, 9, 9 + 6, 20])
    index = neighbours.Index(top, first, rng.normal(size=(20, 8)).astype(np.float32), np.zeros((0, 0, 8), np.float32))
    got = neighbours.near_cells(x, index, 4, beam=5)
    want = np.argsort(((x[:, None] - index.centres[None]) ** 2).sum(2), axis=1)[:, :4]
    assert (got == want).all()
    one = neighbours.near_cells(x, index, 4, beam=1)
    assert ((one[:, 1] < 0) == (one[:, 0] == 3)).all()


def test_groups_equal_their_sql_twin(spark):
    import duckdb

    from tidewright.llm import queries, sql

    con = duckdb.connect()
    for name in ("text_chunks", "cache_entries"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = sorted(con.execute(sql.ORACLE["p1_groups"]).fetchall())
    got = sorted(tuple(r) for r in queries.p1_groups(spark, "/root/testdata/sf0.001").collect())
    assert got == want and any(r[4] for r in got)
