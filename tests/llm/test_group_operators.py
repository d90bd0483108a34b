"""Vector searches, near duplicates, mixing, sharding and the pipeline against plain versions and SQL."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import ann, common, mixing, near_dedup, pii, queries, sharding, shingles, topk

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def sql_rows(name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    return names, sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    names, expected = sql_rows(name, SF)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == expected


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).astype(float).tolist()) for i in range(230)]
    rows += [(i, [0.25, -0.5, 0.0, 1.0]) for i in range(230, 290)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [math.nan, 0.0, 0.0, 0.0]), (304, [math.inf, 0.0, 0.0, 0.0]), (305, [1.0] * 5), (None, [1.0] * 4), (306, [0.0] * 4), (7, rows[7][1])]
    return [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows]


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], VECTORS)


def usable(vectors, zero):
    return [(i, v) for i, v in vectors if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def test_exact_top_k(spark, vectors, monkeypatch):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable(vectors, True)]
    expected = sorted(
        (q, n, c, s)
        for q, a in rows
        if q % 10 == 0
        for n, (s, c) in enumerate(sorted(((sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q), key=lambda t: (-t[0], t[1]))[:6], 1)
    )
    monkeypatch.setattr(topk, "GROUP", 64)  # several groups, and batches of queries
    monkeypatch.setattr(topk, "BATCH_BYTES", 8 * 4 * 8)
    monkeypatch.setattr(topk, "HELD", 20)
    monkeypatch.setattr(topk, "CHUNK", 2)
    got = topk.exact_top_k(spark, frame_of(spark, vectors), k=6, every=10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == expected


def test_top_k_of_queries_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 60)] + [(100, [1.0, 2.0, 3.0]), (100, [-1.0, 0.5, 0.0]), (100, [1.0, 2.0, 3.0])]
    whole = lambda v: [math.floor(1024 * x) for x in np.float32(v).astype(float)]
    expected = []
    for i, q in rows:
        best = sorted((-sum(x * y for x, y in zip(whole(q), whole(v), strict=True)), c) for c, v in rows if c != i)[:10]
        expected += [(i, n, c, -s) for n, (s, c) in enumerate(best, 1) if i == 100]
    got = topk.exact_top_k(spark, frame_of(spark, rows)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)


def test_exact_products_of_any_size():
    rng = np.random.default_rng(3)
    for scales in ([0, 20], [0, 31], [0, 40, 70], [1000, 1020]):
        a, b = (np.floor(rng.normal(size=(n, 5)) * np.exp2(rng.choice(scales, (n, 1)))) for n in (7, 9))
        plain = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), 1 - 2**63), 2**63 - 1) for q in b] for p in a]
        assert topk._exact(a, b).tolist() == plain
    assert topk._exact(np.zeros((0, 5)), np.zeros((3, 5))).shape == (0, 3)


def test_top_k_beyond_64_bits(spark):
    big, most = 1e300, 2**63 - 1
    rows = [(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [big, -big]), (4, [0.0, 2.0]), (5, [1e-3, 2.0]), (6, [2.0, 0.0])]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS.replace("float", "double"))
    got = [(r["vec_id"], r["score"]) for r in topk.exact_top_k(spark, frame, k=6).orderBy("rank").collect()]
    assert got == [(1, most), (3, most), (5, most), (6, most), (4, 1024 * 2048), (2, -most)]
    plain = lambda v: [math.floor(1024 * x) for x in v]
    middle = [(0, [3e6, 1.0]), (1, [2.5e6, -7.25]), (2, [-1e6, 3e6])]
    frame = spark.createDataFrame([(*r, "", "") for r in middle], VECTORS.replace("float", "double"))
    got = {r["vec_id"]: r["score"] for r in topk.exact_top_k(spark, frame).collect()}
    assert got == {i: sum(x * y for x, y in zip(plain(middle[0][1]), plain(v), strict=True)) for i, v in middle[1:]}


def test_few_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (5, [3.0, 4.0], "", "")], VECTORS)
    assert [(r["query_id"], r["vec_id"]) for r in topk.exact_top_k(spark, two, every=100).collect()] == [(0, 5)]
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(spark, two, every=100).collect()] == [(0, 5)]
    for some in (two.limit(0), two.limit(1), spark.createDataFrame([(0, None, "", ""), (1, [], "", "")], VECTORS)):
        assert topk.exact_top_k(spark, some).count() == 0 and ann.nearest(spark, some).count() == 0
    zero = spark.createDataFrame([(0, [0.0, 0.0], "", "")], VECTORS)
    assert ann.nearest(spark, zero).count() == 0


def plain_nearest(rows, every, k):
    size = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (size(a) * size(b))
    return {q: sorted(((-cos(a, b), c) for c, b in rows if c != q))[:k] for q, a in rows if q % every == 0}


def test_one_list_is_exact(spark, vectors):
    rows = usable(vectors, False)
    got = defaultdict(list)
    for r in ann.nearest(spark, frame_of(spark, vectors), k=4, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    for q, best in plain_nearest(rows, 10, 4).items():
        assert [r["score"] for r in got[q]] == pytest.approx([-s for s, _ in best], abs=1e-12)
    ties = {r["vec_id"] for r in got[230]}
    assert ties == {231, 232, 233, 234}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)  # lists of several blocks, and batches of queries
    monkeypatch.setattr(ann, "BATCH", 7)
    monkeypatch.setattr(ann, "LIST", 64)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = ann.nearest(spark, spark.read.parquet(f"{SF}/embeddings.parquet"), k=5, every=5).collect()
    expected = plain_nearest(rows, 5, 5)
    assert Counter(r["query_id"] for r in got) == {q: 5 for q in expected}
    true = {(q, c) for q, best in expected.items() for _, c in best}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(true)


def test_nearest_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(1, 40)] + [(50, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0]), (7, [1.0, 0.1, 0.0, 0.0]), (7, [1.0, 0.0, 0.1, 0.0])]
    got = defaultdict(int)
    for r in ann.nearest(spark, frame_of(spark, rows)).collect():
        got[r["query_id"], r["vec_id"], round(r["score"], 5)] += 1
    expected = Counter()
    for i, q in rows:
        if i == 50:
            cos = [(-sum(x * y for x, y in zip(q, v, strict=True)) / math.sqrt(sum(x * x for x in v)), c) for c, v in rows if c != i]
            expected.update((50, c, round(-s, 5)) for s, c in sorted(cos)[:5])
    assert got == expected


def test_nearest_where_most_rows_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 16)
    rng = np.random.default_rng(8)
    rows = [(50, [1.0, 0.0, 0.0, round(float(x), 3)]) for x in rng.normal(size=300) * 0.01]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=4) - [3, 0, 0, 0]]) for i in range(1, 4)]
    rows += [(100, [-1.0, 0.5, 0.0, 0.0])]
    got = defaultdict(set)
    for r in ann.nearest(spark, frame_of(spark, rows), k=5).collect():
        got[r["query_id"]].add((r["rank"], r["vec_id"]))
    assert {v for _, v in got[50]} == {1, 2, 3, 100} and {n for n, _ in got[50]} == {1, 2, 3, 4}
    assert len(got[100]) == 5


def plain_set(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def plain_groups(texts, k):
    """Every pair; texts: id to text."""
    sets = {i: plain_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_texts():
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(n)]
    passage, texts = words(60), {}
    for g in range(12):  # groups of near copies, some drifting in chains
        base = words(rng.randrange(8, 90))
        for _ in range(rng.randrange(1, 9)):
            texts[len(texts)] = " ".join(base)
            base = [w if rng.random() < 0.985 else words(1)[0] for w in base]
    for _ in range(50):  # a passage that many share, and more
        texts[len(texts)] = " ".join(passage + words(rng.randrange(10, 40)))
    for t in ("", None, "  \t", "One", "one", "ONE two", "one\ttwo", "é É", "word " * 30_000, "one\x0btwo", "one\x1ctwo"):
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize(("k", "small", "frequent"), [(2, 16, 64), (2, 1, 64), (2, 1, 2), (2, 1, 0), (5, 1, 3), (5, 16, 64)])
def test_near_duplicates(spark, monkeypatch, k, small, frequent):
    monkeypatch.setattr(near_dedup, "SMALL_HUB", small)  # 1: every hub counts as large
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)  # 0: all of it in blocks
    monkeypatch.setattr(near_dedup, "HUB_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "STRAY_BLOCK", 3)
    monkeypatch.setattr(common, "PART", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0 if frequent == 2 else 10_000)
    monkeypatch.setattr(near_dedup, "SET_PART", 2)
    texts = near_texts()
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts.items()], f"{KIND}, node string, n int, key string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark, frame, shingle=k).collect()}
    assert got == plain_groups(texts, k)


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_that_stand_on_several_texts(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = list(near_texts().values())[:40] if seed == 2 else ["A a a", "A a a", "B b c", "B b c"]
    rows = [(3, texts[0]), (5, texts[1]), (5, texts[2]), (9, texts[3])]
    if seed == 2:
        rows = [(rng.randrange(25), t) for t in [*texts, *rng.choices(texts, k=20)]] + [(3, None), (3, ""), (99, None)]
    docs = spark.createDataFrame(rows, KIND)
    got = Counter(map(tuple, near_dedup.near_duplicates(spark, docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), shingle=2).collect()))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ("doc_id", "n_shingles", "component_id", "kept")
    expected = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op7_near_dedup']})").fetchall())
    assert Counter({r: n for r, n in got.items() if r[0] is not None}) == expected
    assert sum(n for r, n in got.items() if r[0] is None and r[2] is None and r[3]) == 1
    if seed == 1:
        assert {r[2] for r in expected} == {3}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "a b c"), (5, None), (5, None), (6, "")]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, KIND), shingle=2).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == sorted(
        map(str, [(None, 2, None, True)] * 2 + [(3, 2, 3, True)] * 2 + [(4, 2, 3, False)] + [(5, 0, 5, True)] * 2 + [(6, 0, 6, True)])
    )
    assert near_dedup.near_duplicates(spark, spark.createDataFrame([], KIND)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (503, 501)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in near_dedup.components(common.Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 503: 500}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]  # 1500 of 2500
    x, y = shingles.super_minhash(np.concatenate([a, b]), np.array([2000, 2000]), 240)
    assert abs((x == y).mean() - 0.6) < 0.12
    alone = shingles.super_minhash(a, np.array([2000]), 240)
    assert np.array_equal(alone[0], x)  # a set's signature doesn't depend on the sets beside it
    few = shingles.super_minhash(pool[:3], np.array([3]), 240)
    assert np.isfinite(few).all() and len(np.unique(np.floor(few))) > 50


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else None, f"t{i}") for i in range(3000)] + [(9000, "rare", ""), (None, "rare", None), (None, "rare", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0), ("rare", 2.0), ("absent", 9.0)], "source string, weight double")
    got = mixing.mix(docs, weights).collect()
    share = Counter(r["source"] for r in got)
    total = 3003
    expected = {"a": total / 4 * 4 / 13 * 13 / 4, None: total / 4, "rare": total / 2}
    for s, n in expected.items():
        assert abs(share[s] - n) < 6 * math.sqrt(n) + 1, (share, expected)
    copies = Counter((r["doc_id"], r["text"], r["mix_copies"]) for r in got)
    for (i, _, n), seen in copies.items():
        assert seen == n * (2 if i is None else 1)
    # the counts of one source follow the Poisson distribution
    rate = total / 4 / 2000
    none = 1 - len({r["doc_id"] for r in got if r["source"] == "a"}) / 2000
    assert abs(none - math.exp(-rate)) < 0.05
    again = mixing.mix(docs, weights).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    places = [i for i, r in enumerate(got) if r["source"] == "a"]
    assert abs(np.mean(places) / len(got) - 0.5) < 0.06  # in no order of source
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = mixing.mix(docs.selectExpr("*", "1 AS n", "2 AS rate", "3 AS mix_rate")).first()
    assert clash["n"] == 1 and clash["mix_rate"] != 3
    names = docs.selectExpr("*", "5 AS Mix_Source", "6 AS mix_note", "7 AS MIX_COPY", "8 AS mix_row", "9 AS mix_text", "10 AS mix_parts", "11 AS mix_of")
    kept = mixing.mix(names)
    assert [c for c in kept.columns if c.lower() == "mix_copy"] == ["mix_copy"]
    assert {tuple(r[c] for c in ("Mix_Source", "mix_note", "mix_row", "mix_text", "mix_parts", "mix_of")) for r in kept.collect()} == {(5, 6, 8, 9, 10, 11)}
    assert Counter((r["doc_id"], r["text"], r["mix_copy"]) for r in kept.collect()) == Counter((r["doc_id"], r["text"], r["mix_copy"]) for r in mixing.mix(docs).collect())


def test_mixing_texts_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a", f"t{i}") for i in range(400)], "doc_id long, source string, text string")
    got = mixing.mix(docs).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["mix_copies"] for r in got}) <= 1 and (not got or len({r["part"] for r in got}) > 1)


def test_bounded_sample(spark):
    rows = [("a", i) for i in range(9000)] + [("a", 3)] * 4000 + [("b", i) for i in range(40)] * 2 + [("c", None), (None, 5)]
    frame = spark.createDataFrame(rows, "kind string, doc_id long").repartition(6)
    got = sorted((r["kind"], r["doc_id"]) for r in common.bounded_sample(frame, "kind", 100, 17).collect())
    ordered = frame.where("kind = 'a'").select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).distinct().orderBy("h").limit(100).collect()
    assert got == sorted([("a", r["doc_id"]) for r in ordered] + [("b", i) for i in range(40)])


def check_shards(rows, texts, n_shards=8):
    assert len(rows) == len(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    for shard, of in by_shard.items():
        assert 0 <= shard < n_shards and sorted(r["slot"] for r in of) == list(range(len(of)))
    plain = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == plain
    return [sum(r["size"] for r in by_shard[s]) for s in range(n_shards)]


@pytest.mark.parametrize("few", [sharding.FEW_GROUPS, 0])
def test_sharding(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW_GROUPS", few)  # 0: groups are joined in parts
    monkeypatch.setattr(common, "PART", 3)
    rng = random.Random(4)
    texts = [(i, "x" * rng.randrange(20, 400) + str(i)) for i in range(1500)]
    for g in range(60):
        texts += [(2000 + 20 * g + j, f"group {g} " * 15) for j in range(rng.randrange(2, 9))]
    docs = spark.createDataFrame([(*t, 1, "s") for t in texts], f"{KIND}, shard int, u string")
    rows = sharding.shard_documents(spark, docs).collect()
    loads = check_shards(rows, texts)
    assert max(loads) - min(loads) <= 2 * 410
    where = defaultdict(set)
    of = dict(texts)
    for r in rows:
        if r["linked"]:
            where[of[r["doc_id"]]].add(r["shard"])
    assert len(where) == 60 and all(len(s) == 1 for s in where.values())  # no group is cut


def test_sharding_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op9_sharding(spark, SF).collect()
    loads = check_shards(rows, texts)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_sharding_very_long_texts(spark):
    """Few texts that hold most bytes, some of them linked: shards differ by less than a short text."""
    rng = random.Random(9)
    texts = [(i, "y" * rng.randrange(20_000, 60_000) + str(i)) for i in range(90)] + [(100 + i, "z" * 30_000) for i in range(5)]
    texts += [(1000 + i, "x" * rng.randrange(20, 400) + str(i)) for i in range(3000)]
    loads = check_shards(sharding.shard_documents(spark, spark.createDataFrame(texts, KIND).repartition(4)).collect(), texts)
    assert max(loads) - min(loads) <= 2 * 410
    # one text as long as all others together: nothing else is put beside it
    texts = [(0, "w" * 40_000), *((1 + i, f"text {i:04d} " * 5) for i in range(800))]
    loads = check_shards(sharding.shard_documents(spark, spark.createDataFrame(texts, KIND)).collect(), texts)
    assert sorted(loads)[-1] == 40_001 and max(sorted(loads)[:-1]) - min(loads) <= 2 * 60


def test_longest_first():
    loads = [5.0, 0.0, 2.0]
    assert sharding._one_by_one([(1, 10), (9, 11), (4, 12), (4, 13)], loads) == {11: 1, 12: 2, 13: 0, 10: 2} and loads == [9.0, 9.0, 7.0]
    assert sharding._one_by_one([], loads) == {} and loads == [9.0, 9.0, 7.0]


def test_sharding_rows_that_agree_in_all(spark):
    texts = [(7, "one and the same")] * 500 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(100, 150)]
    rows = sharding.shard_documents(spark, spark.createDataFrame(texts, KIND).repartition(3)).collect()
    loads = check_shards(rows, texts)
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 8
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) > 1


def test_sharding_a_group_larger_than_a_shard(spark):
    texts = [(i, "the same text") for i in range(900)] + [(1000 + i, f"other {i:05d}...") for i in range(900)] + [(None, None)] * 3 + [(5, "again"), (5, "again")]
    rows = sharding.shard_documents(spark, spark.createDataFrame(texts, KIND)).collect()
    loads = check_shards(rows, texts)
    assert max(loads) < 1.05 * sum(loads) / 8
    shards = Counter(r["shard"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["size"] == 14)
    assert sum(n > 50 for n in shards.values()) <= 6  # at least four are needed
    assert sharding.shard_documents(spark, spark.createDataFrame([], KIND)).count() == 0


DOCUMENTS = f"{KIND}, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (None, "no id at all", None, None, 12), (3, "an id twice", "en", "src0", 11)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 4"))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], "/root/testdata/sf0.01").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_stage_toxicity(spark, stages):
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    before, after = Counter(rows_of(stages[0])), Counter(rows_of(stages[1]))
    gone = {i for i, _ in before - after}
    assert not after - before and sum(marks.get(i) == 1 for i in gone) >= 0.7 * sum(marks.values()) and not sum(marks.get(i) == 0 for i in gone)
    assert {(90_000, None), (90_001, ""), (None, "no id at all")} <= set(after)


def test_stage_near_duplicates(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    texts = {i: t for i, t in before if i is not None and t != "an id twice"}
    groups = plain_groups(texts, 5)
    kept = Counter(i for i, _ in after)
    assert {i for i in kept if i is not None} == {i for i, (_, c) in groups.items() if i == c}
    assert kept[4] == 1 and kept[None] == 1 and kept[3] == 2
    assert len(after) < len(before)


@pytest.mark.parametrize("change", ["", " and one more word"])
def test_texts_of_one_id_are_dropped_apart(spark, change):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(3, a), (5, a + change), (5, b), (7, b + change), (8, None), (8, "alone with its id"), (None, a), (3, a)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, KIND), SF)
    assert Counter(rows_of(left)) == Counter([(3, a), (5, b), (8, None), (8, "alone with its id"), (None, a)])


def test_stage_personal_data(stages):
    plain = Counter((i, pii.redacted(t)) for i, t in rows_of(stages[2]))
    assert Counter(rows_of(stages[3])) == plain
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in stages[3].collect())


def test_stage_mixing(spark, stages):
    before, after = Counter(rows_of(stages[3])), Counter(rows_of(stages[4]))
    assert set(after) <= set(before)
    counts = {(r["doc_id"], r["text"]): r["mix_copies"] for r in mixing.mix(stages[3]).collect()}
    assert after == {k: n * before[k] for k, n in counts.items()}


def test_stage_packing(spark, stages):
    sizes = Counter()
    for r in stages[5].collect():
        if r["start"] == 0:
            sizes[r["doc_id"]] += 1
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert sizes == Counter(i for i, _ in rows_of(stages[4]))


def test_stages_of_odd_tables(spark):
    """Empty tables, and columns whose names and types stages use inside or can't compare."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), SF).count() == 0
    clash = ["gone_id", "again_id", "again_text", "row", "first_row", "count", "score", "node", "mix_rate", "mix_extra"]
    docs = plain.limit(30).select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)), F.create_map(F.lit("a"), "doc_id").alias("map"))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).collect()
        assert out
        if k < 4:
            assert out[0].__fields__ == docs.columns
            assert all(r[c] == i for r in out for i, c in enumerate(clash)) and all(r["map"] == {"a": r["doc_id"]} for r in out)
        if k == 1:
            assert len({r["doc_id"] for r in out}) == len(out)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0
