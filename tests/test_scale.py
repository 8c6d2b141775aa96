"""Steps whose work must not grow faster than their input, on groups that are large for one task."""

import time

from pyspark.sql import functions as F


def test_linked_debounce_of_one_crowded_stretch(spark):
    from corpusgraph.streaming.debounce import debounce_linked

    events = spark.range(60_000).select(F.lit("all").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 10).alias("t"), F.col("id").alias("i"))
    began = time.time()
    got = sorted(r["i"] for r in debounce_linked(events, "k", "t", "i", 3600.0).collect())
    assert got == [0, 36_000]
    assert time.time() - began < 90  # a frame read anew for each row took far longer


def test_long_rings_and_branching_components(spark):
    from corpusgraph.operators import taxonomy

    n = 30_000
    ring = spark.range(n).select("id", ((F.col("id") + 1) % n).alias("to"))
    tail = spark.range(n, n + 50).select("id", (F.col("id") + 1 - 51).alias("to"))
    fork = spark.createDataFrame([(n + 100, n + 101), (n + 101, n + 100), (n + 101, n + 102), (n + 102, n + 101), (n + 200, n + 200)], "id long, to long")
    rows = lambda e: e.select(F.col("id").alias("source"), F.col("to").alias("target"), ((F.col("id") * 37 % 101) / 100).alias("score"), F.lit(0.5).alias("overlap"))
    lost = lambda e: sorted((r["source"], r["target"]) for r in taxonomy.break_cycles(rows(e)).where("kind = 'NEIGHBOR'").collect())
    assert lost(ring.unionByName(tail)) == [(0, 1)]
    weak = lambda a, b: min([(a, b), (b, a)], key=lambda e: (e[0] * 37 % 101, e))
    assert lost(ring.unionByName(tail).unionByName(fork)) == [(0, 1), *sorted([weak(n + 100, n + 101), weak(n + 101, n + 102), (n + 200, n + 200)])]


def _vectors(n, seed=0, d=8):
    """Rows with copies, near ties, vectors without a direction and a repeated key."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] = x[n // 3] * rng.integers(1, 4, size=(n // 2 - n // 3, 1))
    rows = [(int(i), [float(v) for v in r], int(i * 7 % 5)) for i, r in enumerate(x)]
    rows[n - 1], rows[n - 2], rows[n - 3] = (n - 1, None, 1), (n - 2, [0.0] * d, 2), (n - 3, [], None)
    return [*rows, (7, [1.0] * d, 99)]


def _distance(a, b):
    import numpy as np

    a, b = np.array(a or [0.0]), np.array(b or [0.0])
    s = np.sqrt((a * a).sum() * (b * b).sum())
    return round(1 - float(a @ b / s), 6) + 0.0 if s else 1.0


def test_products_equal_brute_force(spark):
    from corpusgraph.operators import search

    rows = _vectors(120)
    table = spark.createDataFrame(rows, "i long, v array<double>, own int")
    asked = [r for r in rows[:-1] if r[0] % 4 == 0 or r[0] > 116]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>, own int")
    for k, own, itself in ((1, None, True), (3, None, False), (40, None, False), (2, "own", False)):
        got = sorted(tuple(r) for r in search.nearest(table, queries, "i", "v", k, own, itself).collect())
        want = []
        for q, v, o in asked:
            near = sorted((_distance(v, w), i) for i, w, p in rows if (itself or i != q) and (not own or (o is not None and o == p)))
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
        assert got == sorted(want)
    some = [r for r in rows[:-1]]
    got = {r["i"]: (r["class"], r["links"]) for r in search.alike(spark.createDataFrame(some, table.schema), "i", "v", 0.5).collect()}
    for i, v, _ in some:
        bare = not v or not any(v)
        assert got[i] == (i if bare else min(j for j, w, _ in some if w == v), 0 if bare else sum(j != i and _distance(v, w) <= 0.5 for j, w, _ in some))


def test_measures_of_a_search_equal_those_of_all_rows(spark):
    from corpusgraph.operators import retrieval

    rows = _vectors(90, 1)[:-1]
    asked = [r for r in rows if r[0] % 3 == 0]
    table = spark.createDataFrame(rows, "i long, v array<double>, label int")
    queries = spark.createDataFrame(asked, "query_id long, q array<double>, own int")
    found = spark.createDataFrame([(q, i, _distance(v, w), o is not None and o == p) for q, v, o in asked for i, w, p in rows if i != q], "query_id long, i long, distance double, rel boolean")
    want = sorted(tuple(r) for r in retrieval.measures(found, "query_id", "i", "distance", "rel", 2).collect())
    assert sorted(tuple(r) for r in retrieval.searched(table, queries, "i", "v", "label", 2, look=2).collect()) == want


def test_a_large_cache_is_searched_in_time(spark):
    from corpusgraph.operators import retrieval

    vecs = spark.range(24_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.sin(F.col("id") * (k + 1) * 0.37)).alias("v")).repartition(1)
    began = time.time()
    got = retrieval.cache_lookup(vecs.where("id % 2 = 1"), vecs.where("id % 2 = 0").select(F.col("id").alias("cached_id"), F.col("v").alias("c")), "id", "v").count()
    assert got == 12_000 and time.time() - began < 60  # one task of row-by-row products took far longer


def test_notes_are_parsed_once(spark):
    from corpusgraph.functions import projects

    text = "---\nid: 1\nid: 2\ntitle: 'it''s'\nlist:\n- a\n- 'b: c'\nnone: null\nempty: []\nlast: \"x\"\n---\nbody"
    got = spark.createDataFrame([(text,), (None,), ("no",)], "t string").select(projects.parse(F.col("t")).alias("m")).collect()
    assert got[0]["m"] == {"id": "1", "title": "it's", "list": "a\nb: c", "none": None, "empty": None, "last": "x"}
    assert got[1]["m"] is None and got[2]["m"] == {}
    many = "---\n" + "\n".join(f"k{k}: v{k}" for k in range(150)) + "\n---\n"
    began = time.time()
    rows = spark.range(2000).select(F.concat(F.lit(many), F.col("id").cast("string")).alias("t"))
    assert rows.select(F.sum(F.size(projects.parse(F.col("t"))))).first()[0] == 2000 * 150
    assert time.time() - began < 30  # keys compared with keys that are worked out again each time took far longer


def test_keywords_of_a_group_with_ties_and_without_a_name(spark):
    from corpusgraph.operators import retrieval

    rows = [("g", 2, "zeta alpha"), ("g", 1, "beta the gamma beta"), ("g", 3, "delta, gamma"), (None, 1, "omega psis omega"), ("h", 1, None), ("h", 2, "the a of")]
    table = spark.createDataFrame(rows, "g string, i int, t string")
    got = [(r["g"], r["term"], r["n"], r["rank"]) for r in retrieval.keywords(table, "g", "i", "t", 3).orderBy("g", "rank").collect()]
    assert got == [(None, "omega", 2, 1), (None, "psis", 1, 2), ("g", "beta", 2, 1), ("g", "gamma", 2, 2), ("g", "zeta", 1, 3)]
    # words are never aggregated by a sort but for the few that may be among the first
    many = spark.range(200).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.concat(F.lit("word"), (k % 7).cast("string")))).alias("t"))
    assert [r["n"] for r in retrieval.keywords(many, "g", "i", "t", 2).orderBy("rank").collect()] == [200 * 29, 200 * 29]


def test_best_rows_of_an_index_equal_brute_force(spark):
    from corpusgraph.operators import vector_index

    rows = _vectors(150, 2)
    index = vector_index.build(spark.createDataFrame(rows, "i long, v array<double>, own int"), "i", "v", lists=6)
    asked = [(1000 + i, v) for i, v, _ in rows[::2]]
    for least in (0.3, 0.9, 1.0):
        got = sorted(tuple(r) for r in vector_index.best_within(index, spark.createDataFrame(asked, "q long, v array<double>"), "q", "v", least).collect())
        best = [(q, *min((_distance(v, w), i) for i, w, _ in rows)[::-1]) for q, v in asked]
        assert got == sorted(b for b in best if b[2] <= round(1 - least, 6))
