"""Queries on embeddings, clusters, graphs and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.functions import vectors as V
from corpusgraph.operators import clusters, retrieval, search, taxonomy
from corpusgraph.operators.ranking import top_per_group
from corpusgraph.plans import query
from corpusgraph.session import ship, table

_DIMS = """d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT label, dim, avg(x) AS mean, count(*) AS size FROM d GROUP BY ALL),
c AS (SELECT label, list(mean ORDER BY dim) AS centroid, max(size) AS size FROM m GROUP BY label)"""


@query(f"""WITH {_DIMS}, r AS (SELECT e.label, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS distance FROM embeddings e JOIN c USING (label)),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::BIGINT AS rank FROM r)
SELECT label, rank, vec_id, distance, substring(text, 1, 200) AS snippet FROM k LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5""")
def cluster_representatives_top5(spark, sf_dir):
    best = clusters.representatives(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 200).alias("snippet"))
    return docs.join(F.broadcast(best), "vec_id", "right").select("label", "rank", "vec_id", "distance", "snippet")


@query(f"WITH {_DIMS} SELECT label, dim::INTEGER AS dim, round(mean, 6) AS mean, size::BIGINT AS size FROM m")
def cluster_centroids(spark, sf_dir):
    return clusters.centroid_dims(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


def _asked(vecs, *keep):
    """The stated query set: rows whose id is divisible by 20."""
    return vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), V.as_double(F.col("embedding")).alias("q"), *keep)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM embeddings q JOIN embeddings e ON e.vec_id != q.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::BIGINT AS rank FROM s) SELECT query_id, rank, vec_id, distance FROM k WHERE rank <= 10""")
def vector_topk_search(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return search.top_k(vecs, _asked(vecs), "vec_id", "embedding", 10)


@query(f"""WITH {_DIMS}, s AS (SELECT d.vec_id, c.label AS cluster, round(sum((d.x - c.centroid[d.dim + 1]) ^ 2), 6) AS distance2 FROM d JOIN c ON true GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance2, cluster) AS rn FROM s) SELECT vec_id, cluster, distance2 FROM k WHERE rn = 1""")
def nearest_centroid_assign(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    cents = clusters.centroids(vecs, "label", "embedding").select(F.col("label").alias("cluster"), "centroid")
    return clusters.assign(vecs, cents, "vec_id", "embedding").drop("embedding")


@query("""WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c0 AS (SELECT vec_id AS cluster, embedding::DOUBLE[] AS c FROM embeddings ORDER BY vec_id LIMIT 8),
s0 AS (SELECT d.vec_id, cluster, round(sum((x - c[dim]) ^ 2), 6) AS q FROM d, c0 GROUP BY ALL), a0 AS (SELECT vec_id, cluster FROM s0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, cluster) = 1),
m1 AS (SELECT cluster, dim, avg(x) AS mean FROM d JOIN a0 USING (vec_id) GROUP BY ALL), c1 AS (SELECT cluster, list(mean ORDER BY dim) AS c FROM m1 GROUP BY cluster),
s1 AS (SELECT d.vec_id, cluster, round(sum((x - c[dim]) ^ 2), 6) AS q FROM d, c1 GROUP BY ALL)
SELECT vec_id, cluster, q AS distance2 FROM s1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, cluster) = 1""")
def kmeans_fixed_lloyd(spark, sf_dir):
    return clusters.lloyd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 2)


@query(None)
def kmeans_mllib(spark, sf_dir):
    return clusters.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query("""WITH p AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT (SELECT count(*) FROM embeddings)::BIGINT AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, avg(s) > 0.95 AS collapsed FROM p""")
def pairwise_cosine_stats(spark, sf_dir):
    ship(spark)
    return clusters.pairwise_cosine(table(spark, sf_dir, "embeddings"), "embedding").withColumn("collapsed", F.col("mean") > 0.95)


@query("""WITH d AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), v AS (SELECT dim, var_pop(x) AS v FROM d GROUP BY dim)
SELECT round(avg(CASE WHEN v > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*)::BIGINT AS dims FROM v""")
def embedding_coverage(spark, sf_dir):
    dims = table(spark, sf_dir, "embeddings").select(F.posexplode(V.as_double(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("v"))
    return dims.agg(F.round(F.avg(F.when(F.col("v") > 0.01, 1.0).otherwise(0.0)), 6).alias("coverage"), F.count("*").alias("dims"))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM n""")
def embedding_magnitude(spark, sf_dir):
    norms = table(spark, sf_dir, "embeddings").select(V.norm(V.as_double(F.col("embedding"))).alias("n"))
    return norms.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


@query(None)
def embedding_pca_usage(spark, sf_dir):
    """Share of dimensions that 95 % of the variance needs."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vecs = table(spark, sf_dir, "embeddings").select(array_to_vector(V.as_double(F.col("embedding"))).alias("features"))
    d = len(vecs.first()[0])
    shares = PCA(k=d, inputCol="features", outputCol="p").fit(vecs).explainedVariance.toArray()
    need = int((shares.cumsum() <= 0.95).sum()) + 1
    return spark.createDataFrame([(min(need, d), d, round(min(need, d) / d, 6))], "needed int, dims int, usage double")


_PAIRS = f"""{_DIMS}, p AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS similarity FROM c a JOIN c b ON a.label != b.label)"""


def _similarities(spark, sf_dir):
    """Ordered pairs of clusters: their number is squared, so this is for centroids, never for rows."""
    c = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("x")), c.select(F.col("label").alias("b"), F.col("centroid").alias("y"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT * FROM p")
def centroid_similarity_matrix(spark, sf_dir):
    return _similarities(spark, sf_dir)


@query(f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b)::BIGINT AS rank FROM p WHERE similarity >= -0.2) SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, similarity FROM k WHERE rank <= 5")
def taxonomy_neighbor_edges(spark, sf_dir):
    best = top_per_group(_similarities(spark, sf_dir).where("similarity >= -0.2"), ["a"], [F.desc("similarity"), F.col("b")], 5, ["b"])
    return best.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "similarity").distinct()


_TERMS = """t AS (SELECT p_size, lower(trim(u)) AS term FROM (SELECT p_size, unnest(list_concat([p_brand], string_split(p_type, ' '))) AS u FROM part) WHERE trim(u) != ''),
ts AS (SELECT DISTINCT p_size, term FROM t), df AS (SELECT term, count(*) AS df FROM ts GROUP BY term), n AS (SELECT count(DISTINCT p_size) AS n FROM ts),
g AS (SELECT p_size, count(*)::BIGINT AS terms, round(avg(1 - df / n.n::DOUBLE), 6) AS generality FROM ts JOIN df USING (term), n GROUP BY p_size)"""


def _terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", F.explode(T.term_set(F.array("p_brand"), F.split("p_type", " "))).alias("term"))
    return part.distinct()


def _generality(terms):
    df, n = terms.groupBy("term").agg(F.count("*").alias("df")), terms.agg(F.countDistinct("p_size").alias("n"))
    return terms.join(df, "term").crossJoin(F.broadcast(n)).groupBy("p_size").agg(F.count("*").alias("terms"), F.round(F.avg(1 - F.col("df") / F.col("n")), 6).alias("generality"))


@query(f"WITH {_TERMS} SELECT * FROM g")
def term_generality(spark, sf_dir):
    return _generality(_terms(spark, sf_dir))


_JACCARD = f"""{_TERMS}, i AS (SELECT a.p_size AS a, b.p_size AS b, count(*) AS shared FROM ts a JOIN ts b ON a.term = b.term AND a.p_size != b.p_size GROUP BY ALL),
j AS (SELECT i.a, i.b, round(shared / (x.terms + y.terms - shared)::DOUBLE, 6) AS overlap FROM i JOIN g x ON x.p_size = i.a JOIN g y ON y.p_size = i.b)"""


def _clusters(terms):
    return terms.withColumnRenamed("p_size", "cluster_id")


@query(f"WITH {_JACCARD} SELECT a, b, overlap FROM j WHERE a < b AND overlap >= 0.25")
def jaccard_pairs(spark, sf_dir):
    return taxonomy.overlaps(_clusters(_terms(spark, sf_dir)), 0.25)


@query(f"""WITH {_JACCARD}, e AS (SELECT j.*, row_number() OVER (PARTITION BY b ORDER BY overlap DESC, a)::BIGINT AS rank FROM j JOIN g x ON x.p_size = a JOIN g y ON y.p_size = b WHERE overlap >= 0.4 AND y.terms >= 3 AND round(y.generality - x.generality, 6) >= 0.01)
SELECT a AS parent, b AS child, overlap, rank FROM e WHERE rank <= 2""")
def taxonomy_parent_edges(spark, sf_dir):
    """Parents by terms alone: all clusters count as similar; the gap is small as terms are few."""
    terms = _clusters(_terms(spark, sf_dir))
    pairs = taxonomy.overlaps(terms, 0.4)
    edges = taxonomy.parents(pairs, pairs.select("a", "b", F.lit(1.0).alias("similarity")), taxonomy.generality(terms), gap=0.01)
    return edges.select(F.col("source").alias("parent"), F.col("target").alias("child"), "overlap", "rank")


@query("""WITH r AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), e.vec_id) AS rank, q.label = e.label AS rel, count(*) FILTER (WHERE q.label = e.label) OVER (PARTITION BY q.vec_id) AS n_rel
FROM embeddings q JOIN embeddings e ON e.vec_id != q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, round(CASE WHEN max(n_rel) = 0 THEN 0.0 ELSE sum(CASE WHEN rel THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank <= 5) / max(n_rel) END, 6) AS recall5,
round(CASE WHEN max(n_rel) = 0 THEN 0.0 ELSE coalesce(sum(CASE WHEN rel THEN 1 / log2(rank + 1) END) FILTER (WHERE rank <= 5), 0) / list_sum(list_transform(range(1, least(max(n_rel), 5) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg5, round(coalesce(1.0 / min(rank) FILTER (WHERE rel), 0), 6) AS rr FROM r GROUP BY query_id""")
def retrieval_recall_ndcg_mrr(spark, sf_dir):
    """Relevant: the other members of the query's cluster."""
    vecs = table(spark, sf_dir, "embeddings")
    found = retrieval.searched(vecs, _asked(vecs, F.col("label").alias("own")), "vec_id", "embedding", "label", 5)
    return found.select("query_id", F.col("recall").alias("recall5"), F.col("ndcg").alias("ndcg5"), "rr")


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS cached_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings c ON c.vec_id % 2 = 0 WHERE q.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cached_id) AS rn FROM s) SELECT query_id, cached_id, similarity, similarity >= 0.95 AS hit FROM k WHERE rn = 1""")
def semantic_cache_lookup(spark, sf_dir):
    """Odd ids ask, all even ids are the cache; questions go in blocks."""
    vecs = table(spark, sf_dir, "embeddings")
    cache = vecs.where("vec_id % 2 = 0").select(F.col("vec_id").alias("cached_id"), V.as_double(F.col("embedding")).alias("c"))
    asked = vecs.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), V.as_double(F.col("embedding")).alias("q"))
    return retrieval.cache_lookup(asked, cache, "query_id", "q").select("query_id", "cached_id", "similarity", "hit")


@query("""WITH pos AS (SELECT embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id <= 5), neg AS (SELECT embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id BETWEEN 6 AND 10)
SELECT vec_id, round((SELECT max(list_cosine_similarity(e.embedding::DOUBLE[], p)) FROM pos) - (SELECT max(list_cosine_similarity(e.embedding::DOUBLE[], p)) FROM neg), 6) AS margin FROM embeddings e WHERE vec_id > 10""")
def radar_margin(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    one = lambda cond, name: F.broadcast(vecs.where(cond).agg(F.collect_list("v").alias(name)))
    best = lambda name: F.array_max(F.transform(name, lambda p: V.cosine(F.col("v"), p)))
    rest = vecs.where("vec_id > 10").crossJoin(one("vec_id <= 5", "pos")).crossJoin(one("vec_id between 6 and 10", "neg"))
    return rest.select("vec_id", F.round(best("pos") - best("neg"), 6).alias("margin"))


@query("""WITH e AS (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-17') AS previous, count(*) AS total FROM events GROUP BY user_id)
SELECT user_id, recent::BIGINT AS recent, previous::BIGINT AS previous, round(recent / greatest(total, 1)::DOUBLE, 6) AS confidence FROM e WHERE recent >= 3 AND previous <= 14""")
def emerging_themes(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("ts") >= at("2024-01-24")).alias("recent"), F.count_if((F.col("ts") < at("2024-01-24")) & (F.col("ts") >= at("2024-01-17"))).alias("previous"), F.count("*").alias("total"))
    return e.where("recent >= 3 and previous <= 14").select("user_id", "recent", "previous", F.round(F.col("recent") / F.greatest("total", F.lit(1)), 6).alias("confidence"))


@query("SELECT c_custkey, 1.0::DOUBLE AS confidence FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def orphan_clusters(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", F.lit(1.0).alias("confidence"))


@query(f"""WITH {_PAIRS}, s AS (SELECT c.label, (c.label % 3) - 1.0 AS polarity, c.centroid FROM c)
SELECT p.a, p.b, round(least(1.0, p.similarity * abs(x.polarity - y.polarity)), 6) AS confidence, round(list_sum(list_transform(list_zip(x.centroid, y.centroid), lambda z: (z[1] + z[2]) / 2)), 5) AS middle
FROM p JOIN s x ON x.label = p.a JOIN s y ON y.label = p.b WHERE p.a < p.b AND p.similarity >= -0.1 AND abs(x.polarity - y.polarity) >= 0.5 AND x.polarity * y.polarity < 0""")
def contradictions(spark, sf_dir):
    """Polarity stands in by cluster number; thresholds fit the invented vectors."""
    c = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("polarity", F.col("label") % 3 - 1.0)
    a, b = (c.select(F.col("label").alias(k), F.col("centroid").alias(f"v{k}"), F.col("polarity").alias(f"p{k}")) for k in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("similarity", F.round(V.cosine(F.col("va"), F.col("vb")), 6)).where("similarity >= -0.1 and abs(pa - pb) >= 0.5 and pa * pb < 0")
    return pairs.select("a", "b", F.round(F.least(F.lit(1.0), F.col("similarity") * F.abs(F.col("pa") - F.col("pb"))), 6).alias("confidence"), F.round(F.aggregate(V.midpoint(F.col("va"), F.col("vb")), F.lit(0.0), lambda s, x: s + x), 5).alias("middle"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH w AS (SELECT label, vec_id, regexp_extract_all(lower(text), '[a-z][a-z0-9-]+') AS ws FROM embeddings JOIN documents ON doc_id = vec_id), t AS (SELECT label, vec_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w),
c AS (SELECT label, term, count(*)::BIGINT AS n, min(vec_id * 100000000 + pos) AS first FROM t WHERE length(term) > 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT label, term, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, first)::BIGINT AS rank FROM c) SELECT label, term, n, rank FROM k WHERE rank <= 5""")
def keyword_top5(spark, sf_dir):
    """The notes of a cluster are read in the order of their ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.keywords(docs, "label", "vec_id", "text", 5)
