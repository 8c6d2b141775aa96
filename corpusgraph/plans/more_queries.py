"""Queries on cleaning, chunk positions, evaluation, parsing, graphs and detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import identity as I
from corpusgraph.functions import text as T
from corpusgraph.functions import vectors as V
from corpusgraph.operators import chunking, clusters, detect, ingest, retrieval, search
from corpusgraph.operators.ranking import top_per_group
from corpusgraph.plans import query
from corpusgraph.session import ship, table
from corpusgraph.streaming import debounce
from corpusgraph.streaming.loops import run_stream


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|$)', chr(10), 'g'), '(?is)<script\b[^>]*>.*?(</script>|$)', chr(10), 'g'), '(?is)<style\b[^>]*>.*?(</style>|$)', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(t, '<[!/]?[A-Za-z][^<>]*>', chr(10), 'g') || ' ', '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '\?\S+', '', 'g'), 'utm_\S+', '', 'g'), '&[a-z]+;', ' ', 'g'), '&#[0-9]+;', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)\n---\n.*', ''), '(?is)best regards,.*', ''), '(?is)\ngesendet von meinem.*', ''), '(?is)(\nsent from my|sent from my ).*', '') AS t FROM c)
SELECT page_id, md5(substring(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 8000)) AS digest FROM d""")
def html_body_clean(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.mail_clean(F.col("html"))).alias("digest"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, '') || ' l O Page 12 {§} l_ Łl £5 €5 a_b [x]@#+', '[^\pL\pN_\s.,!?;:()''"€$%&/-]', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[\pL\pN_]+|[^\pL\pN_]+'), lambda w: CASE w WHEN 'l' THEN 'I' WHEN 'O' THEN '0' ELSE w END) AS w FROM a)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(w, ''), '\s+', ' ', 'g'), '(?i)page\s+[0-9]+', ' ', 'g'))) AS digest FROM b""")
def pdf_text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.scan_clean(F.concat(F.coalesce("text", F.lit("")), F.lit(" l O Page 12 {§} l_ Łl £5 €5 a_b [x]@#+")))).alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, '## ' || role || ' ' || turn || chr(10) || text || chr(10) AS part FROM conversations), t AS (SELECT conv_id, string_agg(part, '' ORDER BY turn) AS note, list(length(part) ORDER BY turn) AS sizes, list(turn ORDER BY turn) AS turns FROM s GROUP BY conv_id),
c AS (SELECT conv_id, unnest(range(0, length(note), 300)) AS pos, turns, list_transform(range(1, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i - 1]), 0)) AS starts FROM t)
SELECT conv_id, pos, turns[len(list_filter(starts, lambda x: x <= pos))] AS turn FROM c""")
def chunk_heading_asof(spark, sf_dir):
    """The heading in force where each 300-character piece of a thread begins.

    Each section lists the pieces that begin inside it, so there is neither a range join nor an array of a whole thread; the sum
    of lengths before a section is a window over the thread, whose turns are bounded by what people write.
    """
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sections = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(part).cast("long").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = (F.ceil(F.col("start") / 300) * 300).cast("long")
    inside = sections.where(first < F.col("start") + F.col("n"))
    return inside.select("conv_id", F.explode(F.sequence(first, F.col("start") + F.col("n") - 1, F.lit(300).cast("long"))).alias("pos"), F.col("turn").cast("long").alias("turn"))


@query(None)
def chunk_spans(spark, sf_dir):
    """Places of recursive chunks in their documents."""
    ship(spark)

    def place(pairs):
        import pyarrow as pa

        for batch in pairs:
            out = []
            for r, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                out += [(r, k, a, b) for k, (a, b) in enumerate(chunking.spans(text, chunking.split_recursive(text), 100) or [])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[c] for x in out], pa.int64()) for c in (1, 2, 3))], names=["doc_id", "chunk", "start", "end"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(place, "doc_id long, chunk long, start long, end long")


@query(None)
def cosine_chunks(spark, sf_dir):
    """Chunks that end where neighbouring sentences differ: hashed word vectors stand in for an embedding service."""
    ship(spark)
    return chunking.by_similarity(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(None)
def hybrid_chunks(spark, sf_dir):
    """The hybrid strategy over threads as notes with a heading for each turn: short sections whole, long ones by the semantic splitter."""
    ship(spark)
    part = F.concat(F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n"))
    notes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part")))), lambda x: x["part"]), "").alias("note"))
    return ingest.chunk(notes, "conv_id", "note", "hybrid").select("conv_id", "chunk", "text", "heading_path", "heading_level", "section_title")


@query("SELECT event_id FROM events WHERE NOT (user_id IN (3, 7, 11) AND event_id % 5 < 3 OR event_id % 5 = 1 AND event_type = '11')")
def cache_invalidate_by_cluster(spark, sf_dir):
    """Entries that stay: those whose JSON can't be read or mentions none of the clusters (in any of its three forms)."""
    n, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    result = (
        F.when(n == 0, F.concat(F.lit('{"cluster_id": '), u, F.lit("}"))).when(n == 1, F.concat(F.lit('{"cluster_ids": ["'), "event_type", F.lit('", '), u, F.lit("]}")))
        .when(n == 2, F.concat(F.lit('{"clusters": [{"x": 3}, {"cluster_id": "'), u, F.lit('"}]}'))).when(n == 3, F.concat(F.lit('{"cluster": '), u, F.lit("}"))).otherwise(F.concat(F.lit('{"cluster_id": '), u))
    )
    entries = table(spark, sf_dir, "events").select("event_id", result.alias("result_json"))
    return retrieval.invalidate(entries, "result_json", ["3", "7", "11"]).select("event_id")


_WORDS = "list_distinct(string_split_regex(lower({}), '[\\x09-\\x0D\\x20]+'))"


@query(f"""WITH q AS (SELECT item_id, {_WORDS.format("text")} AS qs FROM benchmark WHERE item_id % 20 = 0), s AS (SELECT item_id, doc_id, len(list_intersect(qs, {_WORDS.format("d.text")}))::BIGINT AS overlap FROM q, documents d),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id)::BIGINT AS rank FROM s) SELECT item_id, rank, doc_id, overlap FROM k WHERE rank <= 5""")
def keyword_overlap_retriever(spark, sf_dir):
    """The stated query set (ids divisible by 20) against all documents, in blocks."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[\x09-\x0D\x20]+"))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select("item_id", words(F.col("text")).alias("qs"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("ws"))
    scored = search.by_blocks(asked, "item_id", lambda block: docs.crossJoin(block).select("item_id", "doc_id", F.size(F.array_intersect("qs", "ws")).cast("long").alias("overlap")))
    return top_per_group(scored, ["item_id"], [F.desc("overlap"), F.col("doc_id")], 5, ["doc_id"]).select("item_id", "rank", "doc_id", "overlap")


@query("""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '[\\x09-\\x0D\\x20]+') AS ws FROM documents), s AS (SELECT unnest([100, 500]) AS size), c AS (SELECT size, ws, unnest(range(0, ((len(ws) - 1) // size) + 1)) AS k FROM w, s),
t AS (SELECT size, array_to_string(ws[k * size + 1:k * size + size], ' ') AS t FROM c) SELECT size::INTEGER AS size, count(*)::BIGINT AS chunks, round(avg(length(t)), 6) AS mean_length, round(avg(CASE WHEN regexp_matches(t, '[.!?]$') THEN 1.0 ELSE 0.0 END), 6) AS boundary FROM t GROUP BY size""")
def strategy_comparison(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = [docs.select(F.lit(n).alias("size"), F.explode(T.word_chunks(F.col("text"), n)).alias("t")) for n in (100, 500)]
    return parts[0].unionByName(parts[1]).groupBy("size").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("t")), 6).alias("mean_length"), F.round(F.avg(F.when(F.col("t").rlike(r"[.!?]\z"), 1.0).otherwise(0.0)), 6).alias("boundary"))


@query("""WITH s AS (SELECT unnest(['full', 'half']) AS strategy), v AS (SELECT strategy, vec_id, label, CASE WHEN strategy = 'full' THEN embedding ELSE embedding[1:len(embedding) // 2] END::DOUBLE[] AS x FROM s, embeddings),
r AS (SELECT q.strategy, q.vec_id AS q, row_number() OVER (PARTITION BY q.strategy, q.vec_id ORDER BY round(1 - list_cosine_similarity(q.x, e.x), 6), e.vec_id) AS rank, q.label = e.label AS rel, count(*) FILTER (WHERE q.label = e.label) OVER (PARTITION BY q.strategy, q.vec_id) AS n FROM v q JOIN v e ON e.strategy = q.strategy AND e.vec_id != q.vec_id WHERE q.vec_id % 20 = 0),
m AS (SELECT strategy, q, CASE WHEN max(n) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE rel AND rank <= 5) / max(n), 6) END AS recall, CASE WHEN max(n) = 0 THEN 0.0 ELSE round(coalesce(sum(CASE WHEN rel THEN 1 / log2(rank + 1) END) FILTER (WHERE rank <= 5), 0) / list_sum(list_transform(range(1, least(max(n), 5) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg FROM r GROUP BY ALL),
c AS (SELECT a.strategy, avg(list_cosine_similarity(a.x, b.x)) AS c FROM v a JOIN v b ON a.strategy = b.strategy AND a.vec_id < b.vec_id GROUP BY 1), b AS (SELECT avg(CASE WHEN regexp_matches(text, '[.!?][\\x09-\\x0D\\x20]*$') THEN 1.0 ELSE 0.0 END) AS b FROM documents JOIN embeddings ON vec_id = doc_id)
SELECT strategy, round(avg(recall), 5) AS recall5, round(avg(ndcg), 5) AS ndcg5, round(any_value(b), 5) AS boundary, round(any_value(c), 5) AS coherence FROM m JOIN c USING (strategy), b GROUP BY strategy""")
def strategy_retrieval(spark, sf_dir):
    """Two strategies by what they retrieve: whole vectors and their first half. The stated queries ask for the members of their cluster."""
    ship(spark)
    vecs = table(spark, sf_dir, "embeddings")
    texts = vecs.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    ends = texts.agg(F.round(F.avg(F.when(F.col("text").rlike(r"[.!?][\x09-\x0D\x20]*\z"), 1.0).otherwise(0.0)), 5).alias("boundary"))
    out = []
    for name, x in (("full", F.col("embedding")), ("half", F.slice("embedding", F.lit(1), F.expr("size(embedding) div 2")))):
        cut = vecs.select("vec_id", "label", x.alias("x"))
        asked = cut.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), V.as_double(F.col("x")).alias("q"), F.col("label").alias("own"))
        means = retrieval.searched(cut, asked, "vec_id", "x", "label", 5).agg(F.round(F.avg("recall"), 5).alias("recall5"), F.round(F.avg("ndcg"), 5).alias("ndcg5"))
        out.append(means.crossJoin(clusters.pairwise_cosine(cut, "x").select(F.round("mean", 5).alias("coherence"))).select(F.lit(name).alias("strategy"), "recall5", "ndcg5", "coherence"))
    return out[0].unionByName(out[1]).crossJoin(ends)


@query("""WITH e AS (SELECT conv_id, list(DISTINCT role) AS expected, list(DISTINCT role) FILTER (WHERE turn > 0) AS found FROM conversations GROUP BY conv_id)
SELECT conv_id, round(coalesce(len(list_intersect(expected, found)), 0) / len(expected)::DOUBLE, 6) AS score FROM e""")
def structure_preservation(spark, sf_dir):
    """Share of a thread's headings that are still found after its first turn is cut off."""
    e = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("expected"), F.collect_set(F.when(F.col("turn") > 0, F.col("role"))).alias("found"))
    return e.select("conv_id", F.round(F.size(F.array_intersect("expected", "found")) / F.size("expected"), 6).alias("score"))


@query("SELECT o_custkey, substring(sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)), 1, 12) AS set_key FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def discovery_identity(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(I.set_key(F.collect_list(F.col("o_orderkey").cast("string"))).alias("set_key"))


@query("""WITH RECURSIVE f AS (SELECT p_brand AS pattern, p_size AS job, list_sort(list_distinct(list(p_type))) AS clusters, ((2 * sum(round(p_retailprice * 100)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS confidence FROM part GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY confidence DESC, job) AS i FROM f),
r AS (SELECT pattern, job, clusters, confidence, i, [clusters] AS kept, true AS keep FROM o WHERE i = 1 UNION ALL
SELECT o.pattern, o.job, o.clusters, o.confidence, o.i, CASE WHEN k THEN list_append(kept, o.clusters) ELSE kept END, k FROM (SELECT o.*, r.kept, len(list_filter(r.kept, lambda s: len(list_intersect(s, o.clusters)) / len(list_distinct(list_concat(s, o.clusters)))::DOUBLE >= 0.8)) = 0 AS k FROM r JOIN o ON o.pattern = r.pattern AND o.i = r.i + 1) o)
SELECT pattern, job, array_to_string(clusters, ',') AS clusters, confidence FROM r WHERE keep""")
def discovery_dedup_greedy(spark, sf_dir):
    """Detections (sets of clusters) in order of confidence; one that overlaps a kept one of its type by 0.8 or more goes."""
    cents = F.sum(F.round(F.col("p_retailprice") * 100).cast("long"))
    mean = F.floor((2 * cents + F.count("*")) / (2 * F.count("*"))).cast("double") / 100  # whole cents, so that halves round alike everywhere
    found = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_type")).alias("clusters"), mean.alias("confidence"))
    found = found.select(F.col("p_brand").alias("pattern"), F.col("p_size").alias("job"), "clusters", "confidence")
    return detect.greedy_distinct(found, "pattern", "clusters", [("confidence", False), ("job", True)]).withColumn("clusters", F.array_join("clusters", ","))


_REPLY = "CASE o_orderkey % 6 WHEN 0 THEN ' Approve ' WHEN 1 THEN 'no' WHEN 2 THEN '4' WHEN 3 THEN 'in 3 weeks' WHEN 4 THEN 'none' ELSE '2 days' END"


@query(f"""WITH r AS (SELECT o_orderkey, o_orderdate, lower(trim({_REPLY})) AS r FROM orders)
SELECT o_orderkey, CASE WHEN r IN ('approve', 'approved', 'yes', 'y') THEN 'approve' WHEN r IN ('reject', 'rejected', 'no', 'n') THEN 'reject' END AS decision, coalesce(TRY_CAST(r AS INTEGER), -1) AS number,
CASE WHEN regexp_matches(r, '^(in )?[0-9]+ ?(day|week|month)') THEN o_orderdate + to_days((regexp_extract(r, '([0-9]+)', 1)::INTEGER * CASE WHEN r LIKE '%week%' THEN 7 WHEN r LIKE '%month%' THEN 30 ELSE 1 END)) END AS deadline FROM r""")
def reply_and_deadline_parse(spark, sf_dir):
    r = F.lower(F.trim(F.expr(_REPLY)))
    n = F.regexp_extract(r, "([0-9]+)", 1).try_cast("int") * F.when(r.contains("week"), 7).when(r.contains("month"), 30).otherwise(1)
    decision = F.when(r.isin("approve", "approved", "yes", "y"), "approve").when(r.isin("reject", "rejected", "no", "n"), "reject")
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"), F.coalesce(r.try_cast("int"), F.lit(-1)).alias("number"), F.when(r.rlike("^(in )?[0-9]+ ?(day|week|month)"), F.col("o_orderdate") + F.make_dt_interval(days=n)).alias("deadline"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """Users of a stream over the table, each taken in once: appended to the shared folder as they come."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    events = source.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_stream(debounce.first_seen(events, "user_id", "ts", "60 days").select("user_id"), "first-seen")
