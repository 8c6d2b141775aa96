"""Queries on ingesting, detections, messages, decisions and graphs. Columns that the tables lack are built alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import identity as I
from corpusgraph.functions import projects as P
from corpusgraph.functions import text as T
from corpusgraph.functions import vectors as V
from corpusgraph.operators import clusters, detect, gatekeeper, governance, ingest, outbox, retrieval, search, state, taxonomy, workflow
from corpusgraph.plans import query
from corpusgraph.plans.vector_queries import _DIMS, _asked
from corpusgraph.session import dealt, ship, table
from corpusgraph.streaming import loops


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- ingesting


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 200")
def scan_with_limit(spark, sf_dir):
    return ingest.scan(table(spark, sf_dir, "events"), "event_type = 'click'", 200, ["ts", "event_id"]).select("event_id", "ts")


@query("SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 7 != 0")
def vectors_present(spark, sf_dir):
    """A vector scan leaves out rows without a vector."""
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return rows.where("embedding is not null").select("vec_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE '' END AS context_header, '' AS doc_summary, length(text)::BIGINT AS n FROM documents""")
def append_chunks(spark, sf_dir):
    """Chunks of even ids have a header; missing headers and summaries are stored as empty texts."""
    d = table(spark, sf_dir, "documents")
    rows = lambda rest: d.where(F.col("doc_id") % 3 == 0 if rest else F.col("doc_id") % 3 != 0).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("context_header"), F.lit(None).cast("string").alias("doc_summary"), F.length("text").cast("long").alias("n"))
    return ingest.append_chunks(ingest.append_chunks(rows(True).limit(0), rows(True)), rows(False))


@query("""SELECT source, count(*)::BIGINT AS n, sum(new::INTEGER)::BIGINT AS fresh FROM (SELECT source, false AS new FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 11 = 0 AND source IS NOT NULL) OR lang = 'de' OR source IS NULL UNION ALL SELECT source, true FROM documents WHERE doc_id % 11 = 0) GROUP BY source""")
def replace_by_source(spark, sf_dir):
    """Sources that are read again replace their stored chunks of kind notes; those of kind mail (language de) stay."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "mail").otherwise("notes")
    stored = d.select("source", kind.alias("source_type"), F.lit(False).alias("fresh"))
    again = d.where("doc_id % 11 = 0").select("source", F.lit(True).alias("fresh"))
    return ingest.replace_source(stored, again, "source", "notes").groupBy("source").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def set_cluster_ids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return ingest.set_column(v, v.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id", "label")


@query(f"WITH {_DIMS} SELECT label AS cluster_id, size::BIGINT AS size FROM c WHERE label >= 0 UNION ALL SELECT -1, 0")
def centroids_replaced(spark, sf_dir):
    """Stored centroids of clusters go, others (id below 0) stay, and only clusters with members come."""
    new = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select(F.col("label").alias("cluster_id"), "size")
    old = spark.createDataFrame([(-1, 0), (3, 9), (99, 1)], "cluster_id int, size long")
    return clusters.replace_centroids(old, new)


@query("SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-20')::BIGINT AS removed FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def checkpoint_cleanup_counted(spark, sf_dir):
    kept, gone = retrieval.Checkpoints(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts").cleanup(_at("2024-01-20"))
    return kept.log.agg(F.count("*").alias("n")).crossJoin(gone)


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id FROM events UNION ALL SELECT user_id, 1000000000 + user_id FROM events WHERE user_id % 5 = 0) WHERE user_id % 7 != 0 GROUP BY user_id")
def checkpoints_saved_and_deleted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    more = e.where("user_id % 5 = 0").select("user_id", (F.col("user_id") + 1_000_000_000).alias("event_id"), "ts")
    return retrieval.Checkpoints(e, "user_id", "event_id", "ts").save(more).delete(e.where("user_id % 7 = 0")).load().select("user_id", "event_id")


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IS NULL OR lang != 'de' GROUP BY lang")
def reset_rows(spark, sf_dir):
    """The one step of a reset that deletes the rows of a kind."""
    return ingest.clear(table(spark, sf_dir, "documents").withColumn("type", F.col("lang")), "delete_rows", "de").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE NOT (page_id % 4 != 0 AND page_id % 5 != 0)")
def files_to_read(spark, sf_dir):
    """Files whose time or size differs from their state: every fourth has another time, every fifth another size."""
    k = F.col("page_id")
    files = table(spark, sf_dir, "pages").select("page_id", k.cast("string").alias("path"), (k * 10).alias("modified"), F.length("html").cast("long").alias("size"))
    known = files.select("path", F.when(k % 4 == 0, F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"), F.when(k % 5 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    return ingest.plan(files, known, "once")[0].select("page_id")


@query("""WITH r AS (SELECT doc_id, doc_id % 10 AS file, doc_id % 37 != 0 AS ok FROM documents), w AS (SELECT file, bool_and(ok) AS done FROM r GROUP BY file) SELECT 'notes' AS kind, file, count(*)::BIGINT AS n, bool_and(done) AS done FROM r JOIN w USING (file) WHERE ok GROUP BY file UNION ALL SELECT 'mail', file, count(*)::BIGINT, true FROM r JOIN w USING (file) WHERE done GROUP BY file""")
def commit_complete_files(spark, sf_dir):
    """Ten files whose rows can fail: of notes the good rows are stored, of mail all or none; a file is done if no row failed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("file"), (F.col("doc_id") % 37 != 0).alias("ok"))
    out = None
    for kind, partial in (("notes", True), ("mail", False)):
        stored, done = loops.commit_complete(rows, "file", "ok", partial)
        part = stored.groupBy("file").agg(F.count("*").alias("n")).join(done.withColumn("done", F.lit(True)), "file", "left").select(F.lit(kind).alias("kind"), "file", "n", F.coalesce("done", F.lit(False)).alias("done"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT conv_id, pos, turn FROM (SELECT c.conv_id, c.pos, s.turn, row_number() OVER (PARTITION BY c.conv_id, c.pos ORDER BY s.start DESC) AS k FROM (SELECT conv_id, unnest(range(0, total, 250)) AS pos FROM (SELECT conv_id, sum(length(text) + length(repeat('#', (1 + turn % 3)::INTEGER) || ' ' || turn) + 2)::BIGINT AS total FROM conversations GROUP BY conv_id)) c
JOIN (SELECT conv_id, turn, coalesce(sum(length(text) + length(repeat('#', (1 + turn % 3)::INTEGER) || ' ' || turn) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations) s ON s.conv_id = c.conv_id AND s.start <= c.pos) WHERE k = 1""")
def chunk_heading_deepest(spark, sf_dir):
    """The heading that holds each place of a note, found by search among the note's headings, of three ranks."""
    import pyarrow as pa

    ship(spark)
    part = F.concat(F.repeat(F.lit("#"), (1 + F.col("turn") % 3).cast("int")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", "#", "_"), F.lit("\n"))
    notes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda s: s["p"]), "").alias("note"))

    def place(batches):
        for batch in batches:
            rows = []
            for r, t in enumerate(batch.column(1)):
                note = t.as_py() or ""
                heads = ingest.Headings(note)
                rows += [(r, at, int(h["title"])) for at in range(0, len(note), 250) if (h := heads.at(at))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())], names=["conv_id", "pos", "turn"])

    return notes.mapInArrow(place, "conv_id long, pos long, turn long")


@query(None)
def structured_chunks(spark, sf_dir):
    """Recursive chunks with the heading that each begins under."""
    ship(spark)
    part = F.concat(F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n"))
    notes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda s: s["p"]), "").alias("note"))
    return ingest.chunk(notes, "conv_id", "note", "recursive")


@query(None)
def semantic_chunks(spark, sf_dir):
    """Chunks at paragraph breaks and length limits: what the semantic splitter does without a model's word."""
    ship(spark)
    return ingest.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "semantic").select("doc_id", "chunk", "text")


@query("""WITH d AS (SELECT lang, text, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id), p AS (SELECT a.lang, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM (SELECT lang, vec_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id) a JOIN (SELECT lang, vec_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id) b ON a.lang IS NOT DISTINCT FROM b.lang AND a.vec_id < b.vec_id GROUP BY 1)
SELECT d.lang, round(avg(length(text)), 6) AS mean, count(*)::BIGINT AS n, round(stddev_pop(length(text)), 6) AS deviation, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest, round(avg(CASE WHEN regexp_matches(text, '[.!?][\\x09-\\x0D\\x20]*$') THEN 1.0 ELSE 0.0 END), 6) AS boundary, coalesce(round(any_value(c), 6), 0) AS coherence FROM d LEFT JOIN p ON p.lang IS NOT DISTINCT FROM d.lang GROUP BY d.lang""")
def chunk_quality(spark, sf_dir):
    """Documents are chunks, their languages groups; about half of them have a vector."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return ingest.quality(docs, "lang", "text", "embedding")


@query("""WITH e AS (SELECT DISTINCT conv_id, role AS heading FROM conversations), f AS (SELECT DISTINCT conv_id, role AS heading FROM conversations WHERE turn % 2 = 0), p AS (SELECT e.conv_id, round(avg(CASE WHEN f.heading IS NULL THEN 0.0 ELSE 1.0 END), 6) AS preserved FROM e LEFT JOIN f USING (conv_id, heading) GROUP BY 1),
d AS (SELECT conv_id, round(avg(CASE WHEN turn % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS depth FROM conversations WHERE turn % 2 = 0 GROUP BY 1) SELECT conv_id, coalesce(preserved, 1.0)::DOUBLE AS preserved, coalesce(depth, 1.0)::DOUBLE AS depth FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id) LEFT JOIN d USING (conv_id)""")
def structure_quality(spark, sf_dir):
    """Even turns keep their heading paths; the level of every fourth is wrong."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    chunks = c.select("conv_id", F.when(t % 2 == 0, F.concat(F.lit("# All > ## "), "role")).otherwise("").alias("heading_path"), F.when(t % 4 == 0, 1).otherwise(2).alias("heading_level"))
    return ingest.preservation(chunks, c.select("conv_id", F.col("role").alias("heading")), "conv_id")


@query("""SELECT doc_id, 'src-' || coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, 2::BIGINT AS n FROM documents""")
def metadata_merged(spark, sf_dir):
    """A source set over a map of metadata that has another one."""
    m = ingest.merge_metadata(F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("none")), F.lit("source"), F.lit("old")), F.concat(F.lit("src-"), F.coalesce("source", F.lit("none"))))
    return table(spark, sf_dir, "documents").select("doc_id", m["source"].alias("source"), m["lang"].alias("lang"), F.size(m).cast("long").alias("n"))


@query("""SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'tags: [' || lang || ', new]' || chr(10) || '---' || chr(10) || 'body' AS note FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT doc_id, '---' || chr(10) || 'tags: [' || lang || ', new]' || chr(10) || '---' || chr(10) || 'body' FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 1""")
def tags_rewritten(spark, sf_dir):
    """Notes with and without front matter get new tags."""
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\ntags: [old]\n---\nbody"))).otherwise("body")
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", P.with_tags(old, F.array("lang", F.lit("new"))).alias("note"))


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def rows_deleted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return state.delete_keys(d, d.where("lang not in ('en', 'de')"), ["lang"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS c_custkey, max(c_name) AS c_name, bool_or(c_custkey IS NOT NULL) AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 GROUP BY 1""")
def point_lookups(spark, sf_dir):
    """Fields and existence by key; odd customers don't exist."""
    return ingest.lookup(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", ["c_name"])


@query("""SELECT c_custkey, CASE WHEN l IS NULL THEN 'open' ELSE l END AS status, CASE WHEN l IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey, o_orderstatus)) AS l FROM orders WHERE o_orderstatus != 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def statuses_set(spark, sf_dir):
    """The last of a customer's changes sets its status and time."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.lit("open").alias("status"), _at("2024-01-01").alias("updated_at"))
    changes = table(spark, sf_dir, "orders").where("o_orderstatus != 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return ingest.set_status(t, changes, "c_custkey", _at("2024-02-01"))


# ---- detections


def _stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    split, before = _at("2024-01-24"), _at("2024-01-17")
    return e.groupBy(F.col("user_id").cast("string").alias("cluster_id")).agg(F.count_if(F.col("ts") >= split).alias("recent"), F.count_if((F.col("ts") < split) & (F.col("ts") >= before)).alias("previous"), F.count("*").alias("total"))


@query("""WITH e AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-17') AS previous, count(*) AS total FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS cluster_id, round(recent / total, 6) AS confidence, previous::DOUBLE AS previous_notes FROM e WHERE recent >= 3 AND previous <= 14 AND user_id % 2 = 0""")
def emerging_detections(spark, sf_dir):
    """Clusters are users, of whom the even ones have a representation; previous events are many here, so 14 are allowed."""
    stats = _stats(spark, sf_dir)
    found = detect.emerging(stats, stats.where("cast(cluster_id as long) % 2 = 0"), max_previous=14)
    return found.select(F.col("cluster_ids")[0].alias("cluster_id"), "confidence", F.get_json_object("signals", "$.previous_notes").cast("double").alias("previous_notes"))


@query("""SELECT c_custkey::VARCHAR AS cluster_id, coalesce(n, 0)::DOUBLE AS neighbor_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) < 2 AND c_custkey % 3 != 0""")
def orphan_detections(spark, sf_dir):
    """Clusters are customers, neighbours their orders of status P; two are asked for."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cluster_id"))
    links = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("cluster_id"), F.col("o_orderkey").alias("neighbor"))
    found = detect.orphans(ids, links, ids.where("cast(cluster_id as long) % 3 != 0"), 2)
    return found.select(F.col("cluster_ids")[0].alias("cluster_id"), F.get_json_object("signals", "$.neighbor_count").cast("double").alias("neighbor_count"))


def _reps(spark, sf_dir):
    c = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select(F.col("label").cast("string").alias("cluster_id"), F.col("centroid").alias("embedding"), (F.col("label") % 3 - 1.0).alias("polarity"))


@query(f"""WITH {_DIMS}, r AS (SELECT label::VARCHAR AS id, centroid, label % 3 - 1.0 AS p FROM c), j AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.centroid, y.centroid), 6) AS s, x.p AS pa, y.p AS pb FROM r x JOIN r y ON x.id < y.id)
SELECT a, b, round(least(1.0, s * abs(pa - pb)), 6) AS confidence, pa::DOUBLE AS polarity_left FROM j WHERE s >= -0.1 AND abs(pa - pb) >= 0.5 AND pa * pb < 0""")
def contradiction_detections(spark, sf_dir):
    """Polarity stands in by cluster number; the invented centroids are nearly at right angles, so similarity may be below 0."""
    found = detect.contradictions(_reps(spark, sf_dir), similar=-0.1)
    return found.select(F.col("cluster_ids")[0].alias("a"), F.col("cluster_ids")[1].alias("b"), "confidence", F.get_json_object("signals", "$.polarity_left").cast("double").alias("polarity_left"))


def _prototypes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").select(V.as_double(F.col("embedding")).alias("v")).collect()
    return [list(r["v"]) for r in rows[:4]], [list(r["v"]) for r in rows[4:]]


_PROTOTYPES = """proto AS (SELECT vec_id, embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id < 8)"""


@query(f"""WITH {_PROTOTYPES}, s AS (SELECT e.label, e.vec_id, round(max(list_cosine_similarity(e.embedding::DOUBLE[], p)) FILTER (proto.vec_id < 4), 6) AS up, round(max(list_cosine_similarity(e.embedding::DOUBLE[], p)) FILTER (proto.vec_id < 4) - max(list_cosine_similarity(e.embedding::DOUBLE[], p)) FILTER (proto.vec_id >= 4), 6) AS m FROM embeddings e, proto GROUP BY ALL),
b AS (SELECT label, max(m) AS confidence, arg_max(up, (m, -vec_id)) AS positive_max, count(*)::DOUBLE AS rep_count FROM s GROUP BY label) SELECT label::VARCHAR AS cluster_id, confidence, positive_max, rep_count, substring(sha256(label::VARCHAR), 1, 12) AS candidate_key FROM b WHERE confidence >= 0.05""")
def project_candidates(spark, sf_dir):
    """All members of a cluster are its representatives here, ranked by id."""
    reps = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("cluster_id"), F.col("vec_id").alias("rank"), V.as_double(F.col("embedding")).alias("embedding"))
    found = detect.project_candidates(reps, "project", *_prototypes(spark, sf_dir))
    at = lambda k: F.get_json_object("signals", f"$.{k}").cast("double").alias(k)
    return found.select(F.col("cluster_ids")[0].alias("cluster_id"), "confidence", at("positive_max"), at("rep_count"), "candidate_key")


@query(f"""WITH {_DIMS}, {_PROTOTYPES}, s AS (SELECT c.label, round(max(list_cosine_similarity(centroid, p)) FILTER (vec_id < 4) - max(list_cosine_similarity(centroid, p)) FILTER (vec_id >= 4), 6) AS m FROM c, proto GROUP BY 1) SELECT label::VARCHAR AS cluster_id, m AS confidence, 'topic:' || substring(sha256(label::VARCHAR), 1, 12) AS discovery_id FROM s WHERE m >= 0.01""")
def radar_detections(spark, sf_dir):
    found = detect.radar(_reps(spark, sf_dir), "topic", *_prototypes(spark, sf_dir), threshold=0.01)
    return found.select(F.col("cluster_ids")[0].alias("cluster_id"), "confidence", "discovery_id")


@query("""WITH e AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-17') AS previous FROM events GROUP BY 1) SELECT 'run-1' AS run_id, (SELECT count(*) FROM e)::BIGINT AS clusters, count(*) FILTER (recent >= 3 AND previous <= 14)::BIGINT AS emerging, count(*) FILTER (user_id % 4 != 0)::BIGINT AS orphan, 'Run exceeded performance target (70.50s > 60.0s)' AS errors FROM e""")
def scout_run_summary(spark, sf_dir):
    """What one run found: emerging clusters, and orphans where every fourth cluster has a neighbour."""
    stats = _stats(spark, sf_dir)
    ids = stats.select("cluster_id")
    links = ids.where("cast(cluster_id as long) % 4 = 0").withColumn("neighbor", F.lit("x"))
    found = detect.all_found(detect.emerging(stats, ids, max_previous=14), detect.orphans(ids, links, ids))
    s = detect.run_summary(found, "run-1", ids.count(), 70.5, target=60.0)
    return s.select("run_id", F.col("clusters_analyzed").alias("clusters"), F.col("detections_by_type")["emerging_theme"].alias("emerging"), F.col("detections_by_type")["orphan"].alias("orphan"), F.array_join("errors", "; ").alias("errors"))


@query("""SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey % 5 != 0)::BIGINT AS stored, (SELECT count(*) FROM customer)::BIGINT * 2 - (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey % 5 != 0)::BIGINT AS skipped, (SELECT count(*) FROM customer)::BIGINT AS kept""")
def detections_stored(spark, sf_dir):
    """Every detection comes twice, and every fifth is stored already: each set is stored once."""
    ship(spark)
    one = F.array(F.col("c_custkey").cast("string")).alias("cluster_ids")
    c = table(spark, sf_dir, "customer")
    found = c.select(F.lit("k").alias("concept_key"), F.lit("orphan").alias("pattern_type"), one, (F.col("c_custkey") % 10 / 10).alias("confidence"), F.lit("{}").alias("signals"))
    before = found.where("cast(cluster_ids[0] as long) % 5 = 0").withColumn("run_id", F.lit("run-0"))
    after, counts = detect.store(detect.all_found(found, found), before, "run-1")
    return counts.crossJoin(after.agg(F.count("*").alias("kept")))


@query("""SELECT o_orderkey, o_totalprice AS confidence FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 9 != 0 AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def wanted_discoveries(spark, sf_dir):
    """The 25 best project candidates (orders of status F); every ninth has no id."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.when(k % 9 != 0, F.lpad(k.cast("string"), 12, "0")).alias("discovery_id"), F.lit("c").alias("candidate_key"), F.when(F.col("o_orderstatus") == "F", "project_candidate").otherwise("other").alias("pattern_type"), F.col("o_totalprice").alias("confidence"))
    return detect.wanted(d, 1000.0, 25).select(F.col("discovery_id").cast("long").alias("o_orderkey"), "confidence")


@query("SELECT label::VARCHAR AS cluster_id FROM embeddings GROUP BY label ORDER BY label::VARCHAR LIMIT 7")
def cluster_ids_as_text(spark, sf_dir):
    """The first seven cluster ids in the order of their text."""
    return detect.cluster_ids(table(spark, sf_dir, "embeddings"), "label", 7)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN '1|x' WHEN 2 THEN '' ELSE '[1|2' END AS members FROM orders""")
def cluster_sets_parsed(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN ' a, b ,,' WHEN 1 THEN '[1, "x"]' WHEN 3 THEN '[1, 2' END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(detect.cluster_set(raw), "|").alias("members"))


@query("""SELECT c_custkey::VARCHAR AS cluster_id, c_name AS theme FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0""")
def chosen_profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("cluster_id", F.col("c_custkey").cast("string"))
    return detect.with_profiles(c.where("c_custkey % 3 = 0"), c.select("cluster_id", F.col("c_name").alias("theme"), F.col("c_mktsegment").alias("source")), "BUILDING").select("cluster_id", "theme")


@query("""WITH e AS (SELECT user_id, max(ts) AS last, round(sum(value), 2) AS s FROM events GROUP BY 1), o AS (SELECT user_id, CASE WHEN NOT (s > 500) THEN 'unchanged' WHEN user_id % 4 = 3 THEN 'failed' WHEN user_id % 5 = 0 THEN 'skipped' ELSE 'updated' END AS o FROM e)
SELECT count(*)::BIGINT AS total, count(*) FILTER (o != 'unchanged')::BIGINT AS changed, count(*) FILTER (o = 'updated')::BIGINT AS processed, count(*) FILTER (o = 'skipped')::BIGINT AS skipped, count(*) FILTER (o = 'updated')::BIGINT AS profile_updates, count(*) FILTER (o = 'updated')::BIGINT AS graph_updates, count(*) FILTER (o = 'updated' AND user_id % 2 = 0)::BIGINT AS cache_invalidations, count(*) FILTER (o = 'failed')::BIGINT AS failed FROM o""")
def delta_run(spark, sf_dir):
    """One run of the delta sync: what changed, was updated, and how many cached answers went; each even cluster has one."""
    u = F.col("user_id")
    digest = F.sha2(u.cast("string"), 256)
    snapshots = table(spark, sf_dir, "events").groupBy("user_id").agg((F.round(F.sum("value"), 2) > 500).alias("changed"))
    outcomes = snapshots.select(u.cast("string").alias("cluster_id"), workflow.delta_outcome(F.col("changed"), u % 4, F.when(u % 5 == 0, digest), digest).alias("outcome"))
    cache = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(u.cast("string").alias("cluster_id")).distinct().select("cluster_id", F.to_json(F.struct("cluster_id")).alias("result_json"))
    return workflow.delta_counts(outcomes, cache)


# ---- routing, replies, decisions


@query("""WITH s AS (SELECT q.vec_id, max(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)) AS s FROM embeddings q JOIN embeddings c ON c.vec_id % 2 = 0 WHERE q.vec_id % 20 = 0 OR q.vec_id % 20 = 1 GROUP BY 1), t AS (SELECT vec_id, s, CASE vec_id % 3 WHEN 0 THEN 'latest ' WHEN 1 THEN 'status ' ELSE 'x ' END AS q FROM s)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN s >= 0.95 THEN 'cache' WHEN q = 'latest ' THEN 'web' WHEN q = 'status ' THEN 'projects' ELSE 'archive' END AS route, CASE WHEN vec_id % 7 = 0 THEN 'query not provided' END AS error FROM t""")
def route_or_cache(spark, sf_dir):
    """Cached are the even ids; of the queries some are cached, the others go by their words, and every seventh has none."""
    vecs, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    asked = vecs.where((k % 20 == 0) | (k % 20 == 1)).select("vec_id", V.as_double(F.col("embedding")).alias("q"))
    cache = vecs.where(k % 2 == 0).select(k.alias("cached_id"), V.as_double(F.col("embedding")).alias("c"))
    text = F.when(k % 7 != 0, F.when(k % 3 == 0, "Latest thing").when(k % 3 == 1, "my STATUS").otherwise("some x"))
    return retrieval.route(retrieval.cache_lookup(asked, cache, "vec_id", "q"), text).select("vec_id", "route", "error")


@query("""SELECT sha256(lower(trim(event_type))) AS query_hash, (1 + count(*) FILTER (event_id % 2 = 1))::BIGINT AS access_count, coalesce(arg_max(event_id::VARCHAR, (ts, event_id::VARCHAR)) FILTER (event_id % 2 = 1), '0') AS result FROM events GROUP BY event_type""")
def cache_results_stored(spark, sf_dir):
    """Results of odd events go into a cache that has an entry for each kind of event."""
    e = table(spark, sf_dir, "events")
    hashed = I.query_key(F.concat(F.lit(" "), F.upper("event_type"))).alias("query_hash")
    cache = e.select("event_type").distinct().select(hashed, F.lit("0").alias("result"), F.lit(1).cast("long").alias("access_count"), _at("2023-01-01").alias("at"))
    results = e.where("event_id % 2 = 1").select(hashed, F.col("event_id").cast("string").alias("result"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return retrieval.store_results(cache, results).select("query_hash", "access_count", "result")


@query("""SELECT conv_id, s.k::INTEGER AS step, s.n AS current_node, '{"done":[' || array_to_string(['"semantic_extraction"', '"search"', '"synthesis"'][1:s.k + 1], ',') || '],"current_node":"' || s.n || '"}' AS state_json FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 'semantic_extraction'), (1, 'search'), (2, 'synthesis')) s(k, n)""")
def research_checkpoints(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("at", _at("2024-01-01"))
    return retrieval.research_log(runs, "conv_id", "at").select("conv_id", "step", "current_node", "state_json")


def _messages(spark, sf_dir):
    """Messages from events: users are chats, every third event waits for an answer, and its place in the chat is its id."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("message_id"), F.col("user_id").alias("chat_id"), k.alias("place"), (k % 3 == 0).alias("expects_response"), F.when(k % 3 == 0, "awaiting_response").otherwise("delivered").alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("project:"), k.cast("string"))).otherwise(F.concat(F.lit("discovery:d"), k.cast("string"))).alias("context_id"), F.when(k % 4 == 0, "importance").otherwise("description").alias("question"),
    )


@query("""WITH m AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'project:' || event_id ELSE 'discovery:d' || event_id END AS context_id FROM events WHERE event_id % 3 = 0), l AS (SELECT user_id, min(event_id) AS event_id, min(context_id) AS context_id FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT e.event_id AS reply_id, m.event_id AS message_id, m.context_id FROM events e JOIN m ON m.user_id = e.user_id AND m.event_id = e.event_id WHERE e.event_id % 2 = 0 UNION ALL SELECT e.event_id, l.event_id, l.context_id FROM events e JOIN l USING (user_id) WHERE e.event_id % 2 = 1""")
def reply_routing(spark, sf_dir):
    """Even events reply to the message of their own id, odd ones to none: those belong to the chat's only open question."""
    k = F.col("event_id")
    replies = table(spark, sf_dir, "events").select(k.alias("reply_id"), F.col("user_id").alias("chat_id"), F.when(k % 2 == 0, k).alias("reply_to"))
    return outbox.asked_by(replies, _messages(spark, sf_dir)).select("reply_id", "message_id", "context_id")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN NULL ELSE 'project' END ELSE CASE WHEN event_id % 5 IN (0, 1) THEN 'gatekeeper' END END AS target, CASE WHEN event_id % 2 = 0 AND event_id % 8 != 0 THEN CASE WHEN event_id % 4 = 0 THEN 'importance' ELSE 'description' END WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 'approve' WHEN event_id % 2 = 1 AND event_id % 5 = 1 THEN 'reject' END AS action,
CASE WHEN event_id % 2 = 0 AND event_id % 8 != 0 THEN CASE WHEN event_id % 4 = 0 THEN '4' ELSE 'more' END END AS answer FROM events""")
def reply_dispatch(spark, sf_dir):
    """What answers do: decisions go to the gatekeeper, values to a project's field, if they fit the question."""
    k = F.col("event_id")
    text = F.when(k % 2 == 1, F.when(k % 5 == 0, " Approved").when(k % 5 == 1, "NO ").otherwise("maybe")).otherwise(F.when(k % 8 == 0, "9").when(k % 4 == 0, " 4").otherwise(" more "))
    d = outbox.dispatch(F.col("context_id"), F.col("question"), text)
    return _messages(spark, sf_dir).withColumn("event_id", F.col("message_id")).select("event_id", d["target"].alias("target"), d["action"].alias("action"), d["value"].alias("answer"))


@query("""SELECT why, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_type NOT IN ('question', 'view') THEN 'invalid message_type' WHEN event_id % 3 = 1 THEN 'originating_agent must be project_manager' WHEN event_id % 5 = 0 THEN 'payload cannot be empty' ELSE 'ok' END AS why FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'question' ELSE event_type END AS event_type FROM events)) GROUP BY 1""".replace("NOT IN ('question', 'view')", "NOT IN ('question')"))
def enqueue_checks(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "question").otherwise(F.col("event_type"))
    why = outbox.invalid(kind, F.when(k % 5 == 0, "{}").otherwise('{"text": "x"}'), F.when(k % 3 == 0, "project_manager").when(k % 3 == 1, "monitor"))
    return table(spark, sf_dir, "events").groupBy(F.coalesce(why, F.lit("ok")).alias("why")).agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT user_id)::BIGINT AS n, count(DISTINCT user_id) FILTER (user_id % 2 = 0)::BIGINT AS named FROM events WHERE event_type = 'click'""")
def messages_enqueued(spark, sf_dir):
    """A message that comes again is queued once; those of odd users get ids of what they say."""
    u = F.col("user_id").cast("string")
    m = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("m"), u)).alias("message_id"), F.lit("question").alias("message_type"), F.lit("project_manager").alias("originating_agent"), F.concat(F.lit("project:"), u).alias("context_id"), F.to_json(F.struct(u.alias("user"))).alias("payload"))
    return outbox.enqueue(m.limit(0), m, ["payload"]).agg(F.count("*").alias("n"), F.count_if(F.col("message_id").startswith("m")).alias("named"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ['delivered', 'error', 'response', 'requeue'][event_id % 4 + 1] AS e, event_id % 2 = 0 AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS attempts FROM events UNION ALL SELECT e.user_id, e.i, CASE WHEN status = 'pending' AND e = 'delivered' THEN CASE WHEN w THEN 'awaiting_response' ELSE 'delivered' END WHEN status = 'pending' AND e = 'error' THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN status = 'awaiting_response' AND e = 'response' THEN 'delivered' WHEN status = 'failed' AND e = 'requeue' THEN 'pending' ELSE status END,
CASE WHEN status = 'pending' AND e = 'error' THEN attempts + 1 WHEN status = 'failed' AND e = 'requeue' THEN 0 ELSE attempts END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, arg_max(status, i) AS status, arg_max(attempts, i) AS attempts FROM r GROUP BY 1""")
def outbox_folded(spark, sf_dir):
    """A message for each user; its events in their order."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["delivered", "error", "response", "requeue"])), (k % 4 + 1).cast("int"))
    return loops.fold_outbox(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("e"), (k % 2 == 0).alias("w")), "user_id", ["ts", "event_id"], "e", "w")


@query("""SELECT user_id AS chat_id, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::BIGINT AS rank FROM events WHERE event_type LIKE 'cli%' AND event_id % 3 != 0 QUALIFY rank <= 5""")
def recent_messages(spark, sf_dir):
    k = F.col("event_id")
    m = table(spark, sf_dir, "events").select(k.alias("message_id"), F.col("user_id").alias("chat_id"), F.col("event_type").alias("message_type"), F.when(k % 3 != 0, F.col("ts")).alias("delivered_at"))
    return outbox.recent(m, 5, "cli").select("chat_id", "message_id", "rank")


@query("SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 50")
def intents_by_status(spark, sf_dir):
    return ingest.scan(table(spark, sf_dir, "events"), "event_type = 'view'", 50, ["event_id"]).select("event_id", "ts")


@query("""SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_type = 'view'""")
def discovery_messages(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "discovery_new").otherwise("notification")
    json = F.when(k % 3 == 0, F.concat(F.lit('{"discovery_id": "'), k.cast("string"), F.lit('"}'))).otherwise('{"discovery_id": ""}')
    return table(spark, sf_dir, "events").where(outbox.about_discovery(kind, json)).select("event_id")


@query("""SELECT c_custkey AS chat_id, coalesce(n, 0)::BIGINT AS delivered, c_custkey % 5 > 0 AND coalesce(n, 0) < c_custkey % 5 AS allowed FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1) ON user_id = c_custkey""")
def limits_per_day(spark, sf_dir):
    """Daily limits from 0 to 4; one of 0 allows nothing."""
    limits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), (F.col("c_custkey") % 5).alias("daily_limit"))
    return outbox.allowed(table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp_ntz").alias("at")), limits, "chat_id", "at", _at("2024-01-29"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN false ELSE true END AS readable, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2026-01-10' + to_days((o_orderkey % 9 + 1)::INTEGER * 7) WHEN 2 THEN TIMESTAMP '2026-01-10' + to_days((o_orderkey % 4 + 1)::INTEGER * 30) WHEN 3 THEN TIMESTAMP '2026-03-15' WHEN 4 THEN TIMESTAMP '2026-03-15' WHEN 5 THEN TIMESTAMP '2027-01-20' END AS at FROM orders""")
def deadlines_read(spark, sf_dir):
    """No deadline, durations, an ISO date, dates in words with and without a year, and an answer that is none."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 7 == 0, " No Deadline ").when(k % 7 == 1, F.concat((k % 9 + 1).cast("string"), F.lit(" weeks"))).when(k % 7 == 2, F.concat((k % 4 + 1).cast("string"), F.lit("month")))
        .when(k % 7 == 3, "2026-03-15").when(k % 7 == 4, "by march 15th").when(k % 7 == 5, "Jan 20, 2027").otherwise("when it is done")
    )
    d = outbox.deadline(text, _at("2026-01-10"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d["readable"].alias("readable"), d["at"].alias("at"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '⏰ **Project: ' || c_name || '**' || chr(10) || chr(10) || 'How urgent is this project? (Rate urgency from 1-5)' || chr(10) || chr(10) || '• 1 = Can wait months' || chr(10) || '• 3 = Should do in weeks' || chr(10) || '• 5 = Needs attention ASAP' || chr(10) || chr(10) || 'Reply with a number 1-5.'
WHEN 1 THEN '👋 Hey! Just a gentle reminder about **' || c_name || '**' || chr(10) || chr(10) || 'No pressure, but when you have a moment, could you share the deadline for this project?' || chr(10) || chr(10) || 'Thanks! 😊' ELSE '🚨 **Urgent: ' || c_name || '**' || chr(10) || chr(10) || 'Deadline is in ' || (c_custkey % 24) || '.5 hours!' || chr(10) || chr(10) || 'This is a high-priority project (importance: ' || (c_custkey % 5 + 1) || ', urgency: None).' || chr(10) || chr(10) || 'Just a heads up! 👍' END AS text FROM customer""")
def question_texts(spark, sf_dir):
    k = F.col("c_custkey")
    row = {"title": F.col("c_name"), "question": F.lit("deadline"), "hours": F.format_string("%.1f", k % 24 + 0.5), "importance": k % 5 + 1, "urgency": F.lit(None)}
    text = F.when(k % 3 == 0, outbox.message_text("urgency", row)).when(k % 3 == 1, outbox.message_text("gentle", row)).otherwise(outbox.message_text("critical_deadline", row))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'home' END AS chat_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_id % 5 = 0 THEN 'ok:go,no:stop' ELSE '' END AS buttons FROM events""")
def message_payloads(spark, sf_dir):
    k = F.col("event_id")
    chat = F.when(k % 2 == 0, F.concat(F.lit('"chat_id": "'), F.col("user_id").cast("string"), F.lit('", '))).otherwise(F.when(k % 4 == 1, '"chat_id": "", ').otherwise(""))
    text = F.when(k % 3 != 0, F.concat(F.lit('"text": "'), "event_type", F.lit('", '))).otherwise("")
    buttons = F.when(k % 5 == 0, '"buttons": [{"text": "ok", "callback_data": "go"}, {"text": "no", "data": "stop"}, {"text": "", "data": "x"}, {"text": "y"}], ').otherwise("")
    p = outbox.payload(F.concat(F.lit("{"), chat, text, buttons, F.lit('"z": 1}')), "home")
    said = F.array_join(F.transform(p["buttons"], lambda b: F.concat(b["text"], F.lit(":"), b["data"])), ",")
    return table(spark, sf_dir, "events").select("event_id", p["chat_id"].alias("chat_id"), p["text"].alias("text"), said.alias("buttons"))


@query("""SELECT status, attempts, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'delivered' END AS status, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 0 ELSE 3 END AS attempts FROM events) GROUP BY ALL""")
def failed_requeued(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "error", "failed").otherwise("delivered").alias("status"), F.lit(3).alias("attempts"), "user_id")
    return outbox.requeue(e, e.where("user_id % 2 = 0")).groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN 'delivered' ELSE 'error' END AS event FROM events WHERE event_type = 'signup' AND (event_id % 4 != 0 OR ts <= TIMESTAMP '2024-01-10') ORDER BY ts, event_id LIMIT 10""")
def outbox_polled(spark, sf_dir):
    """One turn of the loop: the ten oldest messages that are due; odd ones can't be delivered."""
    k = F.col("event_id")
    pending = table(spark, sf_dir, "events").where("event_type = 'signup'").select(k.alias("message_id"), F.col("ts").alias("created_at"), F.when(k % 4 == 0, F.col("ts")).alias("next_attempt_at"))
    return loops.poll_outbox(pending, lambda due: due.withColumn("error", F.when(F.col("message_id") % 2 == 1, "no chat")), F.lit("2024-01-10").cast("timestamp_ntz")).select("message_id", "event")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def counts_by_window(spark, sf_dir):
    """Counts by day; the same function closes windows by watermark on a stream."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return loops.windowed_counts(e, "at", ["event_type"], "1 day", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _proposals(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("discovery_id"), k.cast("string").alias("candidate_key"), F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.expr("round((o_totalprice % 1000) / 1000, 6)").alias("confidence"), F.when(k % 4 != 0, "pending").otherwise("rejected").alias("status"))


_C = "round((o_totalprice % 1000) / 1000, 6)"


@query(f"""WITH p AS (SELECT o_orderkey AS k, {_C} AS c FROM orders), d AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'rejected' WHEN c < 0.6 THEN 'rejected' WHEN c >= 0.9 THEN 'approved' ELSE 'awaiting_approval' END AS s FROM p) SELECT 'proposal ' || s AS what, count(*)::BIGINT AS n FROM d GROUP BY s UNION ALL SELECT 'audit ' || (s = 'approved'), count(*)::BIGINT FROM d WHERE k % 4 != 0 AND s != 'awaiting_approval' GROUP BY s UNION ALL SELECT 'intent', count(*)::BIGINT FROM d WHERE s = 'awaiting_approval'
UNION ALL SELECT 'project ' || CASE WHEN k % 3 = 0 THEN 'titled' ELSE 'named' END, count(*)::BIGINT FROM d WHERE s = 'approved' AND k % 10 != 1 GROUP BY k % 3 = 0 UNION ALL SELECT 'project old', count(*)::BIGINT FROM orders WHERE o_orderkey % 10 = 1""")
def gatekeeper_run(spark, sf_dir):
    """Pending proposals are decided; those whose discovery has a project already (ids that end in 1) get no second one."""
    p = _proposals(spark, sf_dir)
    old = p.where("discovery_id % 10 = 1").select(F.lit("old").alias("title"), "discovery_id", "confidence", F.lit("active").alias("status"))
    out = gatekeeper.process(p, old)
    one = lambda df, what: df.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    title = F.when(F.col("title") == "old", "old").when(F.col("title").startswith("T"), "titled").otherwise("named")
    return (
        one(out["proposals"], F.concat(F.lit("proposal "), "status")).unionByName(one(out["audit"], F.concat(F.lit("audit "), F.col("approved").cast("string")))).unionByName(one(out["intents"], F.lit("intent")))
        .unionByName(one(out["projects"], F.concat(F.lit("project "), title)))
    )


@query(f"""WITH p AS (SELECT o_orderkey AS k, {_C} AS c FROM orders), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS d FROM orders WHERE o_orderkey % 7 = 0) SELECT coalesce(d, CASE WHEN k % 4 != 0 THEN 'pending' ELSE 'rejected' END) AS what, count(*)::BIGINT AS n FROM p LEFT JOIN a USING (k) GROUP BY 1 UNION ALL SELECT 'project', count(*)::BIGINT FROM a WHERE d = 'approved' UNION ALL SELECT 'reason ' || CASE WHEN k % 3 = 0 THEN 'late' ELSE 'manual_reject' END, count(*)::BIGINT FROM a WHERE d = 'rejected' GROUP BY k % 3 = 0 UNION ALL SELECT 'error', count(*)::BIGINT FROM a""")
def manual_decisions(spark, sf_dir):
    """Answers about every seventh proposal, and as many about unknown ones."""
    p = _proposals(spark, sf_dir)
    k = F.col("discovery_id")
    said = p.where("discovery_id % 7 = 0").select(k, F.when(k % 2 == 0, "approve").otherwise("reject").alias("decision"), F.when(k % 3 == 0, "late").alias("reason"))
    out = gatekeeper.decide(p, p.limit(0).select("title", "discovery_id", "confidence", "status"), said.unionByName(said.withColumn("discovery_id", -1 - k)))
    one = lambda df, what: df.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    return one(out["proposals"], F.col("status")).unionByName(one(out["projects"], F.lit("project"))).unionByName(one(out["audit"].where("not approved"), F.concat(F.lit("reason "), "reason"))).unionByName(one(out["errors"], F.lit("error")))


@query("""WITH y AS (SELECT o_orderkey AS k FROM orders WHERE TIMESTAMP '1998-08-05' - o_orderdate <= INTERVAL 7 DAYS AND o_orderkey % 2 = 0), g AS (SELECT k FROM y WHERE k % 3 != 0) SELECT (SELECT count(*) FROM y)::BIGINT AS tokens, (SELECT count(*) FROM orders)::BIGINT - (SELECT count(*) FROM g)::BIGINT AS projects, (SELECT count(*) FROM orders)::BIGINT * 2 - (SELECT count(*) FROM g)::BIGINT * 2 AS audit, (SELECT count(*) FROM y)::BIGINT - (SELECT count(*) FROM g)::BIGINT AS left_over""")
def rollback_cascade(spark, sf_dir):
    """Even projects ask to be undone; young ones get a token; every third gives a wrong one, the others go with all their rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    now = _at("1998-08-05")
    none = spark.createDataFrame([], "project_id long, token string, requested_at timestamp_ntz")
    tokens = gatekeeper.request_rollback(o, none, o.where("project_id % 2 = 0"), now)
    given = tokens.select("project_id", F.when(F.col("project_id") % 3 != 0, F.col("token")).otherwise("wrong").alias("token"))
    left = gatekeeper.confirm_rollback({"projects": o, "audit": o.unionByName(o)}, tokens, given)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(tokens, "tokens").crossJoin(n(left["projects"], "projects")).crossJoin(n(left["audit"], "audit")).crossJoin(n(left["tokens"], "left_over"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 5 + 1)::INTEGER ELSE -1 END AS importance, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS description, CASE WHEN c_custkey % 4 = 0 THEN '{"description":"new","importance":"' || (c_custkey % 5 + 1) || '"}' END AS changes, CASE c_custkey % 4 WHEN 1 THEN 'not allowed: id, title' WHEN 2 THEN 'direct updates are for users' END AS error FROM customer""")
def direct_updates(spark, sf_dir):
    """Of four projects one is updated, one names fields that aren't allowed, one is changed by an agent, one isn't asked for."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("int").alias("importance"), F.lit("old").alias("description"), _at("2024-01-01").alias("updated_at"))
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    wanted = F.when(k % 4 == 1, F.array(pair("title", F.lit("x")), pair("id", F.lit("1")), pair("importance", F.lit("1")))).otherwise(F.array(pair("importance", k % 5 + 1), pair("description", F.lit("new"))))
    changes = table(spark, sf_dir, "customer").where("c_custkey % 4 != 3").select(k.alias("key"), (k % 4 != 2).alias("user"), F.explode(wanted).alias("c")).select("key", "user", "c.*")
    checked = gatekeeper.allowed_changes(changes, F.col("user"))
    after, audit = gatekeeper.update_direct(rows, checked, "c_custkey", _at("2024-02-01"))
    said = audit.select("changes").groupBy("changes").agg(F.count("*").alias("_n"))
    errors = checked.select(F.col("key").alias("c_custkey"), "error").distinct()
    own = F.when(F.col("updated_at") == _at("2024-02-01"), F.concat(F.lit('{"description":"new","importance":"'), F.col("importance").cast("string"), F.lit('"}')))
    return after.withColumn("changes", own).join(said, "changes", "left").join(errors, "c_custkey", "left").select("c_custkey", F.coalesce("importance", F.lit(-1)).alias("importance"), "description", F.when(F.col("_n").isNotNull(), F.col("changes")).alias("changes"), "error")


@query("""SELECT c_custkey, c_custkey % 3 != 0 AS fits FROM customer""")
def allowed_fields(spark, sf_dir):
    fields = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("status"), F.lit("id"))).when(F.col("c_custkey") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("urgency")))
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.subset(fields, list(gatekeeper.DIRECT)).alias("fits"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'escalated' WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'open' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS rejected_confidence FROM orders WHERE o_orderkey % 3 != 0 OR o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'open', NULL FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus != 'F'""")
def escalations_recorded(spark, sf_dir):
    """Rejected proposals without an intent (every third) are marked and their rejection is recorded."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    proposals = o.select(k.alias("discovery_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("open").alias("status"), F.col("o_totalprice").alias("confidence"))
    known = o.where("o_orderkey % 3 != 0").select(F.concat(F.lit("proposal_escalation:"), k.cast("string")).alias("message_id"))
    after = workflow.record_escalations(proposals, workflow.escalations(proposals, known))
    return after.select(F.col("discovery_id").alias("o_orderkey"), "status", "rejected_confidence")


# ---- project notes


def _project(k):
    none = lambda every, v: F.when(k % every != 0, v)
    return {
        "id": k, "title": F.col("c_name"), "discovered_by": F.lit("latent_scout"), "discovery_id": F.concat(F.lit("d:"), k.cast("string")), "cluster_ids": F.when(k % 2 == 0, F.array(k.cast("string"), F.lit("x"))).otherwise(F.array().cast("array<string>")),
        "confidence_score": F.lit(0.29), "status": F.lit("active"), "importance": none(2, k % 5 + 1), "urgency": none(3, k % 4 + 1), "deadline": none(5, _at("2026-12-31 23:59:59")), "work_estimate": F.lit(None).cast("int"), "pressure_score": F.lit(None).cast("double"),
        "verified_by_user": F.lit(True), "created_at": _at("2026-01-01 10:00:00"), "updated_at": F.when(k % 7 != 0, _at("2026-01-02 11:30:00")), "description": F.col("c_mktsegment"),
    }


_N = "chr(10)"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS t, c_mktsegment AS d, CASE WHEN c_custkey % 2 != 0 THEN c_custkey % 5 + 1 END AS i, CASE WHEN c_custkey % 3 != 0 THEN c_custkey % 4 + 1 END AS u, c_custkey % 5 != 0 AS dl, c_custkey % 7 != 0 AS up FROM customer)
SELECT k AS c_custkey, md5('---' || {_N} || 'id: ' || k || {_N} || 'title: ' || CASE WHEN regexp_matches(t, '#') THEN t ELSE t END || {_N} || 'discovered_by: latent_scout' || {_N} || 'discovery_id: d:' || k || {_N} || 'cluster_ids:' || CASE WHEN k % 2 = 0 THEN {_N} || '- ''' || k || '''' || {_N} || '- x' ELSE ' []' END || {_N} || 'confidence_score: 0.29' || {_N} || 'status: active' || {_N}
|| coalesce('importance: ' || i || {_N}, '') || coalesce('urgency: ' || u || {_N}, '') || CASE WHEN dl THEN 'deadline: ''2026-12-31T23:59:59+00:00''' || {_N} ELSE '' END || 'verified_by_user: true' || {_N} || 'created_at: ''2026-01-01T10:00:00+00:00''' || {_N} || 'updated_at: ' || CASE WHEN up THEN '''2026-01-02T11:30:00+00:00''' ELSE 'null' END || {_N} || '---' || {_N}
|| {_N} || '# ' || t || {_N} || {_N} || d || {_N} || {_N} || CASE WHEN i IS NOT NULL OR u IS NOT NULL OR dl THEN '## Metadata' || {_N} || {_N} || '- **Status**: active' || coalesce({_N} || '- **Importance**: ' || i || '/5', '') || coalesce({_N} || '- **Urgency**: ' || u || '/5', '') || CASE WHEN dl THEN {_N} || '- **Deadline**: 2026-12-31' ELSE '' END || {_N} || {_N} ELSE '' END
|| '## Discovery Info' || {_N} || {_N} || '- **Discovered by**: latent_scout' || {_N} || '- **Discovery ID**: d:' || k || {_N} || '- **Confidence**: 28%' || {_N} || '- **Verified**: Yes' || {_N} || {_N} || '## Timestamps' || {_N} || {_N} || '- **Created**: 2026-01-01 10:00:00 UTC' || {_N} || '- **Updated**: ' || CASE WHEN up THEN '2026-01-02 11:30:00 UTC' ELSE 'N/A' END || {_N}) AS note FROM c""")
def project_notes_written(spark, sf_dir):
    """Whole notes; titles (names of customers) hold a number sign and need no quotes."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(P.note(_project(F.col("c_custkey")))).alias("note"))


@query("""SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 != 0 THEN (c_custkey % 5 + 1)::INTEGER ELSE -1 END AS importance, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || ',x' END AS members, CASE WHEN c_custkey % 5 != 0 THEN TIMESTAMP '2026-12-31 23:59:59' END AS deadline FROM customer""")
def project_notes_read(spark, sf_dir):
    """Notes are written and read back: lists, quoted texts, times and missing fields."""
    from corpusgraph.functions import notes as N

    m = F.col("m")
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    read = rows.select("c_custkey", P.parse(P.note(_project(F.col("c_custkey")))).alias("m"))
    return read.select("c_custkey", m["title"].alias("title"), F.coalesce(m["importance"].cast("int"), F.lit(-1)).alias("importance"), F.replace(m["cluster_ids"], F.lit("\n"), F.lit(",")).alias("members"), N.instant(m["deadline"]).cast("timestamp_ntz").alias("deadline"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unreadable' WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'updated' END AS outcome, CASE WHEN c_custkey % 3 != 0 AND c_custkey % 4 != 0 THEN (c_custkey % 5 + 1)::INTEGER ELSE 1 END AS importance FROM customer""")
def notes_to_projects(spark, sf_dir):
    """Files to rows: a conflict is left, a note without an id is an error, the rest sets its allowed fields."""
    k, at = F.col("c_custkey"), _at("2024-01-02")
    note = F.concat(F.lit("---\n"), F.when(k % 4 != 0, F.concat(F.lit("id: "), k.cast("string"), F.lit("\n"))).otherwise(""), F.lit("title: other\nimportance: "), (k % 5 + 1).cast("string"), F.lit("\n---\nbody"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(1).alias("importance"), F.lit("t").alias("title"), F.when(k % 3 == 0, at).otherwise(_at("2023-12-01")).alias("updated_at"), _at("2024-01-01").alias("synced_at"))
    files = table(spark, sf_dir, "customer").select(k.alias("file"), note.alias("note"), at.alias("changed_at"))
    after, outcomes = workflow.files_to_projects(files, rows, _at("2024-03-01"))
    return outcomes.select(F.col("file").alias("c_custkey"), "outcome").join(after.select(F.col("id").alias("c_custkey"), "importance"), "c_custkey")


@query("SELECT o_orderkey, floor(round((o_totalprice % 1000) / 1000, 6) * 100)::BIGINT AS percent, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM orders")
def shown_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.percent(F.expr(_C)).alias("percent"), P.shown(F.col("o_orderdate")).alias("shown"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'copied' WHEN doc_id % 3 = 1 THEN 'waiting' ELSE 'same' END AS action FROM documents""")
def approvals_copied(spark, sf_dir):
    """Shadow notes that differ from their source go back to it once they are approved."""
    d, k = table(spark, sf_dir, "documents").where("doc_id is not null"), F.col("doc_id")
    return workflow.copy_back(d.select(k.alias("key"), F.when(k % 3 == 2, F.sha1("text")).otherwise(F.sha1(F.concat("text", F.lit("x")))).alias("digest"), (k % 3 == 0).alias("approved")), d.select(k.alias("key"), F.sha1("text").alias("digest"))).select(F.col("key").alias("doc_id"), "action")


# ---- graphs


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("cluster_id"), F.explode(T.term_set(F.array("p_brand"), F.split("p_type", " "))).alias("term")).distinct()


_TERMSETS = """ts AS (SELECT DISTINCT p_size AS id, lower(trim(u)) AS term FROM (SELECT p_size, unnest(list_concat([p_brand], string_split(p_type, ' '))) AS u FROM part) WHERE trim(u) != ''), df AS (SELECT term, count(*) AS df FROM ts GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM ts),
g AS (SELECT id, count(*) AS terms, round(avg(1 - df / n.n::DOUBLE), 6) AS generality FROM ts JOIN df USING (term), n GROUP BY id), sh AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM ts a JOIN ts b ON a.term = b.term AND a.id != b.id GROUP BY ALL),
o AS (SELECT sh.a, sh.b, round(shared / (x.terms + y.terms - shared)::DOUBLE, 6) AS overlap FROM sh JOIN g x ON x.id = sh.a JOIN g y ON y.id = sh.b), s AS (SELECT a, b, overlap, round(0.5 + ((least(a, b) * 7 + greatest(a, b) * 13) % 50) / 100, 6) AS similarity FROM o)"""


def _similarity(overlap):
    return overlap.select("a", "b", F.round(0.5 + (F.least("a", "b") * 7 + F.greatest("a", "b") * 13) % 50 / 100, 6).alias("similarity"))


def _parents(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    near = _similarity(taxonomy.overlaps(terms, 0.0))
    return taxonomy.parents(taxonomy.overlaps(terms, 0.4), near, taxonomy.generality(terms), gap=0.005), near


_PARENTS = "e AS (SELECT s.a AS source, s.b AS target, similarity AS score, overlap, row_number() OVER (PARTITION BY s.b ORDER BY overlap DESC, similarity DESC, s.a)::BIGINT AS rank FROM s JOIN g x ON x.id = s.a JOIN g y ON y.id = s.b WHERE similarity >= 0.7 AND overlap >= 0.4 AND y.terms >= 3 AND round(y.generality - x.generality, 6) >= 0.005 QUALIFY rank <= 2)"


@query(f"WITH {_TERMSETS}, {_PARENTS} SELECT * FROM e")
def taxonomy_parents(spark, sf_dir):
    """Clusters are sizes of parts, terms their brands and types; similarities are made from the ids, the gap is small as terms are few."""
    return _parents(spark, sf_dir)[0]


@query(f"""WITH {_TERMSETS}, {_PARENTS}, fam AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), p AS (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM s WHERE similarity >= 0.7 AND (a, b) NOT IN (SELECT (a, b) FROM fam) QUALIFY k <= 5)
SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, similarity AS score FROM p""")
def taxonomy_neighbors(spark, sf_dir):
    parents, near = _parents(spark, sf_dir)
    return taxonomy.neighbors(near, parents.withColumn("kind", F.lit("PARENT_OF")))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS s, (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) AS t, (p_partkey * 37 % 101) / 100 AS score, p_size / 100 AS overlap FROM part), w AS (SELECT s AS root, s, t FROM p UNION SELECT w.root, p.s, p.t FROM w JOIN p ON p.s = w.t WHERE w.t >= w.root),
c AS (SELECT DISTINCT root FROM w WHERE t = root), m AS (SELECT w.root, p.* FROM w JOIN c USING (root) JOIN p ON p.s = w.s), l AS (SELECT arg_min(s, (score, overlap, s, t)) AS s FROM m GROUP BY root) SELECT s AS source, t AS target, CASE WHEN s IN (SELECT s FROM l) THEN 'NEIGHBOR' ELSE 'PARENT_OF' END AS kind FROM p""")
def taxonomy_cycle_resolution(spark, sf_dir):
    """Each part points to one other, so that all lie on rings or lead to one; each ring loses its weakest edge."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.max("p_partkey")).first()[0] or 0
    k = F.col("p_partkey")
    return taxonomy.break_cycles(part.select(k.alias("source"), ((k * 7 + 3) % (n + 1)).alias("target"), (k * 37 % 101 / 100).alias("score"), (F.col("p_size") / 100).alias("overlap")))


@query("""WITH e AS (SELECT DISTINCT n_regionkey AS s, n_nationkey + 100 AS t FROM nation), b AS (SELECT n_nationkey + 100 AS s, n_nationkey + 101 AS t FROM nation WHERE n_nationkey % 2 = 0) SELECT s AS node, t AS other, 'child' AS relation FROM e UNION ALL SELECT t, s, 'parent' FROM e UNION ALL SELECT s, t, 'neighbor' FROM b UNION ALL SELECT t, s, 'neighbor' FROM b""")
def graph_relations(spark, sf_dir):
    """Regions are parents of nations; every second nation is a neighbour of the next."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey") + 100
    edges = n.select(F.col("n_regionkey").alias("source"), key.alias("target"), F.lit("PARENT_OF").alias("kind")).unionByName(n.where("n_nationkey % 2 = 0").select(key.alias("source"), (key + 1).alias("target"), F.lit("NEIGHBOR").alias("kind")))
    return taxonomy.relations(edges)


@query("""SELECT 'node' AS kind, '{"id":"' || c_custkey || '","label":"' || c_name || '","score":0.5,"tags":["' || c_mktsegment || '"]}' AS json FROM customer UNION ALL SELECT 'edge', '{"source":"' || c_custkey || '","target":"' || (c_custkey + 1) || '","type":"NEIGHBOR","score":0.75}' FROM customer""")
def graph_export(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    profiles = c.select(k.cast("string").alias("cluster_id"), F.col("c_name").alias("theme_summary"), F.lit(0.5).alias("confidence"), F.array("c_mktsegment").alias("tags"))
    edges = c.select(k.cast("string").alias("source"), (k + 1).cast("string").alias("target"), F.lit("NEIGHBOR").alias("kind"), F.lit(0.75).alias("score"))
    return taxonomy.export(profiles, edges)


@query("""SELECT 'notes' AS source, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'mail', count(*)::BIGINT FROM customer WHERE c_custkey % 3 = 0""")
def profiles_bootstrapped(spark, sf_dir):
    """Notes have profiles, so none are added; mail has none, so those of the wanted clusters are."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cluster_id"), "c_custkey", F.col("c_name").alias("theme"))
    have = c.where("c_custkey % 2 = 0").select("cluster_id", "theme", F.lit("notes").alias("source"))
    wanted = c.where("c_custkey % 3 = 0")
    after = taxonomy.bootstrap(taxonomy.bootstrap(have, wanted, "notes", c.select("cluster_id", "theme")), wanted, "mail", c.select("cluster_id", "theme"))
    return after.groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN abs(a.n_nationkey - b.n_nationkey) = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS similarity FROM nation a JOIN nation b ON a.n_nationkey != b.n_nationkey""")
def similarity_lookups(spark, sf_dir):
    """Similarities are stored once for each pair of neighbours and asked for in both orders."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    pairs = n.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"), F.lit(0.5).alias("similarity"))
    asked = n.select(F.col("n_nationkey").alias("a")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"))), F.col("a") != F.col("b"))
    return taxonomy.similarity_of(pairs, asked)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM embeddings q JOIN embeddings e ON e.vec_id != q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, arg_min(vec_id, (distance, vec_id)) AS vec_id, min(distance) AS distance FROM s GROUP BY 1""")
def nearest_neighbor(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return search.top_k(vecs, _asked(vecs), "vec_id", "embedding", 1).drop("rank")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 5 IN (0, 1) THEN 'about ' || event_type WHEN event_id % 5 IN (2, 3) THEN 'Some ' || event_type || ' Key themes: zebra' END AS theme, CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 5 != 4 THEN 'zebra' END AS topics FROM events""")
def profiles_synthesized(spark, sf_dir):
    """Answers that are JSON at once, at the second try, never, or lack the theme; every fifth cluster has no notes."""
    k = F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").alias("cluster_id"), F.when(k != 4, F.concat(F.lit("Some "), "event_type", F.lit(". More."))).alias("notes"), F.array(F.lit("zebra")).alias("keywords"))
    said = lambda more: F.concat(F.lit('{"theme_summary": "about '), "event_type", F.lit('"' + more + "}"))
    first = F.when(k == 0, said(', "dominant_topics": ["x"]')).when(k == 3, '{"theme_summary": ""}').otherwise("no JSON")
    out = workflow.synthesize(rows, [first, F.when(k == 1, F.concat(F.lit("Here: "), said(""), F.lit(" done")))])
    return out.select(F.col("cluster_id").alias("event_id"), "status", F.col("theme_summary").alias("theme"), F.array_join("topics", ",").alias("topics"))


@query("""SELECT c_custkey, ((c_custkey % 4) * (c_custkey % 3 = 0)::INTEGER + (n IS NOT NULL)::INTEGER)::BIGINT AS ask_count FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS n FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 OR n IS NOT NULL""")
def asks_counted(spark, sf_dir):
    """Known are every third customer; asked about are those with orders of status P."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 4).alias("ask_count"), _at("2024-01-01").alias("asked_at"))
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return governance.after_asking(known, asked, "c_custkey", _at("2024-02-01")).join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "ask_count")


@query(f"""WITH {_DIMS}, r AS (SELECT e.label, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], CASE WHEN e.label % 2 = 0 THEN c.embedding::DOUBLE[] ELSE d.centroid END), 6) AS distance FROM embeddings e JOIN c d USING (label) LEFT JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) c USING (label))
SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::BIGINT AS rank FROM r QUALIFY rank <= 3""")
def representatives_of_stored_centroids(spark, sf_dir):
    """Even clusters have a stored centroid (their first vector)."""
    v = table(spark, sf_dir, "embeddings")
    known = v.where("label % 2 = 0").groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("centroid"))
    return clusters.representatives(v, "label", "embedding", "vec_id", 3, known).select("label", "vec_id", "distance", "rank")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN TIMESTAMP '1995-01-01' END AS last, o_orderdate AS changed, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1994-01-01' END AS file FROM orders), w AS (SELECT CASE WHEN changed > last AND file > last THEN 'conflict' WHEN changed > last THEN 'row' WHEN file > last THEN 'file' ELSE 'none' END AS w FROM p)
SELECT strategy, CASE WHEN w = 'conflict' THEN CASE strategy WHEN 'row_wins' THEN 'row' ELSE 'file' END ELSE w END AS winner, count(*)::BIGINT AS n FROM w, (VALUES ('row_wins'), ('file_wins')) s(strategy) GROUP BY ALL""")
def sync_conflicts_settled(spark, sf_dir):
    n, out = F.col("o_orderkey"), None
    for strategy in ("row_wins", "file_wins"):
        winner = workflow.sync_conflict(F.when(n % 5 != 0, _at("1995-01-01")), F.col("o_orderdate"), F.when(n % 2 == 0, _at("1996-01-01")).otherwise(_at("1994-01-01")), strategy)
        part = table(spark, sf_dir, "orders").groupBy(winner.alias("winner")).agg(F.count("*").alias("n")).select(F.lit(strategy).alias("strategy"), "winner", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH s AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[\\x09-\\x0D\\x20]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s) SELECT doc_id, len(list_filter(parts, lambda x: x != ''))::BIGINT AS n, list_sum(list_transform(parts, lambda x: length(x)))::BIGINT AS n_chars FROM p""")
def sentence_places(spark, sf_dir):
    """Places of sentences in whole texts: their number and how many characters they cover."""
    import pyarrow as pa

    ship(spark)

    def run(batches):
        for batch in batches:
            found = [ingest.sentences(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(b - a for a, b in f) for f in found], pa.int64())], names=["doc_id", "n", "n_chars"])

    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n long, n_chars long")
