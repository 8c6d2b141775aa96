"""Queries on notes, mail, pages and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import identity as I
from corpusgraph.functions import text as T
from corpusgraph.operators import chunking
from corpusgraph.plans import query
from corpusgraph.session import ship, table


@query("SELECT count(*)::BIGINT AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS deviation, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest FROM documents")
def chunk_size_stats(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("deviation"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@query("SELECT round(avg(CASE WHEN regexp_matches(text, '[.!?][\\x09-\\x0D\\x20]*$') THEN 1.0 ELSE 0.0 END), 6) AS quality FROM documents")
def boundary_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(F.avg(F.when(F.col("text").rlike(r"[.!?][\x09-\x0D\x20]*\z"), 1.0).otherwise(0.0)), 6).alias("quality"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '[\\x09-\\x0D\\x20]+') AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, ((len(ws) - 1) // 500) + 1)) AS k FROM w)
SELECT doc_id, k::INTEGER AS chunk, md5(array_to_string(ws[k * 500 + 1:k * 500 + 500], ' ')) AS digest FROM c""")
def word_chunks_500(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk", "words")).select("doc_id", "chunk", F.md5("words").alias("digest"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])[\\x09-\\x0D\\x20]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x != '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(None)
def recursive_chunks(spark, sf_dir):
    ship(spark)
    return chunking.recursive(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(None)
def assembled_chunks(spark, sf_dir):
    ship(spark)
    return chunking.assembled(table(spark, sf_dir, "documents"), "doc_id", "text")


_NOTE = """'---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || '# Note [[target|alias]] [[plain]] ![[embed]]' || chr(10) || 'key:: value' || chr(10) || '<div>' || lang || '</div>  📌 ' || text"""


@query(f"""WITH n AS (SELECT doc_id, {_NOTE} AS t FROM documents), s AS (SELECT doc_id,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
'(?sm)^---\\n.*?\\n---\\n', '', 'g'), '(?s)```chatgpt[^`]*```', '', 'g'), '!\\[\\[[^\\]]*\\]\\]', '', 'g'), '\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]]*)\\]\\]', '\\1', 'g'),
'<[^>]+>', '', 'g'), '\\b[A-Za-zÀ-ÿ0-9_]+::[^\\n]+', '', 'g'), '[📌🎯💡⚡]', '', 'g'), ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM n)
SELECT doc_id, md5(regexp_replace(t, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g')) AS digest FROM s""")
def markdown_clean(spark, sf_dir):
    note = F.expr(r"""'---\nid: ' || doc_id || '\n---\n# Note [[target|alias]] [[plain]] ![[embed]]\nkey:: value\n<div>' || lang || '</div>  📌 ' || text""")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.markdown_clean(note)).alias("digest"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text || '  x   ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || '    code  x ', chr(13) || chr(10), chr(10)), chr(10)), lambda x: CASE WHEN starts_with(x, '    ') OR starts_with(x, chr(9)) THEN rtrim(x) ELSE regexp_replace(rtrim(x), ' {2,}', ' ', 'g') END) AS l FROM documents)
SELECT doc_id, md5(trim(regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM l""")
def shadow_normalize(spark, sf_dir):
    text = F.concat("text", F.lit("  x   \r\n\n\n\n    code  x "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.note_normalise(text)).alias("digest"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN contains(text, 'Ã¼') OR contains(text, 'Ã¶') OR contains(text, 'Ã¤') OR contains(text, chr(65533)) OR contains(text, 'â€™') OR contains(text, 'â€œ') OR contains(text, 'â€˜') OR length(trim(text)) < 20 THEN 'rejected' END AS s FROM documents), f AS (SELECT h, min(doc_id) AS first FROM d GROUP BY h),
x AS (SELECT CASE WHEN s IS NOT NULL THEN s WHEN doc_id != first THEN 'duplicates' ELSE 'stored' END AS status FROM d JOIN f USING (h)) SELECT status, count(*)::BIGINT AS n FROM x GROUP BY 1 UNION ALL SELECT 'loaded', count(*) FROM documents""")
def ingest_triage_counts(spark, sf_dir):
    """The four counters of a mail ingest; texts stand in for bodies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), (T.is_mojibake(F.col("text")) | (F.length(F.trim("text")) < 20)).alias("bad"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    status = F.when(F.col("bad"), "rejected").when(F.col("doc_id") != F.col("first"), "duplicates").otherwise("stored")
    return docs.join(first, "h").groupBy(status.alias("status")).agg(F.count("*").alias("n")).unionByName(docs.agg(F.lit("loaded").alias("status"), F.count("*").alias("n")))


@query("SELECT doc_id, 'hash-' || sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || '' || '|' || coalesce(substring(text, 1, 256), '')) AS mail_id FROM documents")
def email_unique_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.mail_id(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("mail_id"))


@query("SELECT page_id, sha1(url) AS source_id FROM pages")
def source_file_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.source_id(F.col("url")).alias("source_id"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_\\s-]', '', 'g'), '\\s+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""WITH s AS (SELECT conv_id, turn, role, text, '## ' || role || ' ' || turn || chr(10) || text || chr(10) AS part FROM conversations), p AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, turn, '## ' || role || ' ' || turn AS heading, start, (start + length(part))::BIGINT AS "end" FROM p""")
def heading_sections(spark, sf_dir):
    """Sections of threads written as notes, one heading per turn, with their offsets."""
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, sf_dir, "conversations").withColumn("n", F.length(part).cast("long")).withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return s.select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string")).alias("heading"), "start", (F.col("start") + F.col("n")).alias("end"))


@query("SELECT item_id, CASE WHEN q LIKE '%http%' OR q LIKE '%latest%' OR q LIKE '%news%' THEN 'web' WHEN q LIKE '%project%' OR q LIKE '%status%' OR q LIKE '%deadline%' THEN 'projects' ELSE 'archive' END AS route FROM (SELECT item_id, lower(CASE item_id % 3 WHEN 0 THEN 'Latest ' WHEN 1 THEN 'project ' ELSE '' END || text) AS q FROM benchmark)")
def route_classify(spark, sf_dir):
    q = F.concat(F.when(F.col("item_id") % 3 == 0, "Latest ").when(F.col("item_id") % 3 == 1, "project ").otherwise(""), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.route(q).alias("route"))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[.,!?;:()\\[\\]]+|[.,!?;:()\\[\\]]+$', '', 'g')) AS ws FROM documents), c AS (SELECT doc_id, len(list_filter(ws, lambda w: list_contains(['the', 'die', 'le'], w))) AS p, len(list_filter(ws, lambda w: list_contains(['of', 'der', 'la'], w))) AS n FROM w)
SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n)::DOUBLE END, 6) AS polarity FROM c""")
def polarity_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.polarity(F.col("text"), ["the", "die", "le"], ["of", "der", "la"]), 6).alias("polarity"))


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedup_first_seen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH d AS (SELECT doc_id, sha1(text) AS h FROM documents), s AS (SELECT h FROM d WHERE doc_id % 3 != 0 GROUP BY h), t AS (SELECT h FROM d WHERE doc_id % 3 != 1 GROUP BY h)
SELECT h, 'copy' AS side FROM s WHERE h NOT IN (SELECT h FROM t) UNION ALL SELECT h, 'delete' FROM t WHERE h NOT IN (SELECT h FROM s)""")
def shadow_sync_diff(spark, sf_dir):
    from corpusgraph.operators.state import tree_diff

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"))
    return tree_diff(d.where("doc_id % 3 != 0").select("h").distinct(), d.where("doc_id % 3 != 1").select("h").distinct(), "h")
