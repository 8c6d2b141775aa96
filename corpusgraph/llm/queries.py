"""The registered queries of this subpackage: each applies its operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import anagram, bpe, dartminhash, decontam, html_text, langid, lattice, licenses, mixing, quality, secrets, toxicity, warc
from corpusgraph.session import discard, materialise, ship, table


def vocabulary() -> str:
    """The vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(3, 1)))
    return langid.predict(docs, model).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = secrets.find(table(spark, sf_dir, "documents"), vocab_path=vocabulary())

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"), F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("max_log10_guesses"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc.read_archives(warc.archive(pages))
    return back.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity.score(docs, model).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, from what the operator returns."""
    out = bpe.round_trip(docs, vocabulary())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.audit(lattice.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    goals = mixing.targets(sized)
    placed = mixing.place(sized, goals)
    out = materialise(mixing.taken(placed, mixing.mix(placed, mixing.slots(goals))).withColumnRenamed("id", "doc_id"), "mixed")
    discard(sized, goals, placed)
    return out


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return anagram.group(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2's base spans, which SQL can express."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8 and its base rules, which SQL can express."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


#: Weighted Jaccard similarity of all pairs of texts that share a window, and classes by a closure.
NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x != '') AS w FROM documents),
k AS (SELECT w, min(doc_id) AS rep FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM k),
c AS (SELECT rep, hash(array_to_string(w[i:i + 4], ' ')) AS g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT rep, sum(n) AS n FROM c GROUP BY rep),
p AS (SELECT x.rep AS a, y.rep AS b, sum(least(x.n, y.n)) AS shared FROM c x JOIN c y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN t x ON x.rep = a JOIN t y ON y.rep = b WHERE shared::DOUBLE / (x.n + y.n - shared)::DOUBLE >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS rep, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT doc_id, coalesce(root, rep, doc_id) AS class_id FROM d LEFT JOIN k USING (w) LEFT JOIN m USING (rep)"""

WARC_SQL = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT page_id, first, strlen(h)::BIGINT AS n, list_transform(range(0, 8), lambda k: ('0x' || substring(sha1(h), (5 * k + 1)::INTEGER, 5))::INTEGER) AS v FROM p JOIN f USING (h))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(flatten(list_transform(v, lambda y: [y // 32768, y // 1024 % 32, y // 32 % 32, y % 32])), lambda y: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y + 1)::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to FROM x"""

SECRET_SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex FROM documents"""

QUALITY_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x != '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)), again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY doc_id),
c AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN cover USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""


#: The filters one after another in each order, without edges.
AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END) AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
q AS (SELECT part, n, good, toxic, filter_order, step, own, contains(fails, own) AS bad, fails = own AS alone, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) - (fails = '' AND earlier = '')::INT > 0 AS gone FROM c, s),
m AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM q GROUP BY ALL)
SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM m"""

#: Positions in the sources' shuffled streams, taken round after round up to the target.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source), w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS k FROM w),
v AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - (2 * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
g AS (SELECT source, n, CASE WHEN x.level * w > 2 * n THEN (2 * n)::DOUBLE ELSE x.level * w END AS target FROM v, (SELECT level FROM v WHERE level * w <= 2 * n ORDER BY k LIMIT 1) x),
p AS (SELECT doc_id, size, n, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start, least(round(target)::BIGINT, 2 * n) AS t FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target, (CASE WHEN size = 0 THEN 0 ELSE t // n * size + greatest(0, least(start + size, t % n) - start) END)::BIGINT AS taken FROM p"""

#: Words that share a pattern with one place left open, or of which one is the other without a place; crc32 bit by bit over a table made here.
VARIANT_SQL = r"""WITH RECURSIVE b(k, v, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM b WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS c FROM b WHERE i = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
g AS (SELECT doc_id, r, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM o WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda j: ('0x' || x[j:j + 1])::BIGINT)), lambda s, y: xor(s >> 8, c[(xor(s, y) & 255) + 1])), 4294967295) AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), c AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM e),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM c x JOIN c y USING (i, a, z) WHERE x.word != y.word UNION SELECT c.word, w.word, w.n FROM c JOIN w ON w.word = a || z UNION SELECT w.word, c.word, c.n FROM c JOIN w ON w.word = a || z),
t AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN best END AS form, CASE WHEN m >= 10 * w.n THEN m END::BIGINT AS form_n FROM w LEFT JOIN t USING (word)),
u AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.next)
SELECT word, f.form, u.root, n, n_near, form_n FROM f JOIN u USING (word) WHERE u.next IS NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_near_duplicates, op4_license_scan, op5_html_extract, op6_warc_roundtrip, op7_toxicity, op8_quality_rules, op9_decontaminate, op10_bpe, op11_filter_audit, op12_source_mix, op13_spelling_variants, pipeline, base_secret_counts, base_quality_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": NEAR_SQL, "op4_license_scan": licenses.oracle(), "op6_warc_roundtrip": WARC_SQL, "op11_filter_audit": AUDIT_SQL, "op12_source_mix": MIX_SQL, "op13_spelling_variants": VARIANT_SQL, "base_secret_counts": SECRET_SQL, "base_quality_counts": QUALITY_SQL}
