"""Queries on notes, projects, messages and jobs. Tables stand in for notes and projects, with columns built alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import identity as I
from corpusgraph.functions import notes as N
from corpusgraph.operators import clusters, structure, workflow
from corpusgraph.plans import query
from corpusgraph.session import ship, table
from corpusgraph.sources import sinks


def _now():
    return F.lit("1998-08-02").cast("timestamp_ntz")


_BARE = "regexp_replace(w, '[^a-zA-Z0-9_]', '', 'g')"


@query(f"""WITH t AS (SELECT p_partkey, p_name || ' of the (' || p_brand || ') / ' || p_type || ' ' || p_size AS title FROM part), w AS (SELECT p_partkey, list_filter(list_transform(string_split(title, ' '), lambda w: CASE WHEN w = lower(w) AND w != upper(w) AND length(w) <= 3 THEN {_BARE}
WHEN w = upper(w) AND w != lower(w) AND length({_BARE}) > 1 THEN {_BARE} ELSE upper(left({_BARE}, 1)) || lower(substring({_BARE}, 2)) END), lambda w: w != '') AS ws FROM t)
SELECT p_partkey, regexp_replace(left(array_to_string(ws, '-'), 100), '-+$', '') AS file FROM w""")
def title_filenames(spark, sf_dir):
    title = F.concat("p_name", F.lit(" of the ("), "p_brand", F.lit(") / "), "p_type", F.lit(" "), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.file_title(title).alias("file"))


@query("""SELECT doc_id, lang AS language, source, CASE WHEN doc_id % 2 = 0 THEN 'first' END AS title FROM documents""")
def frontmatter_fields(spark, sf_dir):
    """Notes written with front matter (even ids repeat a key), then parsed again."""
    fields = {"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "title": F.when(F.col("doc_id") % 2 == 0, "first"), "lang ": F.lit("x")}
    again = F.when(F.col("doc_id") % 2 == 0, F.lit("title: second"))
    body = F.concat(F.lit("\nlang: body\n"), "text")
    note = F.regexp_replace(N.with_front_matter(fields, body), r"\A---\n(?s)(.*?)\n---\n", F.concat(F.lit("---\n$1"), F.coalesce(F.concat(F.lit("\n"), again), F.lit("")), F.lit("\n---\n")))
    m = N.front_matter(note)
    return table(spark, sf_dir, "documents").select("doc_id", m["lang"].alias("language"), m["source"].alias("source"), m["title"].alias("title"))


_OLD = "'# T' || chr(10) || 'about ' || c_name || chr(10) || '## Metadata' || chr(10) || 'x' || chr(10) || '## ' || c_mktsegment || chr(10) || 'own ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '## Timestamps' || chr(10) || 'y' ELSE '' END"


@query("""SELECT c_custkey, 'about ' || c_name AS description, '# New' || chr(10) || chr(10) || '## ' || c_mktsegment || chr(10) || 'own ' || c_custkey AS note FROM customer""")
def project_notes_preserved(spark, sf_dir):
    """A project's note written anew keeps the sections that its reader added; the description is read back."""
    old = F.expr(_OLD.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.description(old).alias("description"), N.keep_sections(F.lit("# New\n"), old).alias("note"))


@query("""SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN ['#daily_note', '#' || lang] WHEN regexp_matches(lower(left(text, 1000)), 'project|draft|todo') THEN ['#project_candidate'] ELSE ['#needs_review'] END) AS tag FROM documents WHERE lang IS NOT NULL) GROUP BY 1""")
def note_tags(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Tags:\n  #daily_note \n#"), "lang", F.lit("\nnone")))
    return table(spark, sf_dir, "documents").where("lang is not null").select(F.explode(N.tags(answer, F.coalesce("text", F.lit("")))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT item_id, trim(text) AS t FROM benchmark), l AS (SELECT item_id, CASE WHEN t = '' THEN 'Cluster themes summary unavailable.' WHEN trim(regexp_split_to_array(t, '[.!?][\\x09-\\x0D\\x20]+')[1]) = '' THEN left(t, 200) ELSE trim(regexp_split_to_array(t, '[.!?][\\x09-\\x0D\\x20]+')[1]) END AS base FROM b), m AS (SELECT *, list_filter(['the', 'zebra', 'quokka', 'and', 'yak', 'xerus'], lambda k: NOT contains(lower(base), k))[1:3] AS missing FROM l)
SELECT item_id, CASE WHEN len(missing) > 0 THEN base || ' Key themes: ' || array_to_string(missing, ', ') ELSE base END AS summary FROM m""")
def profile_summaries(spark, sf_dir):
    words = F.array(*map(F.lit, ["the", "zebra", "quokka", "and", "yak", "xerus"]))
    return table(spark, sf_dir, "benchmark").select("item_id", N.summary(F.col("text"), words).alias("summary"))


@query("""SELECT event_id, CASE WHEN event_id % 4 != 3 THEN coalesce((props->>'k')::BIGINT, -1) ELSE -1 END AS k, CASE WHEN event_id % 4 != 3 THEN coalesce((props->>'confidence')::DOUBLE, 0.5) ELSE 0.5 END AS confidence FROM events""")
def lenient_profiles(spark, sf_dir):
    """Answers that are JSON, JSON inside prose, or neither; missing fields take their defaults."""
    n, p = F.col("event_id") % 4, F.col("props")
    answer = F.when(n == 1, F.concat(F.lit("Here it is:\n"), p, F.lit("\nDone."))).when(n == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 3, F.lit("no { answer")).otherwise(p)
    got = N.lenient_json(answer, "k bigint, confidence double")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(got["k"], F.lit(-1).cast("long")).alias("k"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"))


@query("""SELECT event_id, CASE WHEN event_id % 5 NOT IN (1, 2) THEN event_type END AS action, CASE WHEN event_id % 5 NOT IN (1, 2) THEN user_id::VARCHAR END AS message_id, CASE WHEN event_id % 5 NOT IN (1, 2) THEN CASE WHEN event_id % 5 = 3 THEN '' ELSE '12:30' END END AS answer FROM events""")
def callback_codec(spark, sf_dir):
    n, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    data = F.when(n == 1, F.concat("event_type", F.lit(":"), user)).when(n == 2, F.concat(F.lit(":"), user, F.lit(":x"))).when(n == 3, F.concat("event_type", F.lit(":"), user, F.lit(":"))).otherwise(F.concat("event_type", F.lit(":"), user, F.lit(":12:30")))
    c = N.callback(data)
    return table(spark, sf_dir, "events").select("event_id", c["action"].alias("action"), c["message_id"].alias("message_id"), c["value"].alias("answer"))


@query("""WITH d AS (SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([0, n], list_filter([n // 3, 40, doc_id % 90 - 5], lambda x: x > 0 AND x < n)))), ',') AS cuts FROM d""")
def boundary_positions(spark, sf_dir):
    """Boundaries proposed as text, some of them out of range, repeated or no numbers."""
    n = F.length("text").cast("long")
    said = F.concat_ws(", ", F.floor(n / 3).cast("string"), F.lit("40"), F.lit("x"), F.lit(""), F.lit("40.7"), (F.col("doc_id") % 90 - 5).cast("string"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(N.cuts(N.csv_fields(said), n), ",").alias("cuts"))


@query("""SELECT kind, count(*) FILTER (WHERE page_id % 6 IN (0, 5)) ::BIGINT AS watched, count(*)::BIGINT AS n FROM (SELECT page_id, (page_id % 6)::BIGINT AS kind FROM pages) GROUP BY 1""")
def watched_files(spark, sf_dir):
    k, name = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("/notes/a b/"), name, F.lit(".md"))).when(k == 1, F.concat(F.lit("/notes/."), name, F.lit(".md"))).when(k == 2, F.concat(F.lit("/notes/.obsidian/"), name, F.lit(".md")))
        .when(k == 3, F.concat(F.lit("/notes/"), name, F.lit(".md.tmp"))).when(k == 4, F.concat(F.lit("/notes/"), name, F.lit(".md~"))).otherwise(F.concat(F.lit("/notes/.obsidian-old/"), name, F.lit(".md")))
    )
    return table(spark, sf_dir, "pages").select(k.cast("long").alias("kind"), N.watched(path).cast("int").alias("w")).groupBy("kind").agg(F.sum("w").alias("watched"), F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_id % 4 = 2 THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END END AS at FROM events""")
def iso_instants(spark, sf_dir):
    """ISO times with Z, without a zone, with an offset, and unreadable ones."""
    n, at = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, F.concat(at, F.lit("Z"))).when(n == 1, at).when(n == 2, F.concat(at, F.lit("+02:00"))).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", N.instant(text).cast("timestamp_ntz").alias("at"))


_P = "o_orderkey, CASE WHEN o_orderkey % 4 != 0 THEN TIMESTAMP '1998-08-02' - to_seconds((o_orderkey % 60)::INTEGER) END AS synced, o_orderkey % 3 = 0 AS here"


@query(f"""WITH p AS (SELECT {_P} FROM orders) SELECT o_orderkey, CASE WHEN synced IS NOT NULL AND TIMESTAMP '1998-08-02' - synced < INTERVAL 30 SECONDS THEN 'skipped' WHEN here THEN 'updated' ELSE 'created' END AS action FROM p""")
def project_sync_actions(spark, sf_dir):
    n = F.col("o_orderkey")
    synced = F.when(n % 4 != 0, _now() - F.make_dt_interval(secs=(n % 60).cast("decimal(18,6)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", workflow.sync_action(_now(), synced, n % 3 == 0).alias("action"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN TIMESTAMP '1995-01-01' END AS last, o_orderdate AS changed, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1994-01-01' END AS file FROM orders)
SELECT winner, count(*)::BIGINT AS n FROM (SELECT CASE WHEN changed > last AND file > last THEN 'conflict' WHEN changed > last THEN 'row' WHEN file > last THEN 'file' ELSE 'none' END AS winner FROM p) GROUP BY 1""")
def sync_conflicts(spark, sf_dir):
    n, at = F.col("o_orderkey"), lambda s: F.lit(s).cast("timestamp_ntz")
    winner = workflow.sync_conflict(F.when(n % 5 != 0, at("1995-01-01")), F.col("o_orderdate"), F.when(n % 2 == 0, at("1996-01-01")).otherwise(at("1994-01-01")))
    return table(spark, sf_dir, "orders").groupBy(winner.alias("winner")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, (o_orderkey % 5 + left(o_orderpriority, 1)::INTEGER < 5) AND o_orderkey % 7 >= 4 AS silent, TIMESTAMP '1998-08-02' - o_orderdate <= INTERVAL 7 DAYS AS rollback, CASE WHEN o_orderkey % 9 = 0 THEN true ELSE TIMESTAMP '1998-08-02' - o_orderdate > INTERVAL 12 HOURS END AS due FROM orders""")
def project_gates(spark, sf_dir):
    """Whether a project is asked about no more, can be rolled back, and its job is due."""
    n, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    quiet = workflow.stop_asking(n % 5, F.substring("o_orderpriority", 1, 1).cast("int"), n % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", quiet.alias("silent"), workflow.rollback_allowed(_now(), at).alias("rollback"), workflow.due(_now(), F.when(n % 9 != 0, at), "INTERVAL 12 HOURS").alias("due"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'question' WHEN event_id % 3 = 1 THEN 'escalation' END AS message_type,
CASE WHEN event_id % 3 = 0 THEN 'Approve project proposal **' || event_type || '** (confidence ' || CASE WHEN event_id % 2 = 0 THEN '0.' || lpad((event_id % 100)::VARCHAR, 2, '0') ELSE 'unknown' END || ')?' || chr(10) || 'Reply `approve` or `reject`.' WHEN event_id % 3 = 1 THEN 'Proposal escalation for **' || event_type || '**.' || chr(10) || 'Review when you can.' END AS text,
CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS expects_response FROM events""")
def intent_messages(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "project_approval_request").when(n % 3 == 1, "proposal_escalation").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", workflow.intent_message(kind, F.col("event_type"), F.when(n % 2 == 0, n % 100 / 100)).alias("m")).select("event_id", "m.*")


@query("""SELECT fate, count(*)::BIGINT AS n FROM (SELECT CASE WHEN user_id % 3 = 1 THEN 'left' WHEN user_id % 5 = 0 THEN 'failed' ELSE 'sent' END AS fate FROM events) GROUP BY 1""")
def delivery_fates(spark, sf_dir):
    u = F.col("user_id")
    fate = workflow.delivery(F.when(u % 3 == 1, "scout").when(u % 3 == 2, "project_manager").otherwise(""), F.when(u % 5 != 0, u.cast("string")))
    return table(spark, sf_dir, "events").groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS hits, count(*) FILTER (WHERE event_type != 'click')::BIGINT AS misses, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS rate FROM events GROUP BY 1""")
def cache_hit_rates(spark, sf_dir):
    return workflow.hit_rate(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "click")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END, 5)::INTEGER AS daily_limit, coalesce(CASE WHEN c_custkey % 6 = 0 THEN 'off' END, 'on') AS reminders FROM customer""")
def notification_preferences(spark, sf_dir):
    users = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    known = users.where(n % 3 == 0).select("c_custkey", (n % 10).cast("int").alias("daily_limit"), F.when(n % 6 == 0, "off").alias("reminders"))
    return workflow.with_defaults(users, known, "c_custkey", {"daily_limit": 5, "reminders": "on"})


@query("""SELECT doc_id, 'v1:m:100:1000:' || sha256(text) AS chunk_key, 'doc-summary-v1:m:300:0.2:' || sha256(text) AS summary_key, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS profile_hash, sha256('project:' || doc_id || ':2024-01-31') AS rollback_token FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def state_keys(spark, sf_dir):
    """Keys of cached boundaries, digests of profiles (JSON with sorted keys) and tokens."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    return d.select("doc_id", I.boundary_key(F.col("text"), "v1", "m", 100, 1000).alias("chunk_key"), I.summary_key(F.col("text"), "m", 300, 0.2).alias("summary_key"), I.profile_hash("source", "lang").alias("profile_hash"), I.rollback_token("project", F.col("doc_id"), "2024-01-31").alias("rollback_token"))


_NEAR = """WITH dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS cen FROM dims GROUP BY 1),
r AS (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], cen), 6), e.vec_id) AS rank FROM embeddings e JOIN c USING (label) WHERE e.label IS NOT NULL QUALIFY rank <= 3)"""


@query(_NEAR + """ SELECT label, md5(string_agg(text, chr(10) ORDER BY rank)) AS digest, sum(length(text))::BIGINT AS n_chars FROM r JOIN documents ON doc_id = vec_id GROUP BY 1""")
def cluster_texts(spark, sf_dir):
    """The text that stands for a cluster: its three nearest chunks, joined."""
    near = clusters.representatives(table(spark, sf_dir, "embeddings").where("label is not null"), "label", "embedding", "vec_id", 3)
    both = near.join(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return both.groupBy("label").agg(F.md5(F.array_join(parts, "\n")).alias("digest"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH w AS (SELECT doc_id, lang, text, length(regexp_replace(trim(text), '[^.!?]$', '', 'g')) = length(trim(text)) AS ends FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)
SELECT '# Chunks of ' || lang || chr(10) || '- Number: ' || count(*) || chr(10) || '- Avg size: ' || printf('%.0f', round(avg(length(text)), 0)) || chr(10) || '- Ends well: ' || printf('%.1f', round(100.0 * sum(ends::INTEGER) / count(*), 1)) || '%' AS report FROM w GROUP BY lang""")
def quality_report(spark, sf_dir):
    """Lines of the chunk report, one report a language."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    ends = F.avg(F.trim("text").rlike(r"[.!?]\z|\A\z").cast("double"))
    lines = F.format_string("# Chunks of %s\n- Number: %d\n- Avg size: %.0f\n- Ends well: %.1f%%", "lang", F.count("*"), F.round(F.avg(F.length("text")), 0), F.round(100 * ends, 1))
    return d.groupBy("lang").agg(lines.alias("report")).select("report")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, turn % 3 + 1 AS level, repeat('#', (turn % 3 + 1)::INTEGER) || ' t' || turn AS head, length(repeat('#', (turn % 3 + 1)::INTEGER) || ' t' || turn) + 2 + turn % 4 AS n FROM conversations), h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(n) OVER (PARTITION BY conv_id)::BIGINT AS total FROM t)
SELECT h.conv_id, h.head, h.start, (SELECT coalesce(min(k.start), h.total) FROM h k WHERE k.conv_id = h.conv_id AND k.start > h.start AND k.level <= h.level)::BIGINT AS stop, (SELECT coalesce(max(k.start), -1) FROM h k WHERE k.conv_id = h.conv_id AND k.start < h.start AND k.level < h.level)::BIGINT AS parent FROM h""")
def heading_outline(spark, sf_dir):
    """Headings of three ranks as a tree: the extent of each with all below it, and the heading above."""
    ship(spark)
    n = F.col("turn")
    part = F.concat(F.repeat(F.lit("#"), (n % 3 + 1).cast("int")), F.lit(" t"), n.cast("string"), F.lit("\n"), F.repeat(F.lit("x"), (n % 4).cast("int")), F.lit("\n"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("part", part)
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda s: s["part"]), "")
    tree = structure.heading_tree(turns.groupBy("conv_id").agg(note.alias("note")), "conv_id", "note")
    head = F.concat(F.repeat(F.lit("#"), F.col("node.level")), F.lit(" "), "node.title")
    return tree.select("conv_id", head.alias("head"), "node.start", F.col("node.end").alias("stop"), F.coalesce("node.parent", F.lit(-1)).alias("parent"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 300)) AS cut FROM documents WHERE text != '') SELECT doc_id, cut, (strpos(text, substring(text, (cut + 1)::INTEGER, 100)) - 1)::BIGINT AS position FROM c""")
def structure_backfill(spark, sf_dir):
    """Places of chunks that were stored without any, found by their first characters."""
    d = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", "text")
    cut = F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(300).cast("long"))
    chunks = d.select("doc_id", "text", F.explode(cut).alias("cut")).select("doc_id", "cut", F.expr("substring(text, cast(cut + 1 as int), 300)").alias("chunk"))
    return structure.backfill(chunks, d, "doc_id", "text", "chunk").select("doc_id", "cut", "position")


@query("""SELECT count(*)::BIGINT AS total_files, count(*) FILTER (WHERE trim(coalesce(text, '')) != '')::BIGINT AS files_processed, count(*) FILTER (WHERE trim(coalesce(text, '')) = '')::BIGINT AS files_skipped, coalesce(sum(CASE WHEN trim(coalesce(text, '')) != '' THEN (len(regexp_split_to_array(trim(text, ' \\t\\n\\r\\x0B\\x0C'), '[\\x09-\\x0D\\x20]+')) + 499) // 500 END), 0)::BIGINT AS total_chunks FROM documents""".replace("\\t", "' || chr(9) || '").replace("\\n", "' || chr(10) || '").replace("\\r", "' || chr(13) || '").replace("\\x0B", "' || chr(11) || '").replace("\\x0C", "' || chr(12) || '"))
def ingest_stats(spark, sf_dir):
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    words = F.size(F.split(F.regexp_replace("text", rf"^{N.BLANK}|{N.BLANK}$", ""), N.BLANK))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total_files"), one(~blank).alias("files_processed"), one(blank).alias("files_skipped"), one(F.when(~blank, F.floor((words + 499) / 500))).alias("total_chunks"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN (event_id % 8)::VARCHAR END WHEN event_id % 4 != 0 THEN event_type END AS answer FROM events""")
def typed_replies(spark, sf_dir):
    n = F.col("event_id")
    question = F.when(n % 3 == 0, "importance").when(n % 3 == 1, "urgency").otherwise("description")
    text = F.when(n % 3 < 2, F.concat(F.lit(" "), (n % 8).cast("string"), F.lit(" "))).when(n % 4 != 0, F.concat(F.lit("  "), "event_type")).otherwise("  ")
    return table(spark, sf_dir, "events").select("event_id", workflow.typed_reply(question, text).alias("answer"))


@query("""SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN NOT (s > 500) THEN 'unchanged' WHEN user_id % 4 = 3 THEN 'failed' WHEN user_id % 5 = 0 THEN 'skipped' ELSE 'updated' END AS outcome FROM (SELECT user_id, round(sum(value), 2) AS s FROM events GROUP BY 1)) GROUP BY 1""")
def delta_outcomes(spark, sf_dir):
    u = F.col("user_id")
    snapshots = table(spark, sf_dir, "events").groupBy("user_id").agg((F.round(F.sum("value"), 2) > 500).alias("changed"))
    digest = F.sha2(u.cast("string"), 256)
    outcome = workflow.delta_outcome(F.col("changed"), u % 4, F.when(u % 5 == 0, digest), digest)
    return snapshots.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT 'proposal_escalation:' || o_custkey AS message_id, 'discovery:' || o_custkey AS context_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 != 0""")
def proposal_escalations(spark, sf_dir):
    """Rejected proposals (orders with status F); every third discovery was escalated before."""
    proposals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("discovery_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("open").alias("status"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("proposal_escalation:"), F.col("c_custkey").cast("string")).alias("message_id"))
    return workflow.escalations(proposals, known)


@query("""WITH n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 != 0), e AS (SELECT c_custkey AS source, c_custkey + 1 AS target, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS kind FROM customer) SELECT source, target, kind FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def graph_merge(spark, sf_dir):
    """Edges after a merge: nodes that come again bring new edges, and edges without both ends are dropped."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    at = lambda s: F.lit(s).alias("updated_at")
    edge = lambda df, kind: df.select(k.alias("source"), (k + 1).alias("target"), F.lit(kind).alias("kind"))
    nodes, again = c.where(k % 10 != 0), c.where((k % 4 == 0) & (k % 10 != 0))
    _, edges = sinks.merge_graph(nodes.select(k.alias("id"), at("2024-01-01")), edge(c, "old"), again.select(k.alias("id"), at("2024-01-02")), edge(c.where(k % 4 == 0), "new"))
    return edges


@query("""SELECT status, attempts, count(*)::BIGINT AS n FROM (SELECT CASE WHEN s = 0 AND e = 'delivered' THEN CASE WHEN w THEN 'awaiting_response' ELSE 'delivered' END WHEN s = 0 AND e = 'error' THEN CASE WHEN a + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN s = 1 AND e = 'response' THEN 'delivered' WHEN s = 2 AND e = 'requeue' THEN 'pending' ELSE ['pending', 'awaiting_response', 'failed'][s + 1] END AS status,
CASE WHEN s = 0 AND e = 'error' THEN a + 1 WHEN s = 2 AND e = 'requeue' THEN 0 ELSE a END AS attempts FROM (SELECT event_id % 3 AS s, event_id % 4 AS a, ['delivered', 'error', 'response', 'requeue'][user_id % 4 + 1] AS e, event_id % 2 = 0 AS w FROM events)) GROUP BY 1, 2""")
def outbox_steps(spark, sf_dir):
    pick = lambda c, *xs: F.element_at(F.array(*map(F.lit, xs)), (c + 1).cast("int"))
    n = F.col("event_id")
    step = workflow.outbox_step(pick(n % 3, "pending", "awaiting_response", "failed"), n % 4, pick(F.col("user_id") % 4, "delivered", "error", "response", "requeue"), n % 2 == 0)
    return table(spark, sf_dir, "events").select(step.alias("s")).groupBy("s.status", "s.attempts").agg(F.count("*").alias("n"))


def _lloyd_sql(rest: int, k: int) -> str:
    return f"""(WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = {rest}), d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM v), c0 AS (SELECT vec_id AS cluster, embedding::DOUBLE[] AS c FROM v ORDER BY vec_id LIMIT {k}),
s0 AS (SELECT d.vec_id, cluster, round(sum((x - c[dim]) ^ 2), 6) AS q FROM d, c0 GROUP BY ALL), a0 AS (SELECT vec_id, cluster FROM s0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, cluster) = 1),
m1 AS (SELECT cluster, dim, avg(x) AS mean FROM d JOIN a0 USING (vec_id) GROUP BY ALL), c1 AS (SELECT cluster, list(mean ORDER BY dim) AS c FROM m1 GROUP BY cluster),
s1 AS (SELECT d.vec_id, cluster, round(sum((x - c[dim]) ^ 2), 6) AS q FROM d, c1 GROUP BY ALL), a1 AS (SELECT vec_id, cluster FROM s1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, cluster) = 1) SELECT cluster, count(*)::BIGINT AS n FROM a1 GROUP BY cluster)"""


@query(f"SELECT 'notes' AS collection, cluster, n FROM {_lloyd_sql(0, 3)} UNION ALL SELECT 'mail', cluster, n FROM {_lloyd_sql(1, 5)}")
def dual_collection_clusters(spark, sf_dir):
    """Two collections (even and odd ids), each clustered with its own k; sizes by collection and cluster."""
    vecs, out = table(spark, sf_dir, "embeddings"), None
    for name, rest, k in (("notes", 0, 3), ("mail", 1, 5)):
        part = clusters.lloyd(vecs.where(F.col("vec_id") % 2 == rest), "vec_id", "embedding", k, 2).groupBy("cluster").agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "cluster", "n")
        out = part if out is None else out.unionByName(part)
    return out
