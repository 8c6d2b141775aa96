"""Decisions about projects, messages and periodic jobs, as ordered conditions and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import notes as N
from corpusgraph.functions import projects as P
from corpusgraph.operators.gatekeeper import DIRECT


def sync_action(now: Column, last_synced: Column, exists: Column, dry_run: bool = False, cooldown: str = "INTERVAL 30 SECONDS") -> Column:
    """What writing a project's note does: nothing within the cooldown, else create or update (or would, in a dry run)."""
    would = "would_create,would_update" if dry_run else "created,updated"
    create, update = would.split(",")
    return F.when(last_synced.isNotNull() & (now - last_synced < F.expr(cooldown)), "skipped").when(exists, update).otherwise(create)


def sync_conflict(last_synced: Column, row_changed: Column, file_changed: Column, strategy: str = "manual") -> Column:
    """Who wins: both sides changed since the last sync is a conflict, which the strategy settles."""
    settled = {"row_wins": "row", "file_wins": "file", "manual": "conflict"}[strategy]
    row, file = F.coalesce(row_changed > last_synced, F.lit(False)), F.coalesce(file_changed > last_synced, F.lit(False))
    return F.when(row & file, settled).when(row, "row").when(file, "file").otherwise("none")


def stop_asking(importance: Column, urgency: Column, unanswered: Column) -> Column:
    return (importance + urgency < 5) & (unanswered >= 4)


def due(now: Column, last_run: Column, interval: str) -> Column:
    """A job that never ran is due; else when more than the interval has passed."""
    return last_run.isNull() | (now - last_run > F.expr(interval))


def rollback_allowed(now: Column, created: Column, window: str = "INTERVAL 7 DAYS") -> Column:
    return now - created <= F.expr(window)


def intent_message(kind: Column, candidate: Column, confidence: Column) -> Column:
    """(message_type, text, expects_response) of an intent; null for unknown kinds, which stay pending."""
    shown = F.when(confidence.isNull(), "unknown").otherwise(F.format_string("%.2f", confidence))
    ask = F.concat(F.lit("Approve project proposal **"), F.coalesce(candidate, F.lit("project")), F.lit("** (confidence "), shown, F.lit(")?\nReply `approve` or `reject`."))
    tell = F.concat(F.lit("Proposal escalation for **"), F.coalesce(candidate, F.lit("proposal")), F.lit("**.\nReview when you can."))
    row = lambda t, text, answer: F.struct(F.lit(t).alias("message_type"), text.alias("text"), F.lit(answer).alias("expects_response"))
    return F.when(kind == "project_approval_request", row("question", ask, True)).when(kind == "proposal_escalation", row("escalation", tell, False))


def delivery(agent: Column, chat: Column, sender: str = "project_manager") -> Column:
    """What a poll does with a pending message: others' are left, those without a chat fail."""
    return F.when((agent != "") & (agent != sender), "left").when(F.coalesce(chat, F.lit("")) == "", "failed").otherwise("sent")


def hit_rate(lookups: DataFrame, group: list[str], hit: Column) -> DataFrame:
    """Hits, misses and their rate; 0 where nothing was looked up."""
    n = F.count("*")
    hits = F.coalesce(F.sum(hit.cast("long")), F.lit(0))
    return lookups.groupBy(*group).agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n == 0, 0.0).otherwise(F.round(hits / n, 6)).alias("rate"))


def with_defaults(users: DataFrame, preferences: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every user's preferences, with defaults where there is no row or no value."""
    both = users.select(key).join(preferences, key, "left")
    return both.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def typed_reply(question: Column, text: Column) -> Column:
    """A reply's value as text: whole numbers from 1 to 5 for importance and urgency, else the trimmed text; null if it doesn't fit."""
    said = F.trim(text)
    number = F.when(said.rlike("^[1-5]$"), said)
    return F.when(question.isin("importance", "urgency"), number).when(said != "", said)


def delta_outcome(changed: Column, attempts_failed: Column, old_hash: Column, new_hash: Column, retries: int = 2) -> Column:
    """What became of a cluster: unchanged, failed (all retries used up), skipped (same profile) or updated."""
    return F.when(~changed, "unchanged").when(attempts_failed > retries, "failed").when(old_hash.eqNullSafe(new_hash), "skipped").otherwise("updated")


def escalations(proposals: DataFrame, intents: DataFrame) -> DataFrame:
    """(message_id, context_id) of rejected proposals that have no intent yet."""
    rejected = proposals.where("status = 'rejected'").select("discovery_id").distinct()
    new = rejected.select(F.concat(F.lit("proposal_escalation:"), F.col("discovery_id").cast("string")).alias("message_id"), F.concat(F.lit("discovery:"), F.col("discovery_id").cast("string")).alias("context_id"))
    return new.join(intents.select("message_id"), "message_id", "left_anti")


def outbox_step(status: Column, attempts: Column, event: Column, wants_answer: Column, most: int = 3) -> Column:
    """A message's next (status, attempts) after one event: delivered, error, response or requeue; other events change nothing."""
    pair = lambda s, n: F.struct(s.alias("status"), n.alias("attempts"))
    sent = F.when(wants_answer, "awaiting_response").otherwise("delivered")
    failed = F.when(attempts + 1 >= most, "failed").otherwise("pending")
    return (
        F.when((status == "pending") & (event == "delivered"), pair(sent, attempts)).when((status == "pending") & (event == "error"), pair(failed, attempts + 1))
        .when((status == "awaiting_response") & (event == "response"), pair(F.lit("delivered"), attempts)).when((status == "failed") & (event == "requeue"), pair(F.lit("pending"), 0 * attempts))
        .otherwise(pair(status, attempts))
    )


def record_escalations(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """Proposals (discovery_id, status, confidence) after new intents (message_id, context_id): escalated, with the confidence at which they were rejected."""
    ids = new.select(F.regexp_replace("context_id", "^discovery:", "").alias("_id")).distinct()
    both = proposals.withColumn("_id", F.col("discovery_id").cast("string")).join(ids.withColumn("_new", F.lit(True)), "_id", "left")
    return both.select("discovery_id", F.when(F.col("_new"), "escalated").otherwise(F.col("status")).alias("status"), "confidence", F.when(F.col("_new"), F.col("confidence")).alias("rejected_confidence"))


def delta_counts(outcomes: DataFrame, cache: DataFrame, result: str = "result_json") -> DataFrame:
    """One row of counts of a delta sync's outcomes (cluster_id, outcome); an updated cluster's cached answers (cluster_id, result) go.

    The cache's rows are joined by the cluster that they were stored for; the JSON decides whether they mention it.
    """
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counts = outcomes.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") != "unchanged").alias("changed"), n("updated").alias("processed"), n("skipped").alias("skipped"),
        n("updated").alias("profile_updates"), n("updated").alias("graph_updates"), n("failed").alias("failed"),
    )
    gone = outcomes.where("outcome = 'updated'").select("cluster_id").join(cache, "cluster_id").where(F.get_json_object(result, "$.cluster_id") == F.col("cluster_id"))
    return counts.crossJoin(gone.agg(F.count("*").alias("cache_invalidations")))


def files_to_projects(files: DataFrame, projects: DataFrame, now: Column, strategy: str = "manual") -> tuple[DataFrame, DataFrame]:
    """(projects, outcomes) after notes (file, note, changed_at) are read back into rows (id, ..., updated_at, synced_at).

    A note without an id, or of an unknown project, is unreadable; a note of a row that changed as well is a conflict; of the
    others the fields that a user may set and that are given are taken over.
    """
    read = files.withColumn("_m", P.parse(F.col("note"))).withColumn("id", F.col("_m")["id"].try_cast(projects.schema["id"].dataType))
    both = read.join(projects.select("id", F.col("updated_at").alias("_row"), F.col("synced_at").alias("_last"), F.lit(True).alias("_known")), "id", "left")
    winner = sync_conflict(F.col("_last"), F.col("_row"), F.col("changed_at"), strategy)
    outcomes = both.withColumn("outcome", F.when(F.col("_known").isNull(), "unreadable").when(winner == "conflict", "conflict").when(winner == "file", "updated").otherwise("skipped"))
    given = outcomes.where("outcome = 'updated'").select("id", F.col("_m").alias("_new"))
    fields = [c for c in DIRECT if c in projects.columns]
    after = projects.join(given, "id", "left")
    new = {c: F.coalesce(F.col("_new")[c].try_cast(projects.schema[c].dataType), F.col(c)) for c in fields}
    new["updated_at"] = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))
    return after.withColumns(new).select(*projects.columns), outcomes.select("file", "id", "outcome")


def copy_back(shadow: DataFrame, source: DataFrame) -> DataFrame:
    """(key, action) of shadow files (key, digest, approved): copied to their source once approved, waiting until then, or the same."""
    both = shadow.join(source.select("key", F.col("digest").alias("_own")), "key", "left")
    return both.select("key", F.when(F.col("digest").eqNullSafe(F.col("_own")), "same").when(F.col("approved"), "copied").otherwise("waiting").alias("action"))


def synthesize(rows: DataFrame, answers: list[Column], strict: bool = False) -> DataFrame:
    """(cluster_id, status, theme_summary, topics) of clusters (cluster_id, notes, keywords) by a model's answers, the first readable one.

    Without notes, or with no readable answer where it must be JSON (``strict``), a cluster fails; else its notes and keywords
    stand in.
    """
    read = [N.lenient_json(a, "theme_summary string, dominant_topics array<string>") for a in answers]
    good = F.coalesce(*[F.when(F.coalesce(r["theme_summary"], F.lit("")) != "", r) for r in read])
    blank = F.coalesce(F.trim("notes"), F.lit("")) == ""
    failed = blank | (F.lit(strict) & good.isNull())
    return rows.select(
        "cluster_id", F.when(failed, "failed").otherwise("success").alias("status"), F.when(~failed, F.coalesce(good["theme_summary"], N.summary(F.col("notes"), F.col("keywords")))).alias("theme_summary"),
        F.when(~failed, F.coalesce(good["dominant_topics"], F.col("keywords"))).alias("topics"),
    )
