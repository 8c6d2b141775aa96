"""Proposals become projects: decisions with an audit trail, undoing, direct updates of allowed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import state
from corpusgraph.operators.governance import gate

#: The fields that a user may set directly.
DIRECT = ("importance", "urgency", "deadline", "description", "status", "work_estimate")
AUDIT = ["approval_id", "action", "approved", "reason", "changes", "decided_by"]


def _audit(rows: DataFrame, approval: Column, action: str, approved: bool | None, reason: Column, changes: Column, by: str) -> DataFrame:
    return rows.select(approval.cast("string").alias("approval_id"), F.lit(action).alias("action"), F.lit(approved).cast("boolean").alias("approved"), reason.cast("string").alias("reason"), changes.cast("string").alias("changes"), F.lit(by).alias("decided_by"))


def project_rows(proposals: DataFrame) -> DataFrame:
    """Approved proposals as projects; one without a title is named after its candidate."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("Project "), F.col("candidate_key")))
    return proposals.select(title.alias("title"), "discovery_id", "confidence", F.lit("candidate").alias("status"))


def process(proposals: DataFrame, projects: DataFrame, reject_below: float = 0.60, approve_from: float = 0.90) -> dict[str, DataFrame]:
    """Decides pending proposals (discovery_id, candidate_key, title, confidence, status).

    Returns proposals (with their new status), projects (an existing one of a discovery stays), audit rows and intents (what the
    user is asked).
    """
    none = F.lit(None)
    decided = proposals.withColumn("_d", F.when(F.col("status") == "pending", gate(F.col("confidence"), reject_below, approve_from)))
    status = F.when(F.col("_d") == "reject", "rejected").when(F.col("_d") == "approve", "approved").when(F.col("_d") == "ask", "awaiting_approval").otherwise(F.col("status"))
    yes, no, ask = (decided.where(F.col("_d") == d) for d in ("approve", "reject", "ask"))
    audit = _audit(yes, F.col("discovery_id"), "decision", True, none, none, "gatekeeper").unionByName(_audit(no, F.col("discovery_id"), "decision", False, F.lit("auto_reject"), none, "gatekeeper"))
    intents = ask.select(F.concat(F.lit("project_approval:"), F.col("discovery_id").cast("string")).alias("message_id"), F.concat(F.lit("discovery:"), F.col("discovery_id").cast("string")).alias("context_id"), "confidence")
    return {"proposals": decided.withColumn("status", status).drop("_d"), "projects": state.insert_absent(projects, project_rows(yes), ["discovery_id"], ["title"]), "audit": audit, "intents": intents}


def decide(proposals: DataFrame, projects: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """A user's answers (discovery_id, decision, reason): approve or reject; answers to unknown proposals come back as errors."""
    known = answers.join(proposals.drop("status"), "discovery_id")
    yes, no = known.where("decision = 'approve'"), known.where("decision = 'reject'")
    audit = _audit(yes, F.col("discovery_id"), "decision", True, F.lit(None), F.lit(None), "gatekeeper").unionByName(_audit(no, F.col("discovery_id"), "decision", False, F.coalesce("reason", F.lit("manual_reject")), F.lit(None), "gatekeeper"))
    said = answers.select("discovery_id", F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").alias("_s")).where("_s is not null").dropDuplicates(["discovery_id"])
    after = proposals.join(said, "discovery_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*proposals.columns)
    return {"proposals": after, "projects": state.insert_absent(projects, project_rows(yes), ["discovery_id"], ["title"]), "audit": audit, "errors": answers.join(proposals.select("discovery_id"), "discovery_id", "left_anti")}


def request_rollback(projects: DataFrame, tokens: DataFrame, asked: DataFrame, now: Column, window: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Tokens (project_id, token, requested_at) after requests (project_id) to undo projects (project_id, created_at) that are young enough; a new token replaces an old one."""
    young = asked.select("project_id").distinct().join(projects, "project_id").where(now - F.col("created_at") <= F.expr(window))
    made = young.select("project_id", F.sha2(F.concat_ws(":", F.col("project_id").cast("string"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")), 256).alias("token"), now.alias("requested_at"))
    return state.upsert(tokens, made, ["project_id"], ["requested_at"])


def confirm_rollback(tables: dict[str, DataFrame], tokens: DataFrame, given: DataFrame) -> dict[str, DataFrame]:
    """Tables keyed by project_id, and the tokens, without the projects whose given token (project_id, token) is the right one."""
    gone = given.join(tokens.select("project_id", "token"), ["project_id", "token"], "left_semi").select("project_id").distinct()
    return {name: state.delete_keys(t, gone, ["project_id"]) for name, t in {**tables, "tokens": tokens}.items()}


def allowed_changes(changes: DataFrame, asked_by_user: Column) -> DataFrame:
    """Changes (key, field, value) of each key with ``error``: null where all of the key's fields may be set directly."""
    bad = F.array_sort(F.array_except(F.collect_set("field"), F.array(*map(F.lit, DIRECT))))
    per = changes.groupBy("key").agg(bad.alias("_bad"), F.min(asked_by_user).alias("_user"))
    why = F.when(~F.col("_user"), "direct updates are for users").when(F.size("_bad") > 0, F.concat(F.lit("not allowed: "), F.array_join("_bad", ", ")))
    return changes.join(per.select("key", why.alias("error")), "key")


def update_direct(projects: DataFrame, changes: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(projects, audit) after valid changes (key, field, value as text): all fields of a key at once; unknown keys change nothing."""
    fields = [c for c in DIRECT if c in projects.columns]
    valid = changes.where("error is null")
    wide = valid.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "value")))).alias("_m"))
    both = projects.join(wide.withColumnRenamed("key", key), key, "left")
    has = lambda c: F.coalesce(F.map_contains_key("_m", F.lit(c)), F.lit(False))
    new = {c: F.when(has(c), F.col("_m")[c].cast(projects.schema[c].dataType)).otherwise(F.col(c)) for c in fields}
    new["updated_at"] = F.when(F.col("_m").isNotNull(), at).otherwise(F.col("updated_at"))
    audit = _audit(both.where("_m is not null"), F.lit(None), "direct_update", None, F.lit(None), F.to_json(F.col("_m")), "telegram_user")
    return both.withColumns(new).select(*projects.columns), audit
