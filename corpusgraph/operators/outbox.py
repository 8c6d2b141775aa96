"""Messages to users: what may be queued, the questions' texts, who a reply belongs to, what a reply does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import notes as N
from corpusgraph.operators import state
from corpusgraph.operators.ranking import first_per_key, top_per_group
from corpusgraph.operators.workflow import typed_reply

#: Kinds of messages, and the agent that may write to users.
KINDS, SENDER = ("notification", "approval_request", "escalation", "question"), "project_manager"
#: The texts of questions and reminders; {} are filled from a project's row.
TEXTS = {
    "importance": "📊 **New Project Discovered: {title}**\n\nHow important is this project to you? (Rate importance from 1-5)\n\n• 1 = Nice to have\n• 3 = Moderately important\n• 5 = Critical/High impact\n\nReply with a number 1-5.",
    "urgency": "⏰ **Project: {title}**\n\nHow urgent is this project? (Rate urgency from 1-5)\n\n• 1 = Can wait months\n• 3 = Should do in weeks\n• 5 = Needs attention ASAP\n\nReply with a number 1-5.",
    "deadline": "📅 **High Priority Project: {title}**\n\nThis project has high importance ({importance}) and urgency ({urgency}).\n\nDo you have a target deadline?\n\nReply with:\n• A date (e.g., \"2026-03-15\" or \"March 15\")\n• A duration (e.g., \"2 weeks\" or \"1 month\")\n• \"no deadline\" if flexible",
    "description": "📝 **Project: {title}**\n\nCan you describe this project in more detail?\n\nWhat specifically needs to be done?\n\nReply with a brief description.",
    "critical_deadline": "🚨 **Urgent: {title}**\n\nDeadline is in {hours} hours!\n\nThis is a high-priority project (importance: {importance}, urgency: {urgency}).\n\nJust a heads up! 👍",
    "gentle": "👋 Hey! Just a gentle reminder about **{title}**\n\nNo pressure, but when you have a moment, could you share the {question} for this project?\n\nThanks! 😊",
    "escalated": "⚡ **Important: {title}**\n\nThis is a high-priority project (importance: {importance}, urgency: {urgency}).\n\nCould you help me understand the {question} for this project?\nIt would really help with planning!\n\nThanks for your time! 🙏",
}


def message_text(kind: str, fields: dict[str, Column]) -> Column:
    """One of the texts with a row's values; null values are written as None."""
    parts, rest = [], TEXTS[kind]
    while "{" in rest:
        said, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(said), F.coalesce(fields[name].cast("string"), F.lit("None"))]
    return F.concat(*parts, F.lit(rest))


def invalid(kind: Column, payload: Column, agent: Column) -> Column:
    """Why a message can't be queued; null if it can."""
    empty = F.coalesce(F.trim(payload), F.lit("")).isin("", "{}")
    return F.when(~F.coalesce(kind, F.lit("")).isin(*KINDS), "invalid message_type").when((F.coalesce(agent, F.lit("")) != "") & (agent != SENDER), "originating_agent must be project_manager").when(empty, "payload cannot be empty")


def enqueue(outbox: DataFrame, messages: DataFrame, order: list[str]) -> DataFrame:
    """The outbox (message_id, message_type, originating_agent, context_id, payload) with the valid messages whose id is new.

    A message without an id gets ``type:context:`` and a digest of what it says, so that the same rows give the same ids.
    """
    own = F.concat_ws(":", "message_type", F.coalesce("context_id", F.lit("none")), F.substring(F.sha2(F.concat_ws("|", "payload", *[F.col(c).cast("string") for c in order]), 256), 1, 16))
    fit = messages.where(invalid(F.col("message_type"), F.col("payload"), F.col("originating_agent")).isNull()).withColumn("message_id", F.coalesce(F.when(F.col("message_id") != "", F.col("message_id")), own))
    return state.insert_absent(outbox, fit.select(*dict.fromkeys([*outbox.columns, *order])), ["message_id"], [c for c in order if c in outbox.columns] or ["message_id"])


def payload(json: Column, default_chat: str) -> Column:
    """(chat_id, text, parse_mode, buttons) of a queued message: a missing chat is the default one, a missing text empty.

    Buttons without a text or data are left out.
    """
    at = lambda path: F.get_json_object(json, path)
    found = F.from_json(at("$.buttons"), "array<struct<text:string,callback_data:string,data:string>>")
    made = F.transform(found, lambda b: F.struct(b["text"].alias("text"), F.coalesce(b["callback_data"], b["data"]).alias("data")))
    buttons = F.coalesce(F.filter(made, lambda b: (F.coalesce(b["text"], F.lit("")) != "") & b["data"].isNotNull()), F.array().cast("array<struct<text:string,data:string>>"))
    chat = at("$.chat_id")
    return F.struct(F.when(F.coalesce(chat, F.lit("")) != "", chat).otherwise(default_chat).alias("chat_id"), F.coalesce(at("$.text"), F.lit("")).alias("text"), at("$.parse_mode").alias("parse_mode"), buttons.alias("buttons"))


def asked_by(replies: DataFrame, outbox: DataFrame) -> DataFrame:
    """Replies (reply_id, chat_id, reply_to) with the message (message_id, context_id, ...) that they answer.

    A reply to a message belongs to it if that awaits an answer; one without belongs to the chat's only open question. Of
    messages with one place in a chat, the one with the smallest id counts.
    """
    open_ = outbox.where("expects_response and status = 'awaiting_response'").select("message_id", "chat_id", "place", "context_id", "question")
    direct = first_per_key(open_.where("place is not null"), ["chat_id", "place"], ["message_id"])
    lone = open_.groupBy("chat_id").agg(F.count("*").alias("n"), F.min(F.struct("message_id", "context_id", "question")).alias("m")).where("n = 1").select("chat_id", "m.*")
    threaded = replies.where("reply_to is not null").join(direct.withColumnRenamed("place", "reply_to"), ["chat_id", "reply_to"])
    return threaded.select(*replies.columns, "message_id", "context_id", "question").unionByName(replies.where("reply_to is null").join(lone, "chat_id").select(*replies.columns, "message_id", "context_id", "question"))


def dispatch(context: Column, question: Column, text: Column) -> Column:
    """(target, key, action, value) of an answer: a decision on a discovery or a value for a project; null if it does nothing."""
    parts, said = F.split(context, ":", 2), F.lower(F.trim(text))
    decision = F.when(said.isin("approve", "approved", "yes"), "approve").when(said.isin("reject", "rejected", "no"), "reject")
    value = typed_reply(question, text)
    row = lambda target, action, v: F.struct(F.lit(target).alias("target"), F.get(parts, F.lit(1)).alias("key"), action.alias("action"), v.alias("value"))
    known = question.isin("importance", "urgency", "deadline", "description")
    return F.when(context.startswith("discovery:") & decision.isNotNull(), row("gatekeeper", decision, F.lit(None).cast("string"))).when(context.startswith("project:") & known & value.isNotNull(), row("project", question, value))


def next_question(importance: Column, urgency: Column, deadline: Column) -> Column:
    """What is asked next about a project; null when nothing is missing."""
    return F.when(importance.isNull(), "importance").when(urgency.isNull(), "urgency").when((importance + urgency >= 7) & deadline.isNull(), "deadline")


def recent(outbox: DataFrame, limit: int = 5, prefix: str = "") -> DataFrame:
    """The last delivered messages of each chat, the latest first, of the kinds that begin with ``prefix``."""
    said = outbox.where(F.col("delivered_at").isNotNull() & F.col("message_type").startswith(prefix))
    return top_per_group(said, ["chat_id"], [F.desc("delivered_at"), F.col("message_id")], limit, ["message_id"])


def about_discovery(kind: Column, json: Column) -> Column:
    return (F.coalesce(F.get_json_object(json, "$.discovery_id"), F.lit("")) != "") | kind.startswith("discovery_")


def allowed(delivered: DataFrame, limits: DataFrame, key: str, at: str, day: Column) -> DataFrame:
    """(key, delivered, allowed) for every key with a limit (key, daily_limit): fewer delivered since midnight; a limit of 0 or less allows none."""
    today = delivered.where((F.col(at) >= day) & (F.col(at) < day + F.expr("INTERVAL 1 DAY"))).groupBy(key).agg(F.count("*").alias("delivered"))
    both = limits.join(today, key, "left").withColumn("delivered", F.coalesce("delivered", F.lit(0).cast("long")))
    return both.select(key, "delivered", ((F.col("daily_limit") > 0) & (F.col("delivered") < F.col("daily_limit"))).alias("allowed"))


def deadline(text: Column, now: Column) -> Column:
    """(readable, at) of an answer about a deadline: none, a duration from now, or a date in one of the usual forms."""
    said = F.trim(F.lower(text))
    none = said.isin("no deadline", "flexible", "none")
    n, unit = F.regexp_extract(said, r"^(\d+)\s*(?:day|week|month)", 1).try_cast("int"), F.regexp_extract(said, r"^\d+\s*(day|week|month)", 1)
    days = n * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    bare = F.regexp_replace(F.regexp_replace(F.initcap(said), r"^(?:By|On|Before|Until|Due)\s+", ""), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    shapes = ["yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
    this_year = F.concat(bare, F.lit(" "), F.year(now).cast("string"))
    tries = [F.try_to_timestamp(bare, F.lit(s)) for s in shapes] + [F.try_to_timestamp(this_year, F.lit(s)) for s in ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")] + [N.instant(text)]
    at = F.when(days.isNotNull(), now + F.make_dt_interval(days=days)).otherwise(F.coalesce(*tries).cast("timestamp_ntz"))
    return F.struct((F.coalesce(none, F.lit(False)) | at.isNotNull()).alias("readable"), F.when(~none, at).alias("at"))


def requeue(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    """The outbox after a request to try failed messages again; other messages stay as they are."""
    asked = ids.select("message_id").distinct().withColumn("_again", F.lit(True))
    again = F.coalesce(F.col("_again"), F.lit(False)) & (F.col("status") == "failed")
    both = outbox.join(asked, "message_id", "left")
    change = {"status": F.when(again, "pending").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))}
    return both.withColumns(change).select(*outbox.columns)
