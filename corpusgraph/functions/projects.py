"""Project notes: rows written as Markdown with front matter and read back, tags, times as they are shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a project's front matter in their order; those of OPTIONAL are left out where they are null.
FIELDS = ["id", "title", "discovered_by", "discovery_id", "cluster_ids", "confidence_score", "status", "importance", "urgency", "deadline", "work_estimate", "pressure_score", "verified_by_user", "created_at", "updated_at"]
OPTIONAL = ["importance", "urgency", "deadline", "work_estimate", "pressure_score", "verified_by_user"]
ISO, SHOWN = "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss 'UTC'"


def iso(at: Column) -> Column:
    return F.date_format(at, ISO)


def shown(at: Column) -> Column:
    """A time as users see it; N/A where there is none."""
    return F.coalesce(F.date_format(at, SHOWN), F.lit("N/A"))


def percent(x: Column) -> Column:
    """A share as whole percent, cut off as ``int`` does."""
    return F.when(x < 0, F.ceil(x * 100)).otherwise(F.floor(x * 100)).cast("long")


def _plain(text: Column) -> Column:
    """Text as a YAML scalar: quoted where it would be read as something else."""
    odd = text.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |:$| #|\s$|\n|^$") | text.rlike(r"(?i)^(?:true|false|yes|no|on|off|null|~|[-+]?[0-9][0-9_.,:eE+-]*|\d{4}-\d\d-\d\d.*)$")
    return F.when(odd, F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(text)


def front_matter(row: dict[str, Column]) -> Column:
    """The front matter of a project, fields in their order, lists as indented items."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    said = {k: iso(row[k]) if k in ("deadline", "created_at", "updated_at") else row[k] for k in FIELDS}
    parts = []
    for k in FIELDS:
        v = said[k]
        if k == "cluster_ids":
            items = F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), _plain(x.cast("string")))), "\n")
            parts.append(F.when(F.coalesce(F.size(v), F.lit(0)) > 0, F.concat(F.lit(f"{k}:\n"), items)).otherwise(F.lit(f"{k}: []")))
        else:
            text = _plain(v) if k in ("title", "discovered_by", "discovery_id", "status", "deadline", "created_at", "updated_at") else v.cast("string")
            full = line(k, text)
            parts.append(full if k in OPTIONAL else F.coalesce(full, F.lit(f"{k}: null")))
    return F.concat(F.lit("---\n"), F.array_join(F.array(*parts), "\n"), F.lit("\n---\n"))


def note(row: dict[str, Column]) -> Column:
    """The whole note of a project: front matter, title, description, and its sections."""
    item = lambda name, v, end="": F.concat(F.lit(f"- **{name}**: "), v.cast("string"), F.lit(end))
    some = F.coalesce(*[row[k].cast("string") for k in ("importance", "urgency", "deadline", "work_estimate", "pressure_score")]).isNotNull()
    meta = F.array_join(F.array(
        item("Status", F.when(row["status"] != "", row["status"])), item("Importance", row["importance"], "/5"), item("Urgency", row["urgency"], "/5"), item("Deadline", F.date_format(row["deadline"], "yyyy-MM-dd")),
        item("Work Estimate", row["work_estimate"], " hours"), item("Pressure Score", row["pressure_score"]),
    ), "\n")
    found = F.array_join(F.array(
        item("Discovered by", F.coalesce(row["discovered_by"], F.lit("None"))), item("Discovery ID", F.coalesce(row["discovery_id"].cast("string"), F.lit("None"))), item("Confidence", percent(row["confidence_score"]), "%"),
        item("Verified", F.when(row["verified_by_user"], "Yes").when(~row["verified_by_user"], "No")),
    ), "\n")
    times = F.concat(F.lit("- **Created**: "), shown(row["created_at"]), F.lit("\n- **Updated**: "), shown(row["updated_at"]))
    return F.concat(
        front_matter(row), F.lit("\n# "), row["title"], F.lit("\n\n"), F.coalesce(row["description"], F.lit("")), F.lit("\n\n"),
        F.when(some, F.concat(F.lit("## Metadata\n\n"), meta, F.lit("\n\n"))).otherwise(""), F.lit("## Discovery Info\n\n"), found, F.lit("\n\n## Timestamps\n\n"), times, F.lit("\n"),
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where the value is worked out once, however often it is used: inside functions on arrays Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(text: Column) -> Column:
    """A note's front matter as a map of texts: scalars without their quotes, items of lists joined by line breaks, null for null."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    # an item belongs to the key above it
    joined = F.regexp_replace(head, r"\n[ ]*- ", "\u0001")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"(?s)^[A-Za-z_]\w*:(?: |\x01|$)"))

    def scalar(v: Column) -> Column:
        def bare(s: Column) -> Column:
            single, double = s.rlike(r"^'.*'$") & (F.length(s) > 1), s.rlike(r'^".*"$') & (F.length(s) > 1)
            inner = F.substring(s, F.lit(2), F.length(s) - 2)
            return F.when(single, F.replace(inner, F.lit("''"), F.lit("'"))).when(double, inner).when(s.isin("null", "~", "", "[]"), F.lit(None)).otherwise(s)

        return once(F.trim(v), bare)

    def value(rest: Column) -> Column:
        items = F.slice(F.split(rest, "\u0001"), 2, 1 << 20)
        return F.when(F.contains(rest, F.lit("\u0001")), F.array_join(F.transform(items, scalar), "\n")).otherwise(scalar(rest))

    # a key is what stands before the first colon
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), once(F.regexp_replace(x, r"(?s)^\w+:", ""), value).alias("value")))
    first = lambda p: once(p["key"], lambda keys: F.filter(p, lambda e, k: F.array_position(keys, e["key"]) == k + 1))
    return once(pairs, lambda p: F.map_from_entries(first(p)))


def with_tags(text: Column, tags: Column) -> Column:
    """A note whose front matter has these tags in place of its own; a note without front matter gets one."""
    line = F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n?---\n", 1)
    has = text.rlike(r"(?s)\A---\n.*?---\n")
    kept = F.array_join(F.filter(F.split(head, "\n"), lambda x: ~x.startswith("tags:") & (x != "")), "\n")
    body = F.regexp_replace(text, r"(?s)\A---\n.*?---\n", "")
    again = F.concat(F.lit("---\n"), F.when(kept != "", F.concat(kept, F.lit("\n"))).otherwise(""), line, F.lit("\n---\n"), body)
    return F.when(has, again).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), text))
