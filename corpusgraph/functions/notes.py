"""Notes and messages as column expressions: file names, front matter, sections, tags, summaries, codecs, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of the sections that a project note is written with, and the words that hint at a project.
MANAGED = ["Metadata", "Discovery Info", "Timestamps"]
HINTS, HINTED, OTHERWISE = ["project", "draft", "todo"], "#project_candidate", "#needs_review"
BLANK = r"[\x09-\x0D\x20]+"


def file_title(title: Column, longest: int = 100) -> Column:
    """A title as a file name: words joined by hyphens; short lower-case words and acronyms keep their case."""
    bare = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")
    case = lambda w: (
        F.when((w == F.lower(w)) & (w != F.upper(w)) & (F.length(w) <= 3), bare(w))
        .when((w == F.upper(w)) & (w != F.lower(w)) & (F.length(bare(w)) > 1), bare(w))
        .otherwise(F.concat(F.upper(F.substring(bare(w), 1, 1)), F.lower(F.substring(bare(w), 2, 1 << 30))))
    )
    words = F.filter(F.transform(F.split(F.trim(title), BLANK), case), lambda w: w != "")
    return F.regexp_replace(F.substring(F.array_join(words, "-"), 1, longest), "-+$", "")


def front_matter(note: Column) -> Column:
    """The flat ``key: value`` lines of a note's front matter as a map; the first of repeated keys counts; no front matter, an empty map."""
    head = F.regexp_extract(note, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*: "))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.trim(F.regexp_replace(x, r"^\w+: ", "")).alias("value")))
    first = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, 1, k), lambda p: p["key"] == e["key"]))
    return F.map_from_entries(first)


def with_front_matter(fields: dict[str, Column], body: Column) -> Column:
    """A note of the fields that aren't null, and the body."""
    lines = F.array_join(F.array(*[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]), "\n")
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), body)


def custom_sections(note: Column, managed: list[str] = MANAGED) -> Column:
    """The level-two sections whose titles aren't managed, in order, each with its heading; text before the first is none."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), note), "\n## "), 2, 1 << 30)
    own = F.filter(parts, lambda p: ~F.trim(F.substring_index(p, "\n", 1)).isin(managed))
    return F.transform(own, lambda p: F.concat(F.lit("## "), p))


def keep_sections(fresh: Column, old: Column) -> Column:
    """A newly written note with the custom sections of the one that it replaces."""
    own = custom_sections(old)
    return F.when(F.size(own) > 0, F.concat(F.regexp_replace(fresh, BLANK + "$", ""), F.lit("\n\n"), F.array_join(own, "\n\n"))).otherwise(fresh)


def description(note: Column) -> Column:
    """The text between the title and the first section."""
    return F.trim(F.regexp_replace(F.regexp_extract(note, r"(?s)(?:\A|\n)# [^\n]*\n(.*?)(?:\n## |\z)", 1), rf"^{BLANK}|{BLANK}$", ""))


def tags(answer: Column, note: Column, sample: int = 1000) -> Column:
    """The lines of an answer that are tags; without one, a tag by the words of the note's beginning (that is the rule itself)."""
    found = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    hinted = F.lower(F.substring(note, 1, sample)).rlike("|".join(HINTS))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.when(hinted, HINTED).otherwise(OTHERWISE)))


def summary(notes: Column, keywords: Column) -> Column:
    """First sentence (or the first 200 characters), and up to three keywords that it lacks."""
    text = F.trim(notes)
    lead = F.trim(F.element_at(F.split(text, rf"[.!?]{BLANK}", 2), 1))
    base = F.when(text == "", F.lit("Cluster themes summary unavailable.")).when(lead == "", F.substring(text, 1, 200)).otherwise(lead)
    missing = F.slice(F.filter(keywords, lambda k: ~F.contains(F.lower(base), k)), 1, 3)
    return F.when(F.size(missing) > 0, F.concat(base, F.lit(" Key themes: "), F.array_join(missing, ", "))).otherwise(base)


def lenient_json(payload: Column, schema: str) -> Column:
    """The object in a payload: as it stands, or from its first to its last brace; null where neither is JSON."""
    cut = F.regexp_extract(payload, r"(?s)\{.*\}", 0)
    valid = lambda c: F.get_json_object(c, "$").isNotNull() & c.rlike(r"\A\s*\{")
    return F.when(valid(payload), F.from_json(payload, schema)).when(valid(cut), F.from_json(cut, schema))


def callback(data: Column) -> Column:
    """``action:id:value`` as a struct; null where a part is missing or action or id is empty. The value may hold colons."""
    p = F.split(data, ":", 3)
    return F.when((F.size(p) == 3) & (p[0] != "") & (p[1] != ""), F.struct(p[0].alias("action"), p[1].alias("message_id"), F.get(p, 2).alias("value")))


def csv_fields(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")


def cuts(found: Column, length: Column) -> Column:
    """Boundaries inside a text: whole numbers, sorted, once each, with both ends."""
    inner = F.filter(F.transform(found, lambda x: x.try_cast("double").cast("long")), lambda x: x.isNotNull() & (x > 0) & (x < length))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), length.cast("long")), inner)))


def watched(path: Column) -> Column:
    """Whether a file is a note that counts: not hidden, temporary or inside a settings folder."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.endswith(".md") & ~name.startswith(".") & ~name.startswith("~") & ~F.exists(F.split(path, "/"), lambda p: p == ".obsidian") & ~name.rlike(r"(\.tmp|~|\.swp)(\.md)?$")


def instant(text: Column) -> Column:
    """An ISO time as UTC; without a zone it is taken as UTC; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
