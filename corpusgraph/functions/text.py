"""Text cleaning and normalising as column expressions; patterns mean the same in Java's and RE2's dialects where possible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.html import to_text


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


#: White space of every kind, inside brackets of a pattern.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The steps of each cleaner in their order.
MARKDOWN = [
    (r"(?sm)^---\n.*?\n---\n", ""), (r"(?s)```chatgpt[^`]*```", ""), (r"!\[\[[^\]]*\]\]", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
    (r"\[\[([^\]]*)\]\]", "$1"), (r"<[^>]+>", ""), (r"\b[A-Za-zÀ-ÿ0-9_]+::[^\n]+", ""), ("[📌🎯💡⚡]", ""), (" +", " "), (r"\n{3,}", "\n\n"),
]
MAIL = [
    (rf"https?://[^{SPACE}]+", ""), (rf"www\.[^{SPACE}]+", ""), (rf"[^{SPACE}]+@[^{SPACE}]+", ""), (rf"\?[^{SPACE}]+", ""), (rf"utm_[^{SPACE}]+", ""), (r"&[a-z]+;", " "), (r"&#\p{Nd}+;", " "),
    (r"(?isu)\n---\n.*", ""), (r"(?isu)\nBest regards,.*", ""), (r"(?isu)\nSent from my.*", ""), (r"(?isu)\nGesendet von meinem.*", ""), (r"(?isu)Best regards,.*", ""), (r"(?isu)Sent from my .*", ""),
    ("Sent from my iPhone", ""), (r"(?iu)sent from my [^\n]+", ""), (rf"[{SPACE}]+", " "),
]
SCANNED = [
    (rf"[^\p{{L}}\p{{N}}_{SPACE}.,!?;:()\-'\"€$%&/]", " "), (r"(?<![\p{L}\p{N}_])l(?![\p{L}\p{N}_])", "I"), (r"(?<![\p{L}\p{N}_])O(?![\p{L}\p{N}_])", "0"), (rf"[{SPACE}]+", " "),
    (rf"(?iu)Page[{SPACE}]+\p{{Nd}}+", " "),
]
#: Words that are no keywords.
STOPWORDS = "about across after again analysis and are based before between case cases data deep for from have into note notes over that this with work".split()
#: Words that make a text positive or negative.
POSITIVE = "improve success good benefit positive increase support agree effective".split()
NEGATIVE = "fail bad risk negative decrease harm oppose ineffective issue".split()
#: Mis-decoded UTF-8.
MOJIBAKE = "Ã¼|Ã¶|Ã¤|�|â€™|â€œ|â€˜"


def markdown_clean(text: Column) -> Column:
    return F.regexp_replace(_chain(text, MARKDOWN), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def mail_clean(html: Column, limit: int = 8000) -> Column:
    """A mail's body: its text without addresses, tracking parts and signatures, in one line of at most ``limit`` characters."""
    return F.substring(F.trim(_chain(to_text(html), MAIL)), 1, limit)


def scan_clean(text: Column) -> Column:
    """Recognised text: other characters than letters, digits and usual marks go, lone l and O become I and 0, page numbers go."""
    return F.trim(_chain(F.coalesce(text, F.lit("")), SCANNED))


def is_mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def note_normalise(text: Column) -> Column:
    """Line ends, trailing blanks, runs of blanks (but in indented lines), runs of empty lines."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    fixed = F.transform(lines, lambda x: F.when(x.startswith("    ") | x.startswith("\t"), F.rtrim(x)).otherwise(F.regexp_replace(F.rtrim(x), " {2,}", " ")))
    return F.trim(F.regexp_replace(F.array_join(fixed, "\n"), r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])[\x09-\x0D\x20]+"), lambda s: s != "")


def slug(text: Column) -> Column:
    """Letters and digits of any script, hyphens and underscores; white space becomes one underscore."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(F.coalesce(s, F.lit("unknown")))


def term_set(*lists: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def polarity(text: Column, positive: list[str], negative: list[str]) -> Column:
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]]+|[.,!?;:()\[\]]+$", ""))
    p, n = F.size(F.filter(words, lambda w: w.isin(positive))), F.size(F.filter(words, lambda w: w.isin(negative)))
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))


def word_chunks(text: Column, size: int = 500) -> Column:
    """Arrays of at most ``size`` words, joined by a space; a text without words is one chunk."""
    words = F.split(F.trim(text), r"[\x09-\x0D\x20]+")
    starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k * size + 1, F.lit(size)), " "))


def route(query: Column) -> Column:
    q = F.lower(query)
    has = lambda *xs: [q.contains(x) for x in xs]
    web, own = has("http", "latest", "news"), has("project", "status", "deadline")
    return F.when(web[0] | web[1] | web[2], "web").when(own[0] | own[1] | own[2], "projects").otherwise("archive")
