"""Secret scans: base patterns, and guess-cost dynamic programming on values in a credential context.

Base spans (leftmost, not overlapping within a kind): ``assign`` (a credential word, ``:`` or ``=``, and a value of 12
characters or more), ``access`` (AKIA keys of 18 or more) and ``hex`` (16 digits or more).

The method adds ``guess`` spans. A value in a wider credential context is cut into dictionary words, dates, repeats, keyboard
walks and sequences, and brute-force characters; the cheapest segmentation, found by dynamic programming over the whole
value, estimates how many guesses it would take. From 10 to the power ``min_log10`` on, the value counts as a secret. Values
that a base ``assign`` span covers are left to it.

Edge cases: null counts as empty; empty texts have no spans; spans are code points, end exclusive, ordered by start and then
kind; repeated rows are each scanned; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\s{0,8}(?:[:=]|=>|\x20is\x20)\s{0,8}["'`]?([^\s"'`<>]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: What a text must hold for any of the patterns to match; searched in linear time.
SCREEN = r"""(?i)(pass|pwd|secret|token|key|credential|auth)[a-z]{0,6}["']?[\s\x0b]*([:=]|is )|(?-i:AKIA[A-Z0-9])|(?-i:[0-9a-f]{16})"""

#: Common passwords and words in order of frequency (fixed values).
COMMON = (
    "password 123456 12345678 qwerty letmein welcome admin login master dragon monkey football baseball superman "
    "iloveyou princess sunshine shadow michael jennifer charlie jordan thomas hunter ranger buster soccer hockey "
    "killer george andrew daniel computer internet service secret default guest root test user temp example sample "
    "changeme please enter here your none null true false this that with from have will what when where there about"
).split()
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("013457@$!", "oieastasi")
_YEAR, _SEP = r"(?:19|20)\d\d", "[-/.]"
_DAY, _MONTH = ("[1-9]", r"(?:0[1-9]|[12]\d|3[01])"), ("[1-9]", "(?:0[1-9]|1[0-2])")
#: The forms of a date; a start may have several ends.
DATES = tuple(
    re.compile(p)
    for p in (_YEAR, f"{_YEAR}{_SEP}?{_MONTH[1]}", f"{_YEAR}{_SEP}?{_MONTH[1]}{_SEP}?{_DAY[1]}", *(d + _SEP + m + _SEP + y for d in _DAY for m in _MONTH for y in (r"\d\d", _YEAR)))
)
_SEGMENT = 0.3


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            for q, p in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)):
                if 0 <= q < len(_ROWS) and 0 <= p < len(_ROWS[q]):
                    near.setdefault(key, set()).add(_ROWS[q][p])
    return near


_NEAR = _neighbours()


class Words(dict):
    """Words and the logarithm of their rank, and all beginnings of words."""

    @cached_property
    def begun(self) -> set[str]:
        return {w[:k] for w in self for k in range(3, len(w) + 1)}


def dictionary(vocab_path: str | None = None) -> Words:
    """The common words, then the whole words of a tokenizer's vocabulary in its order."""
    words = list(COMMON)
    if vocab_path:
        with open(vocab_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        words += [w[:-4] for w in sorted(vocab, key=vocab.get) if w.endswith("</w>") and len(w) >= 7 and w[:-4].isascii()]
    return Words((w, math.log10(k + 2)) for k, w in reversed(list(enumerate(words))))


def repeats(s: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the maximal stretches that repeat a unit twice or more, for units that aren't repeats themselves.

    A stretch of period u holds a multiple of u at which s agrees with itself u further on, so only these are tried.
    """
    out, wide, n = [], [], len(s)
    for u in range(1, n // 2 + 1):
        wide = [x for x in wide if x[1] - x[0] >= 2 * u]
        k = 0
        while k + u < n:
            if s[k] == s[k + u]:
                held = next((b for a, b, p in wide if not u % p and a <= k and k + u < b), 0)
                if held:  # a stretch of a shorter unit
                    k = max(k + u, -(-(held - u) // u) * u)
                    continue
                left, right = k, k + 1
                while right + u < n and s[right] == s[right + u]:
                    right += 1
                while left and s[left - 1] == s[left - 1 + u]:
                    left -= 1
                if right - left >= u:
                    out.append((left, right + u, u))
                    wide.append((left, right + u, u))
                k = max(k + u, right // u * u)
            else:
                k += u
    return out


def _chains(s: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a keyboard walk) of the maximal walks and of the maximal sequences up or down, of three or more."""
    out, n = [], len(s)
    a = 0
    for j in range(1, n + 1):
        if j == n or s[j] not in _NEAR.get(s[j - 1], ()):
            if j - a >= 3:
                out.append((a, j, True))
            a = j
    a, way = 0, 0
    for j in range(1, n + 1):
        step = ord(s[j]) - ord(s[j - 1]) if j < n else 0
        if step != way or abs(step) != 1:
            if way and j - a >= 3:
                out.append((a, j, False))
            a, way = j - 1, step if abs(step) == 1 else 0
    return out


class _Stretch:
    """The cheapest segment that ends at each place of a stretch and covers ``least`` units or more.

    A segment from start i costs best[i] + ``cost`` + log10 of its units. The logarithm is concave: of two starts the earlier
    can only become the cheaper one as the end moves on, and stays so. So the starts that can still win form a stack (the
    latest on top), and each is put on and taken off once.
    """

    def __init__(self, start: int, end: int, unit: int, least: int, cost: float):
        self.start, self.end, self.unit, self.least, self.cost = start, end, unit, least, cost
        self.stacks: dict[int, list[tuple[int, float]]] = {}

    @staticmethod
    def _meet(old: tuple[int, float], new: tuple[int, float]) -> float:
        """The end (in units) from which the earlier start is no dearer."""
        if new[1] <= old[1]:
            return math.inf
        ratio = 10 ** min(new[1] - old[1], 300.0)
        return (ratio * new[0] - old[0]) / (ratio - 1)

    def at(self, j: int, best: list[float]) -> float:
        t, rest = divmod(j - self.start, self.unit)
        s = t - self.least
        if s < 0:
            return math.inf
        stack, new = self.stacks.setdefault(rest, []), (s, best[self.start + rest + s * self.unit])
        if not stack or self._meet(stack[-1], new) > t:
            while len(stack) > 1 and self._meet(stack[-2], stack[-1]) <= self._meet(stack[-1], new):
                stack.pop()
            stack.append(new)
        while len(stack) > 1 and self._meet(stack[-2], stack[-1]) <= t:
            stack.pop()
        return stack[-1][1] + self.cost + math.log10(t - stack[-1][0])


def guesses(value: str, words: Words) -> float:
    """Logarithm (base 10) of the guesses of the cheapest segmentation of the whole value.

    The segments: words (as they stand or with digits and symbols for letters), dates, repeats of any unit, keyboard walks,
    sequences, and single characters by brute force. Time is about n log n in the length of the value.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(_LEET)
    size = sum(k for k, some in ((26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)), (10, any(c.isdigit() for c in value)), (33, any(not c.isalnum() for c in value))) if some)
    brute = math.log10(max(size, 10))
    begin: dict[int, list[_Stretch]] = {}
    for a, b, u in repeats(low):
        begin.setdefault(a, []).append(_Stretch(a, b, u, 3 if u == 1 else 2, u * brute + _SEGMENT))
    for a, b, walk in _chains(low):
        begin.setdefault(a, []).append(_Stretch(a, b, 1, 3, math.log10(47 * 4.6 if walk else 52) + _SEGMENT))
    best, active, begun = [0.0] + [math.inf] * n, [], words.begun
    for i in range(n):
        if active:
            active = [x for x in active if x.end >= i]
            best[i] = min(best[i], *(x.at(i, best) for x in active)) if active else best[i]
        active += begin.get(i, ())
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute)
        for j in range(i + 3, n + 1):
            said, meant = low[i:j], plain[i:j]
            if said not in begun and meant not in begun:
                break
            rank, leet = words.get(said), 0.0
            if rank is None and (rank := words.get(meant)) is not None:
                leet = 0.6
            if rank is not None:
                part = value[i:j]
                case = 0.0 if part.islower() or not part.isalpha() else 0.3 if part.istitle() or part.isupper() else math.log10(j - i) + 0.6
                best[j] = min(best[j], here + rank + leet + case + _SEGMENT)
        if low[i] in "0123456789":
            for j in {m.end() for d in DATES if (m := d.match(low, i))}:
                best[j] = min(best[j], here + (2.1 if j - i == 4 else 4.6) + _SEGMENT)
    return min(best[n], *(x.at(n, best) for x in active if x.end >= n), math.inf)


def scan(text: str | None, words: Words, min_log10: float) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 of guesses of the value) ordered by start and kind."""
    if not text:
        return []
    out, held = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            out.append(("assign", m.start(), m.end(), round(guesses(m[2], words), 4)))
            held.append(m.span())
    out += [("access", m.start(), m.end(), float(m.end() - m.start())) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), float(m.end() - m.start())) for m in HEX.finditer(text)]
    near = 0  # the first held span that ends after the value begins; both are in order
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".,;:)!?":
            b -= 1
        while near < len(held) and held[near][1] <= a:
            near += 1
        if b - a >= 6 and not (near < len(held) and held[near][0] < b) and (g := guesses(text[a:b], words)) >= min_log10:
            out.append(("guess", a, b, round(g, 4)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans(docs: DataFrame, text_col: str, kept: Column, vocab_path: str | None, min_log10: float) -> DataFrame:
    """(spans, text, kept) of each row, under these names only."""
    source = docs.select(F.col(text_col).cast("string").alias("text"), kept.alias("kept"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocab_path)
        for batch in flat.tidy(batches):
            likely = pc.fill_null(pc.match_substring_regex(batch.column(0), SCREEN), False).to_pylist()
            spans = [[dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in scan(batch.column(0)[k].as_py(), words, min_log10)] if hit else [] for k, hit in enumerate(likely)]
            yield pa.RecordBatch.from_arrays([pa.array(spans, span), batch.column(0), batch.column(1)], names=["spans", "text", "kept"])

    return source.mapInArrow(run, f"spans array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>, text string, kept {source.schema['kept'].dataType.simpleString()}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, min_log10: float = 10.0) -> DataFrame:
    """One row per document: (id, spans array of (kind, start, end, log10_guesses)). No shuffle."""
    return _spans(docs, text_col, F.col(id_col), vocab_path, min_log10).select(F.col("kept").alias(id_col), "spans")


def cleaned(docs: DataFrame, text_col: str = "text", vocab_path: str | None = None, min_log10: float = 10.0, mark: str = "[secret]") -> DataFrame:
    """The documents with a mark for each secret in their texts; all columns stay, whatever their names. No shuffle."""
    found = _spans(docs, text_col, F.struct(*[F.col(c) for c in docs.columns]), vocab_path, min_log10)
    return found.select(*[redact(mark=mark).alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns])


def redact(text_col: str = "text", spans_col: str = "spans", mark: str = "[secret]"):
    """The text with each span replaced; overlapping spans are replaced together. A column expression."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        piece = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), piece.alias("out"))

    folded = F.aggregate(F.col(spans_col), state, step)
    return F.when(F.size(spans_col) == 0, F.col(text_col)).otherwise(F.concat(folded["out"], F.substring(text, folded["at"].cast("int") + 1, F.length(text))))
