"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by e = floor(rate * m) edits. It is cut into e + 1 pieces: at least one
stands in the passage unchanged. The pieces of all items are found by an Aho-Corasick automaton, and around each hit Myers'
bit-parallel algorithm decides whether the item occurs with at most e edits, and where. Hits whose surroundings overlap are
searched together, from the left.

Texts and items are compared in lower case, with each white-space character as a space; positions are code points of the
whole text. Items are taken in blocks of at most ``block_chars`` characters, each run against all documents, so what is sent
to the workers at once has a bound, however large the benchmark is.

Edge cases: null and empty texts and items match nothing; items that are equal are each reported; overlapping occurrences of
an item count once (the first, leftmost); repeated rows are each searched; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat

RATE, BLOCK_CHARS = 0.06, 4_000_000
_SPACES = {c: 32 for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029)}


def normal(text: str | None) -> str:
    """Lower case and plain spaces, one character for each character."""
    if not text:
        return ""
    s = text.lower()
    if len(s) != len(text):
        s = "".join(c.lower()[0] for c in text)
    return s.translate(_SPACES) if not s.isprintable() else s


def masks(pattern: str) -> dict[str, int]:
    """Per character the places in the pattern, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(at: dict[str, int], m: int, text: str, lo: int, hi: int, most: int, beyond: int | None = None) -> tuple[int, int] | None:
    """(end, distance) of the first best occurrence within text[lo:hi] of a pattern of m characters with at most ``most`` edits.

    With ``beyond``, ends more than so many characters after the first one aren't looked at.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, d, best = mask, 0, m, None
    for k in range(lo, hi):
        eq = at.get(text[k], 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & mask
        hn = vp & xh
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp, hn = hp << 1 & mask, hn << 1 & mask
        vp = hn | ~(xv | hp) & mask
        vn = hp & xv
        if d <= most and (best is None or d < best[1]):
            if best is None and beyond is not None:
                hi = min(hi, k + 1 + beyond)
            best = (k + 1, d)
        if best and (not best[1] or k + 1 >= hi):
            break
    return best


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(end, distance) of the first best occurrence of the pattern in the text with at most ``most`` edits; None without."""
    return best_end(masks(pattern), len(pattern), text, 0, len(text), most)


class Item:
    """A test item with its budget; the bits of its characters are made when it is first looked for."""

    def __init__(self, name, pattern: str, budget: int):
        self.name, self.pattern, self.budget = name, pattern, budget
        self._bits: tuple[dict[str, int], dict[str, int]] | None = None

    def occurrences(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, distance) of each occurrence within text[lo:hi] that begins after the one before, from the left."""
        m, e = len(self.pattern), self.budget
        self._bits = self._bits or (masks(self.pattern), masks(self.pattern[::-1]))
        while hi - lo >= m - e:
            hit = best_end(self._bits[0], m, text, lo, hi, e, 2 * e)
            if hit is None:
                return
            stop, d = hit
            back = text[max(lo, stop - m - e) : stop][::-1]
            found = best_end(self._bits[1], m, back, 0, len(back), d)
            yield stop - found[0] if found else max(lo, stop - m), stop, d
            lo = max(stop, lo + 1)


class Searcher:
    def __init__(self, items: list[tuple], rate: float):
        self.items = [Item(i, s, int(rate * len(s))) for i, t in items if (s := normal(t))]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, x in enumerate(self.items):
            cuts = [len(x.pattern) * k // (x.budget + 1) for k in range(x.budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(x.pattern[a:b], []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, places in found.items():
            self.pieces.add_word(piece, (len(piece), places))
        if found:
            self.pieces.make_automaton()

    def search(self, text: str | None) -> list[tuple]:
        """(item id, start, end, distance) of each occurrence, in order of item and place.

        Around each hit of a piece lies a window in which the item may stand. Windows that overlap are one stretch, and a stretch
        is searched as a whole in one sweep, so nothing between two windows is lost and no place is searched for each hit anew.
        """
        s = normal(text)
        if not s or not self.items:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.pieces.iter(s):
            for n, a in places:
                x = self.items[n]
                at = end + 1 - length - a  # where the item would begin without edits
                lo, hi = max(0, at - x.budget), min(len(s), at + len(x.pattern) + x.budget)
                known = stretches.setdefault(n, [])
                if known and lo <= known[-1][1] and hi >= known[-1][0]:
                    known[-1][0], known[-1][1] = min(lo, known[-1][0]), max(hi, known[-1][1])
                else:
                    known.append([lo, hi])
        out = []
        for n in sorted(stretches):
            low, high = None, -1
            for lo, hi in [*sorted(stretches[n]), [len(s) + 1, len(s) + 1]]:
                if low is not None and lo > high:
                    out += [(self.items[n].name, *hit) for hit in self.items[n].occurrences(s, low, high)]
                    low = None
                low, high = lo if low is None else low, max(hi, high)
        return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per occurrence of an item in a document: (id, item id, start, end, distance). No shuffle."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and text != ''")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kinds = source.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()

    def block(k: int) -> DataFrame:
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, rate)
            for batch in flat.tidy(batches):
                hits = [(r, *h) for r, t in enumerate(batch.column(1)) for h in searcher.search(t.as_py())]
                kind = batch.column(0).type
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())) if hits else pa.array([], kind), pa.array([h[1] for h in hits], item_kind), *(pa.array([h[c] for h in hits], pa.int64()) for c in (2, 3)), pa.array([h[4] for h in hits], pa.int32())],
                    names=["id", "item", "start", "end", "distance"],
                )

        return source.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, start long, end long, distance int")

    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(items.schema["item"].dataType)
    return reduce(DataFrame.unionByName, map(block, range(blocks))).withColumnsRenamed({"id": id_col, "item": item_col})


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The ids of documents that hold an item, each once."""
    id_col = options.get("id_col", "doc_id")
    return find(docs, benchmark, **options).where(F.col(id_col).isNotNull()).select(id_col).distinct()
