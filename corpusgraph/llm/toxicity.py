"""Toxicity scores: a weighted lexicon, matched by an Aho-Corasick automaton over folded text, normalised by length.

Folding: lower case, letters of other scripts that look like Latin ones, digits that stand for letters, and symbols between
letters; everything else that is no letter separates words. The lexicon holds whole words and word beginnings, weighted by
their smoothed log odds in labelled training texts (among all words, or among texts, whichever are lower). A word counts with the
largest weight among the entries that it matches; entries inside an exception phrase don't count. The sum, over the square
root of the number of words, and the share of matched words go into a logistic curve fitted with weights from the other half
of the sample, so that it isn't fitted to its own lexicon.

Training reads at most ``sample_rows`` labelled rows (smallest hash of the id); the lexicon has ``max_terms`` entries at most.

Edge cases: null and empty texts have no matches and get the curve's lowest score; without labels of both kinds the built-in
words alone count; repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat
from corpusgraph.session import discard, materialise

#: Words that count as toxic before anything is learned, and phrases in which they don't.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "stupid question of mine", "loser bracket", "pond scum")
SHORTEST, LONGEST = 4, 8
#: Per half of the sample: toxic and clean texts that hold a term, its matches in toxic and in clean texts.
COUNTED = ("d0", "e0", "t0", "c0", "d1", "e1", "t1", "c1")

_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "ı": "i", "０": "o", "１": "i"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_TABLE = {**{c: 32 for c in range(128) if not chr(c).isalpha()}, **{c: 32 for c in (*range(0xA0, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), *range(0x2000, 0x2070))}, **{ord(k): ord(v) for k, v in {**_ALIKE, **_DIGITS}.items()}}
_INSIDE = re.compile(r"(?<=[^\W\d_])[@$!|€]+(?=[^\W\d_])")


def fold(text: str) -> str:
    """Folded words, each after a single separator or more; one separator stands before the first."""
    s = text.lower()
    if "@" in s or "$" in s or "!" in s or "|" in s or "€" in s:
        s = _INSIDE.sub(lambda m: "".join(_SYMBOLS[c] for c in m.group()), s)
    return " " + s.translate(_TABLE) + " "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # " wor" for a beginning, " word " for a whole word
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in exceptions:
            term = fold(phrase)
            self.automaton.add_word(term, (len(term), None))
        if len(self.automaton):
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def features(self, text: str | None) -> tuple[float, float]:
        """(sum of weights over the square root of the number of words, its share of words)."""
        folded = fold(text or "")
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(folded) if self.automaton else ():
            at = end - n + 1
            if w is None:
                excused.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        if excused:  # both in order of place
            excused.sort()
            k, kept, reach = 0, {}, 0
            for at in sorted(best):
                while k < len(excused) and excused[k][0] <= at:
                    reach, k = max(reach, excused[k][1]), k + 1
                if at >= reach:
                    kept[at] = best[at]
            best = kept
        if not best:
            return 0.0, 0.0
        n = max(1, len(folded.split()))
        return sum(best.values()) / n**0.5, sum(best.values()) / n


def terms(text: str | None) -> tuple[Counter, int]:
    """How often a text would match each entry (whole words and beginnings of words); its number of words."""
    out, words = Counter(), Counter(fold(text or "").split())
    for w, n in words.items():
        out[f" {w} "] += n
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[" " + w[:k]] += n
    return out, sum(words.values())


def weights(rows: list, whole, of: str, support: int, worth: float) -> dict[str, float]:
    """Entries and their log odds; rows hold ``term`` and the counts of COUNTED, ``whole`` the counts of all words and texts.

    The odds are those among all words or those among texts, whichever are lower, so that a text which repeats a word says no
    more than another. An entry needs ``support`` toxic texts, odds of e at least and a worth (toxic texts times log odds) of
    at least ``worth``. A longer beginning that says no more than a shorter one is left out.
    """
    out = {}
    sum_of = lambda r, c: sum(r[f"{c}{h}"] for h in of)
    for r in rows:
        texts = sum_of(r, "d")
        if texts >= support:
            by_word = np.log((sum_of(r, "t") + 0.2) / (sum_of(whole, "t") + 1)) - np.log((sum_of(r, "c") + 0.5) / (sum_of(whole, "c") + 1))
            by_text = np.log((texts + 0.2) / (sum_of(whole, "d") + 1)) - np.log((sum_of(r, "e") + 0.5) / (sum_of(whole, "e") + 1))
            w = float(min(by_word, by_text))
            if w > 1 and texts * w >= worth:
                out[r["term"]] = round(w, 4)
    return {t: w for t, w in out.items() if not any(out.get(t[:k], 0) >= w - 0.05 for k in range(SHORTEST + 1, len(t)))}


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[float, ...]:
    """Coefficients (constant first) by Newton steps; slopes are kept at 0 or more, so more matches never lower a score."""
    z, keep = np.column_stack([np.ones(len(x)), x]), list(range(x.shape[1] + 1))
    while True:
        beta = np.zeros(len(keep))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z[:, keep] @ beta, -40, 40)))
            ridge = l2 * np.diag([0.0] + [1.0] * (len(keep) - 1))
            step = np.linalg.solve(z[:, keep].T @ (z[:, keep] * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge + 1e-9 * np.eye(len(keep)), z[:, keep].T @ (p - y) + ridge @ beta)
            beta -= np.clip(step, -2, 2)
        bad = [k for k, b in zip(keep, beta, strict=True) if k and b < 0]
        if not bad:
            out = np.zeros(z.shape[1])
            out[keep] = beta
            return tuple(float(b) for b in out)
        keep = [k for k in keep if k not in bad]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, max_terms: int = 20_000, support: int = 5, worth: float = 25.0) -> Model:
    """Lexicon and curve from a bounded sample of labelled documents. The ids of the sample alone are broadcast."""
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows that share an id count once, with the smallest text
    rows = text.join(F.broadcast(picked), "id").where("text is not null").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = materialise(rows.select("text", "y", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")), "toxic")
    seeds = {f" {w} ": 4.0 for w in SEED_WORDS}
    if {r["y"] for r in sample.select("y").distinct().collect()} != {0, 1}:
        discard(sample)
        return Model(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            got = {(y, h): (Counter(), Counter()) for y in (0, 1) for h in (0, 1)}
            for t, y, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                matches, n = terms(t)
                got[y, h][0].update(matches)
                got[y, h][1].update(matches.keys())
                got[y, h][0][""] += n
                got[y, h][1][""] += 1
            for h in (0, 1):
                for y in (0, 1):
                    c, d = got[y, h]
                    zero = pa.array(np.zeros(len(c), np.int64))
                    n, texts = pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())
                    own = (texts, zero, n, zero) if y else (zero, texts, zero, n)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string())] + [v for x in (0, 1) for v in (own if x == h else (zero,) * 4)], names=["term", *COUNTED])

    table = sample.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in COUNTED)).groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTED))
    whole = table.where("term = ''").first()
    total = {c: whole[f"{c}0"] + whole[f"{c}1"] for c in "detc"}
    odds = lambda up, down, n, m: F.log((F.expr(up) + 0.2) / (n + 1)) - F.log((F.expr(down) + 0.5) / (m + 1))
    least = F.least(odds("t0 + t1", "c0 + c1", total["t"], total["c"]), odds("d0 + d1", "e0 + e1", total["d"], total["e"]))
    rows = table.where((F.expr("d0 + d1") >= support) & (least > 0.5) & (F.col("term") != "")).orderBy(F.desc(F.expr("d0 + d1") * least), "term").limit(max_terms).collect()
    lexicon = seeds | weights(rows, whole, "01", support, worth)
    halves = [seeds | weights(rows, whole, h, max(2, support // 2), worth / 2) for h in "01"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = [Matcher(w, EXCEPTIONS) for w in halves]
        for batch in flat.tidy(batches):
            f = [match[1 - h].features(t) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], names=["y", "s", "r"])

    got = sample.mapInArrow(look, "y int, s double, r double").toPandas().sort_values(["y", "s", "r"])
    discard(sample)
    return Model(lexicon, _logistic(got[["s", "r"]].to_numpy(float), got["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, score, predicted). No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        match = Matcher(m.weights, m.exceptions)
        for batch in flat.tidy(batches):
            x = np.array([match.features(t.as_py()) for t in batch.column(1)], float).reshape(-1, 2)
            p = np.round(1 / (1 + np.exp(-np.clip(m.curve[0] + x @ np.array(m.curve[1:]), -40, 40))), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
