"""Quality rules: document statistics, base rules on them, and boosted trees for the rest.

Statistics are exact and cover whole texts; equality of words, lines and windows is decided on 64-bit hashes. The trees are
fitted on at most ``sample_rows`` labelled rows (those with the smallest hash of the id), and score in flat numpy node arrays.

Edge cases: null and empty texts have no words and fail the base rules; without usable labels the base rules alone decide;
repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat, gbt

SYMBOLS = "#*$%&|<>"
#: Features and their monotonic constraint: the score must not rise with a -1.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "letter_rate": 1, "digit_rate": 0, "upper_rate": 0, "distinct_rate": 0, "line_words": 0, "stop_rate": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL, _LETTER, _DIGIT, _UPPER, _STOP, _LEAD = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[ord(c) for c in ".!?"]] = True
_LEAD[[b for b in range(256) if b & 0xC0 != 0x80]] = True


def statistics(data: np.ndarray, off: np.ndarray, window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each text in the order of COUNTS, features of each text in the order of FEATURES)."""
    n = len(off) - 1
    starts, ends, doc = flat.words(data, off)
    prefix = flat.prefix_hash(data)
    hashes = flat.span_hash(prefix, starts, ends)
    salt = flat.mix(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED27))
    n_words = np.bincount(doc, minlength=n)
    solid = ~flat.WHITE[data]
    word_chars = flat.sums(solid & _LEAD[data], off)
    n_symbols = flat.sums(_SYMBOL[data], off)

    keys, at = flat.shingles(hashes, doc, window)
    again = at[flat.later_copies(keys ^ salt[doc[at]])]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    n_repeat = flat.per_text(np.cumsum(cover)[:-1] > 0, doc, n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([off[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n), np.searchsorted(off[1:], breaks, "right")])
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.empty(len(line_starts), np.int64)
    if len(line_starts):
        line_ends[:-1] = line_starts[1:] - 1
        last = np.concatenate([line_doc[1:] != line_doc[:-1], [True]])
        line_ends[last] = off[line_doc[last] + 1]
    has_word = np.searchsorted(starts, line_starts, "left") < np.searchsorted(starts, line_ends, "left")
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    n_lines = np.bincount(line_doc, minlength=n)
    line_keys = flat.span_hash(prefix, line_starts, line_ends) ^ salt[line_doc]
    _, first = np.unique(line_keys, return_index=True)
    n_dup = n_lines - np.bincount(line_doc[first], minlength=n)

    _, first = np.unique(hashes ^ salt[doc], return_index=True)
    distinct = np.bincount(doc[first], minlength=n)
    solid_bytes = np.maximum(flat.sums(solid, off), 1)
    w = np.maximum(n_words, 1)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    features = np.stack(
        [np.log1p(n_words), word_chars / w, n_symbols / np.maximum(word_chars, 1), n_dup / np.maximum(n_lines, 1), n_repeat / w, flat.sums(_LETTER[data], off) / solid_bytes, flat.sums(_DIGIT[data], off) / solid_bytes, flat.sums(_UPPER[data], off) / solid_bytes, distinct / w, n_words / np.maximum(n_lines, 1), flat.sums(_STOP[data], off) / w],
        1,
    )
    return counts, features


def _in_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = flat.buffers(column)
    for lo, hi in flat.groups(off):
        yield lo, hi, *statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000) -> gbt.Trees:
    """Trees from at most ``sample_rows`` labelled documents: those whose ids hash lowest. The sample alone is broadcast."""
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    # rows that share an id count once, with the smallest text
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            for lo, hi, _, x in _in_batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(np.concatenate([x.T, got["y"].to_numpy(float)[None]]))
    return gbt.fit(x[order], got["y"].to_numpy(float)[order], list(FEATURES.values()))


def score(docs: DataFrame, trees: gbt.Trees, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the counts, base_failed, quality (probability) and kept. No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            for lo, hi, c, x in _in_batches(batch.column(1)):
                failed = (c[:, 0] < min_words) | (100 * c[:, 4] > max_repeat_percent * c[:, 0])
                p = np.round(model.value.score(x), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=["id", *COUNTS, "base_failed", "quality", "kept"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean").withColumnRenamed("id", id_col)
