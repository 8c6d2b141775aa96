"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over folded bytes, of ``ORDER`` symbols at most. A symbol's probability comes from the
longest context seen; a symbol that was not seen there escapes (method C: escape weight = number of different symbols) to
the context one shorter, with the symbols of the longer context excluded, and in the end to a uniform choice. Statistics are
frozen after training, so the exact code length of every (context, symbol) is worked out once, for all languages together,
and a text costs one table look-up per byte. The language with the shortest code wins; ``score`` is its posterior probability
under equal priors.

Training uses about ``docs_per_lang`` whole labelled texts of each language, drawn by a hash of the id (all where there are
fewer). Every folded byte that occurs in them is a symbol of its own (bytes that don't are one more). The tables hold the
contexts that occur in the sample, so they grow with its languages and scripts and not with the corpus; a model of more than
``MODEL_BYTES`` is refused before it is sent to the workers (fewer texts a language give a smaller one).

Edge cases: null or empty texts and texts without a letter are ``und`` with score 0, as is every text if nothing can be
learned; a tie goes to the first language by name; repeated rows and extra columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat

ORDER, UND = 3, "und"
#: Largest model that is broadcast.
MODEL_BYTES = 1 << 30

#: Upper case counts as lower case, all white space as a space, all digits as 0.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[flat.WHITE] = 32
FOLD[48:58] = 48


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    node: np.ndarray  # context of ORDER symbols -> row of bits
    bits: np.ndarray  # (rows, symbols, languages): code length

    @property
    def symbols(self) -> int:
        return self.bits.shape[1]


def _contexts(sym: np.ndarray, off: np.ndarray, pad: int) -> list[np.ndarray]:
    """The symbols before each symbol, nearest first; texts begin after ``pad``."""
    out, prev, begin = [], sym, off[:-1]
    for k in range(ORDER):
        prev = np.concatenate([[pad], prev[:-1]]).astype(sym.dtype)
        for j in range(k + 1):
            at = begin[begin + j < len(sym)] + j
            prev[at] = pad
        out.append(prev)
    return out


def count_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) grams of folded texts and their counts."""
    sym = FOLD[data].astype(np.uint32)
    key = sym.copy()
    for k, c in enumerate(_contexts(sym, off, 32)):
        key |= c << np.uint32(8 * (k + 1))
    return np.unique(key, return_counts=True)


def build(langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    """Tables of exact code lengths from the gram counts of each language."""
    used = np.zeros(256, bool)
    used[32] = True
    for k in keys:
        used[np.unique(k & 0xFF)] = True
    a = int(used.sum()) + 1
    symbol = np.full(256, a - 1, np.int32)
    symbol[used] = np.arange(a - 1)
    packed = [symbol[k & 0xFF] + a * (symbol[k >> 8 & 0xFF] + a * (symbol[k >> 16 & 0xFF] + a * symbol[k >> 24 & 0xFF].astype(np.int64))) for k in keys]
    deep = np.unique(np.concatenate([p // a for p in packed]))  # contexts that occur, nearest symbol lowest
    rows = [np.zeros(1, np.int64), np.arange(a), *(np.unique(deep % a**order) for order in range(2, ORDER)), deep]
    at = np.cumsum([0] + [len(r) for r in rows[1:]])  # where the rows of each order begin
    if at[-1] * a * len(langs) * 4 + 4 * a**ORDER > MODEL_BYTES:
        raise ValueError(f"the tables of {len(langs)} languages need more than {MODEL_BYTES} bytes; train on fewer texts a language")
    out = np.zeros((at[-1], a, len(langs)), np.float32)
    for x, (p, c) in enumerate(zip(packed, counts, strict=True)):
        level = np.bincount(p % a, c, a)[None, :]
        bits, tail = _codes(level, None, None, None)
        for order in range(1, ORDER + 1):
            here = np.bincount(np.searchsorted(rows[order], p // a % a**order) * a + p % a, c, len(rows[order]) * a).reshape(-1, a)
            up = np.searchsorted(rows[order - 1], rows[order] % a ** (order - 1))
            bits, tail, level = *_codes(here, level[up], tail[up], bits[up]), here
            out[at[order - 1] : at[order], :, x] = bits
    node = np.arange(a, dtype=np.int32)
    for order in range(2, ORDER + 1):  # a context that doesn't occur has the row of the one shorter
        node = np.tile(node, a)
        node[rows[order]] = at[order - 1] + np.arange(len(rows[order]))
    return Model(langs, symbol, node, out)


def _codes(here: np.ndarray, parent: np.ndarray | None, parent_tail: np.ndarray | None, parent_bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(code length of each symbol, code length of each symbol after an escape) for rows of contexts."""
    seen = here > 0
    n, d = here.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        if parent is None:
            tail = np.broadcast_to(np.log2(np.maximum(here.shape[1] - d, 1)), here.shape).astype(float)
        else:
            left = np.where(seen, 0, parent)
            pn, pd = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
            tail = np.where(left > 0, np.log2(pn + pd) - np.log2(left), np.where(pd > 0, np.log2(pn + pd) - np.log2(pd), 0) + parent_tail)
        bits = np.where(seen, np.log2(n + d) - np.log2(here), np.log2(n + d) - np.log2(d) + tail)
    fresh = n[:, 0] == 0
    if parent is not None and fresh.any():
        bits[fresh], tail[fresh] = parent_bits[fresh], parent_tail[fresh]
    elif fresh.any():
        bits[fresh] = np.log2(here.shape[1])
    return bits, tail


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each text under each language; long buffers are read in pieces with their contexts."""
    n, a, k = len(off) - 1, model.symbols, len(model.langs)
    total, flatbits = np.zeros((n, k)), model.bits.reshape(-1, k)
    pad = int(model.symbol[32])
    for lo in range(0, len(data), flat.CHUNK_BYTES):
        hi = min(len(data), lo + flat.CHUNK_BYTES)
        back = min(lo, ORDER)
        sym = model.symbol[FOLD[data[lo - back : hi]]]
        first, last = np.searchsorted(off, lo - ORDER, "left"), np.searchsorted(off, hi, "left")
        begins = off[first:last] - (lo - back)
        ctx, scale = np.zeros(hi - lo, np.int32), 1
        for c in _contexts(sym, np.concatenate([begins[begins >= 0], [len(sym)]]), pad):
            ctx += c[back:] * np.int32(scale)
            scale *= a
        cost = flatbits[model.node[ctx].astype(np.int64) * a + sym[back:]]
        d0, d1 = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")
        cuts = np.clip(off[d0:d1] - lo, 0, None)
        size = np.diff(np.concatenate([cuts, [hi - lo]]))
        full = size > 0
        total[np.arange(d0, d1)[full]] += np.add.reduceat(cost, cuts[full], axis=0, dtype=np.float64)
    return total


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 400) -> Model:
    """A model from a bounded sample of labelled texts; the sample's gram counts are summed before they are collected."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, docs_per_lang / n))])
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            data, off = flat.buffers(batch.column(1))
            for lo, hi in flat.groups(off):
                for lang in sorted(set(langs[lo:hi])):
                    at = lo + np.flatnonzero((langs[lo:hi] == lang) & (off[lo + 1 : hi + 1] > off[lo:hi]))
                    if len(at):
                        k, c = count_grams(np.concatenate([data[off[i] : off[i + 1]] for i in at]), np.concatenate([[0], np.cumsum(off[at + 1] - off[at])]))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    got = picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toPandas()
    langs = sorted(set(got["lang"]))
    if not langs:
        return train(docs.limit(0), id_col, text_col, lang_col)
    parts = [got[got["lang"] == x] for x in langs]
    return build(langs, [p["gram"].to_numpy(np.int64) for p in parts], [p["n"].to_numpy(float) for p in parts])


def _guess(m: Model, texts: pa.Array, known: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    if not m.langs:
        return [UND] * len(known), np.zeros(len(known)), np.zeros(len(known))
    cost = code_lengths(m, *flat.buffers(texts))
    best = cost.argmin(1)
    bits = cost[np.arange(len(cost)), best]
    p = np.where(known, np.round(1 / np.exp2(np.clip(bits[:, None] - cost, -1000, 0)).sum(1), 6), 0.0)
    return np.where(known, np.array(m.langs, object)[best], UND).tolist(), p, np.round(bits, 3)


def _letter(text_col: str):
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, bits (code length under the language predicted). No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _letter(text_col).alias("letter"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            lang, p, bits = _guess(shared.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(p), pa.array(bits)], names=["id", "lang_pred", "score", "bits"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)


def predict_into(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with the predicted language in ``lang_col``; no join, no shuffle."""
    rest = [c for c in docs.columns if c not in (text_col, lang_col)]
    source = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(True).alias("rest"), F.col(text_col).cast("string").alias("text"), _letter(text_col).alias("letter"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            lang, _, _ = _guess(shared.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string())], names=["rest", "text", "lang"])

    out = source.mapInArrow(run, f"rest {source.schema['rest'].dataType.simpleString()}, text string, lang string")
    return out.select(*(["rest.*"] if rest else []), F.col("text").alias(text_col), F.col("lang").alias(lang_col))
