"""Splitting documents into chunks: sequential rules, run on Arrow batches, without a shuffle."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a text is cut, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int = 400, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow it, neighbours sharing up to ``overlap``."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    cuts = [m.start() for m in re.finditer(re.escape(mark), text)] if mark else range(len(text))
    pieces = [x for a, b in itertools.pairwise([0, *cuts, len(text)]) if (x := text[a:b])]
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += _pack(held, size, overlap)
        held = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + _pack(held, size, overlap)


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            if chunk := "".join(window).strip():
                out.append(chunk)
            drop = 0
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window[drop])
                drop += 1
            window = window[drop:]
        window.append(piece)
        total += len(piece)
    if chunk := "".join(window).strip():
        out.append(chunk)
    return out


def assemble(text: str, boundaries: list[int], least: int = 100, most: int = 1000, strip: bool = False) -> list[str]:
    """Segments between boundaries: short neighbours are joined, long ones split. With ``strip`` the blanks around segments go first."""
    cuts = [0, *sorted({b for b in boundaries if 0 < b < len(text)}), len(text)]
    merged: list[str] = []
    for part in (text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
        part = part.strip() if strip else part
        if not part.strip():
            continue
        if merged and (len(merged[-1]) < least or len(part) < least):
            merged[-1] += part
        else:
            merged.append(part)
    return [c for m in merged for c in (split_recursive(m) if len(m) > most else [m])]


def spans(text: str, chunks: list[str], overlap: int) -> list[tuple[int, int]] | None:
    """Place of each chunk, found from a moving cursor; None if any is missing."""
    out, cursor = [], 0
    for c in chunks:
        at = text.find(c, cursor)
        if at < 0:
            return None
        out.append((at, at + len(c)))
        cursor = max(at + len(c) - overlap, at + 1) if c else cursor
    return out


def _explode(docs: DataFrame, id_col: str, text_col: str, split) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, k, c) for r, t in enumerate(batch.column(1)) for k, c in enumerate(split(t.as_py() or ""))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string())], names=["id", "chunk", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, chunk int, text string").withColumnRenamed("id", id_col)


def recursive(docs: DataFrame, id_col: str, text_col: str, size: int = 400, overlap: int = 100) -> DataFrame:
    return _explode(docs, id_col, text_col, lambda t: split_recursive(t, size, overlap))


def assembled(docs: DataFrame, id_col: str, text_col: str, least: int = 100, most: int = 1000) -> DataFrame:
    """Sentence ends as boundaries."""
    return _explode(docs, id_col, text_col, lambda t: assemble(t, [m.end() for m in re.finditer(r"(?<=[.!?])\s+", t)], least, most))


def _sentence_vectors(sentences: list[str], size: int = 64):
    """Counts of hashed words: a deterministic stand-in for an embedding service."""
    import zlib

    import numpy as np

    out = np.zeros((len(sentences), size))
    for k, s in enumerate(sentences):
        for w in s.lower().split():
            out[k, zlib.crc32(w.encode()) % size] += 1
    return out


def split_by_similarity(text: str, threshold: float = 0.78, least: int = 100, most: int = 1000, embed=_sentence_vectors) -> list[str]:
    """Chunks that end where a sentence differs from the one before, once they are long enough, or where they would be too long.

    Short texts and single sentences are one chunk; if the embedding fails, the recursive split stands in.
    """
    import numpy as np

    if not text or not text.strip():
        return []
    if len(text) <= least:
        return [text]
    found, cursor = [], 0
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if s.strip() and (at := text.find(s, cursor)) >= 0:
            cursor = at + len(s)
            found.append((at, cursor))
    if len(found) < 2:
        return [text.strip()]
    try:
        v = np.asarray(embed([text[a:b] for a, b in found]), float)
    except Exception:  # a service that fails must not lose the document
        return split_recursive(text)
    n = np.linalg.norm(v, axis=1)
    size = n[1:] * n[:-1]
    cos = np.where(size > 0, (v[1:] * v[:-1]).sum(1) / np.where(size > 0, size, 1), 0.0)
    cuts, begin = [], found[0][0]
    for (a, b), near in zip(found[1:], cos, strict=True):
        if b - begin > most or b - begin >= least and near < threshold:
            cuts.append(a)
            begin = a
    return assemble(text, cuts, least, most, strip=True)


def by_similarity(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.78, least: int = 100, most: int = 1000) -> DataFrame:
    return _explode(docs, id_col, text_col, lambda t: split_by_similarity(t, threshold, least, most))
