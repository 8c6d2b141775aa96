"""Extension points for embedding and language models: batched pandas functions, and stand-ins that need no service."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A client of an embedding service: texts in, vectors out, a whole batch at once."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Writer(Protocol):
    """A client of a language model: prompts in, answers out, a whole batch at once."""

    structured: bool

    def generate(self, prompts: list[str]) -> list[str | None]: ...


class HashEmbedder:
    """Counts of hashed words: deterministic vectors that need no service."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                out[k, zlib.crc32(w.encode()) % self.size] += 1
        return out.tolist()


class RuleWriter:
    """Answers by rules: yes or no by shared words, else the first sentence of what follows the last colon line."""

    structured = False

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [self.answer(p) for p in prompts]

    def answer(self, prompt: str) -> str:
        if "yes or no" in prompt:
            parts = re.split(r"\n\n", prompt)
            words = [set(re.findall(r"\w{4,}", p.lower())) for p in parts[-3:-1]]
            return "yes" if len(words) == 2 and words[0] & words[1] else "no"
        body = prompt.rsplit("Document:\n", 1)[-1].strip()
        return re.split(r"(?<=[.!?])\s", body, maxsplit=1)[0][:200]


def embedding(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """A column function text -> vector; each worker makes one client and hands it whole batches. Null texts give null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if known.any():
                out[known] = pd.Series(client.embed(texts[known].tolist()), index=texts.index[known])
            yield out

    return embed


def late_embedding(make: Callable[[], Embedder]) -> Callable[[Column, Column], Column]:
    """A column function (document, spans of its chunks) -> a vector for each span: the mean over the words that it holds.

    Each word has its own vector and a share of the document's, so that a chunk's vector knows what stands around it.
    """

    @F.pandas_udf("array<array<double>>")
    def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = make()
        for texts, spans in batches:
            out = []
            for text, some in zip(texts, spans, strict=True):
                if text is None or some is None or not len(some):
                    out.append([] if some is not None else None)
                    continue
                words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
                v = np.array(client.embed([text[a:b] for a, b in words] or [""]), float)
                whole = v.mean(0)
                at = [[k for k, (a, b) in enumerate(words) if a < s["end"] and s["start"] < b] for s in some]
                out.append([((v[k].mean(0) if k else 0 * whole) * 0.8 + whole * 0.2).tolist() for k in at])
            yield pd.Series(out)

    return embed


def generation(make: Callable[[], Writer], retries: int = 1) -> Callable[[Column], Column]:
    """A column function prompt -> answer; a batch that fails is tried again, then its answers are null."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for prompts in batches:
            answers: list[str | None] = [None] * len(prompts)
            for _ in range(retries + 1):
                try:
                    answers = client.generate(prompts.fillna("").tolist())
                    break
                except Exception:  # a service that fails leaves no answer
                    continue
            yield pd.Series(answers, index=prompts.index, dtype=object)

    return generate


def cached(rows: DataFrame, key: str, cache: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``answer``, the cache (key, answer) after it): only rows whose key the cache lacks are asked, each key once."""
    missing = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    after = cache.unionByName(ask(missing).where("answer is not null").select(*cache.columns))
    return rows.join(after, key, "left"), after


#: What is asked about a document and about one of its chunks.
HEADER = "You are generating a short context header for retrieval.\nGiven the document text and the chunk, return a 1-2 line header that adds missing context (title, subject, dates, names).\nReturn only the header text.\n\nDocument:\n"
SUMMARY = "Summarize the document in 1-2 lines. Keep it under {} characters. Return only the summary.\n\nDocument:\n"


def embed_text(kind: str, chunk: Column, document: Column, generate: Callable[[Column], Column] | None, doc_chars: int = 4000, longest: int = 300) -> Column:
    """The text of a chunk that is embedded: alone, or after a header (``contextual``) or a summary (``doc_summary``) where one is made.

    Prompts hold the first ``doc_chars`` characters of a document, and a summary is cut at ``longest``: both are rules of these
    augmentations. ``late`` chunks are embedded from their document, so their text stays.
    """
    if kind not in ("none", "late", "contextual", "doc_summary"):
        raise ValueError(f"unknown augmentation {kind}")
    if generate is None or kind in ("none", "late"):
        return chunk
    doc = F.substring(document, 1, doc_chars)
    if kind == "contextual":
        said = F.trim(generate(F.concat(F.lit(HEADER), doc, F.lit("\n\nChunk:\n"), chunk, F.lit("\n\nHeader:"))))
    else:
        said = F.rtrim(F.substring(F.trim(generate(F.concat(F.lit(SUMMARY.format(longest)), doc, F.lit("\n")))), 1, longest))
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat(said, F.lit("\n\n"), chunk)).otherwise(chunk)
