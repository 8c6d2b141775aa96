"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is the multiset of its windows of five lower-case words (a text of one to four words is one window). A window
that occurs w times has weight w, as a region of w unit cells. Darts are thrown at each cell: a hash of the cell gives the
ranks at which they arrive (a Poisson process, so any two documents see the same darts in the cells that they share), and for
each dart the coordinate of the signature that it hits. Per coordinate the earliest dart inside the document's region is
kept; two documents agree in a coordinate with the probability of their weighted Jaccard similarity. A document throws
about k ln k + 2k darts, however long it is; where a coordinate is still empty, it throws on.

Signatures are cut into bands. Documents that share a band are candidates. Most links show early: in each bucket every member
is compared with two hubs (the member that shares most buckets overall, and the smallest); these links give parts. The rest is
exact: of each bucket, all members outside the largest part are a query set that meets all members
in blocks of bounded size. In a block, signatures that agree nearly as often as the threshold asks are followed by the exact
weighted Jaccard similarity; one link per query and part leaves it. So no bucket is gathered in a task, and its pairs are not
listed. All links come from exact similarities of whole texts, at or above the threshold; they give classes (connected
components).

Exact copies (same lower-case words) are merged before banding. With 24 bands of 5, a pair of similarity 0.8 shares no band
with probability 7e-5; in a block, its 120 coordinates fall below the margin of five standard deviations with less than 1e-6.

Edge cases: documents without words (null, empty, white space) are classes of their own; a null id gives a null class; rows
that share an id are one document; ties go to the smallest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat
from corpusgraph.llm.components import components
from corpusgraph.session import discard, materialise

WORDS, BANDS, ROWS, SIMILARITY = 5, 24, 5, 0.8
#: Largest table (rows of one id) that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: About as many members of a bucket meet in one block, as queries and as those searched; of long texts fewer, by their cells.
QUERIES, SEARCHED = 256, 2048
QUERY_CELLS, SEARCHED_CELLS = 1 << 18, 1 << 20


def cells(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell hashes, text of each cell, two digests of each text's words); a window's j-th occurrence is a cell of its own."""
    n = len(off) - 1
    starts, ends, doc = flat.words(data, off)
    h = flat.span_hash(flat.prefix_hash(data), starts, ends)
    n_words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
    digests = []
    for salt in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(h + (place + np.uint64(1)) * np.uint64(salt)))])
        digests.append(flat.mix(s[first[1:]] - s[first[:-1]] + n_words.astype(np.uint64)))
    keys, at = flat.shingles(h, doc, k)
    where = doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    keys, where = np.concatenate([keys, digests[0][short]]), np.concatenate([where, short])
    salt = flat.mix(np.arange(n, dtype=np.uint64) + np.uint64(0x6A09E667))
    order = np.argsort(keys ^ salt[where], kind="stable")
    ranked, where = keys[order], where[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (where[1:] != where[:-1])
    occurrence = np.arange(len(ranked)) - np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    return flat.mix(ranked + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), where, digests[0], digests[1]


def signatures(cell: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) earliest darts; rows of texts without cells are 0."""
    weight = np.bincount(doc, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    out, todo = np.zeros(n * k, np.uint64), weight > 0
    while todo.any():
        own = np.flatnonzero(todo[doc])
        c, d = cell[own], doc[own]
        best, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
        rank, throw = np.zeros(len(c)), 0
        while len(c):
            throw += 1
            x = flat.mix(c + np.uint64(throw * 0xD1B54A32D192ED03 % (1 << 64)))
            rank = rank - np.log(((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
            inside = rank <= reach[d]
            c, d, rank, x = c[inside], d[inside], rank[inside], x[inside]
            x = flat.mix(x ^ np.uint64(0x2545F4914F6CDD1D))
            slot = d * k + (x >> np.uint64(33)).astype(np.int64) % k
            np.minimum.at(best, slot, rank)
            won = best[slot] == rank
            dart[slot[won]] = x[won]
        full = np.isfinite(best).reshape(n, k).all(1) & todo
        rows = np.flatnonzero(full)
        out.reshape(n, k)[rows] = dart.reshape(n, k)[rows]
        todo &= ~full
        reach = np.where(todo, reach * 2, reach)
    return out.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) one hash for each band."""
    part = sig.reshape(len(sig), bands, rows)
    acc = np.broadcast_to(flat.mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x1F83D9AB)), part.shape[:2]).copy()
    for r in range(rows):
        acc = flat.mix(acc * np.uint64(0x9FB21C651E98DF25) + part[:, :, r])
    return acc.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, d1, d2, bands): digests of the words and band keys; null and empty for texts without words. No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            data, off = flat.buffers(batch.column(1))
            for lo, hi in flat.groups(off):
                n = hi - lo
                cell, doc, d1, d2 = cells(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                none = np.bincount(doc, minlength=n) == 0
                keys = band_keys(signatures(cell, doc, n, bands * rows), bands, rows)
                size = np.where(none, 0, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[~none].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(d1.view(np.int64), mask=none), pa.array(d2.view(np.int64), mask=none), lists], names=["id", "d1", "d2", "bands"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, d1 long, d2 long, bands array<long>")


def similarity(left: pa.Array, right: pa.Array, words: int = WORDS) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts (already in lower case)."""
    (ld, lo), (rd, ro) = flat.buffers(left), flat.buffers(right)
    out, k, n = np.zeros(len(left)), 0, len(left)
    while k < n:
        end = k + 1
        while end < n and lo[end + 1] - lo[k] + ro[end + 1] - ro[k] <= flat.CHUNK_BYTES:
            end += 1
        m = end - k
        a, da, *_ = cells(ld[lo[k] : lo[end]], lo[k : end + 1] - lo[k], words)
        b, db, *_ = cells(rd[ro[k] : ro[end]], ro[k : end + 1] - ro[k], words)
        salt = flat.mix(np.arange(m, dtype=np.uint64) + np.uint64(0xBB67AE85))
        x = np.sort(np.concatenate([a ^ salt[da], b ^ salt[db]]))
        where = np.concatenate([da, db])[np.argsort(np.concatenate([a ^ salt[da], b ^ salt[db]]), kind="stable")]
        shared = np.bincount(where[1:][x[1:] == x[:-1]], minlength=m)
        total = np.bincount(da, minlength=m) + np.bincount(db, minlength=m) - shared
        out[k:end] = shared / np.maximum(total, 1)
        k = end
    return out


def verify(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least the threshold, with it; texts (id, text) hold each id once."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            s = similarity(batch.column(2), batch.column(3), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(s, 6))], names=["a", "b", "similarity"]).filter(pa.array(s >= threshold))

    return both.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def marks(texts: DataFrame, words: int, k: int) -> DataFrame:
    """(rep, sig, cells, n) of texts (id, text): the signature in 16 bits a coordinate, the sorted cells and their number."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            data, off = flat.buffers(batch.column(1))
            for lo, hi in flat.groups(off):
                n = hi - lo
                cell, doc, *_ = cells(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                sig = signatures(cell, doc, n, k).astype(np.uint16)
                size = np.bincount(doc, minlength=n)
                parts = np.split(cell[np.lexsort((cell, doc))], np.cumsum(size)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(size)], names=["rep", "sig", "cells", "n"])

    return texts.select("id", "text").mapInArrow(run, f"rep {kind}, sig binary, cells binary, n long")


def block_links(asks: np.ndarray, part: np.ndarray, sig: np.ndarray, cell: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block's queries to members of other parts, one for each query and part: places of both ends."""
    k = sig.shape[1]
    least = k * threshold - 5 * np.sqrt(k * threshold * (1 - threshold))
    first = np.concatenate([[0], np.cumsum(size)])
    known, number = np.unique(cell, return_inverse=True)
    held, inner, left, right = np.zeros(len(known), bool), np.flatnonzero(~asks), [], []
    for x in np.flatnonzero(asks):
        y = inner[((sig[inner] == sig[x]).sum(1) >= least) & (part[inner] != part[x])]
        own = number[first[x] : first[x + 1]]
        held[own] = True
        shared = np.array([held[number[first[j] : first[j + 1]]].sum() for j in y], float)
        held[own] = False
        y = y[shared / np.maximum(size[x] + size[y] - shared, 1) >= threshold]
        y = y[np.unique(part[y], return_index=True)[1]]
        left.append(np.full(len(y), x))
        right.append(y)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _sized(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where its counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def across(members: DataFrame, hubs: DataFrame, roots: DataFrame, texts: DataFrame, words: int, k: int, threshold: float) -> DataFrame:
    """Linked parts (a, b): parts of a bucket with members that are linked and aren't hubs. A written table.

    members (key, rep), hubs (key, hub, low) and roots (node, root) as in near_duplicates; texts (id, text). Hubs have met all of
    their bucket already. What is known of a whole bucket (one row each) is broadcast where its counted size allows it, so that
    the members of a hot bucket aren't gathered by its key; they meet in blocks only.
    """
    kind = members.schema["rep"].dataType.simpleString()
    rest = members.join(hubs, "key").where("rep != hub and rep != low").select("key", "rep")
    rest = rest.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("part"))
    main = rest.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    main = materialise(main.select("key", "main"), "main")
    rest = materialise(rest.join(_sized(main), "key").withColumn("asks", F.expr("part != main")), "rest")
    ids = materialise(rest.select(F.col("rep").alias("id")).distinct(), "ids")
    known = materialise(marks(texts.join(_sized(ids), "id", "left_semi").distinct(), words, k), "marks")
    counted = rest.join(known.select("rep", "n"), "rep")
    most = lambda c, members, cells: F.greatest(F.lit(1), F.ceil(F.count(c) / members), F.ceil(F.coalesce(F.sum(c), F.lit(0)) / cells)).cast("long")
    sizes = materialise(counted.groupBy("key").agg(most(F.when(F.col("asks"), F.col("n")), QUERIES, QUERY_CELLS).alias("nq"), most(F.col("n"), SEARCHED, SEARCHED_CELLS).alias("ns")), "sizes")
    rows, spread = rest.join(_sized(sizes), "key").join(known, "rep"), F.xxhash64("rep", "key")
    queries = rows.where("asks").withColumn("q", F.pmod(spread, "nq")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ns") - 1)))
    searched = rows.withColumn("s", F.pmod(spread, "ns")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    side = lambda df, asks: df.select("key", "q", "s", F.struct(F.lit(asks).alias("asks"), "part", F.xxhash64("part").alias("which"), "sig", "cells", "n").alias("m"))
    blocks = side(queries, True).unionByName(side(searched, False)).groupBy("key", "q", "s").agg(F.collect_list("m").alias("m")).select("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            for block in batch.column(0):
                m = block.values
                joined = lambda name, kind: np.frombuffer(b"".join(m.field(name).to_pylist()), kind)  # noqa: E731, B023
                ends = block_links(m.field("asks").to_numpy(zero_copy_only=False), m.field("which").to_numpy(), joined("sig", np.uint16).reshape(len(m), k), joined("cells", np.uint64), m.field("n").to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([m.field("part").take(pa.array(v)) for v in ends], names=["part", "other"])

    found = blocks.mapInArrow(run, f"part {kind}, other {kind}").select(F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    linked = materialise(found.distinct(), "joined")
    discard(main, rest, ids, known, sizes)
    return linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: (id, class_id), the class being the smallest id among linked documents."""
    seen = materialise(sketch(docs, id_col, text_col, words, bands, rows), "sketch")
    copies = materialise(seen.where("id is not null and d1 is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep")), "copies")
    reps = seen.join(copies.select(F.col("rep").alias("id")), "id", "left_semi").where("d1 is not null").select(F.col("id").alias("rep"), F.explode("bands").alias("key"))
    buckets = reps.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(reps.join(buckets, "key").distinct(), "members")
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    hubs = materialise(members.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", "rep"))["rep"].alias("hub"), F.min("rep").alias("low")), "hubs")
    lower = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("id is not null")
    out = seen.select("id", "d1", "d2").join(copies, ["d1", "d2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    pairs = members.join(hubs, "key").select("rep", F.explode(F.array("hub", "low")).alias("other")).where("rep != other")
    pairs = materialise(pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        involved = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "involved")
        texts = materialise(lower.join(_sized(involved), "id", "left_semi"), "texts")
        roots = components(verify(pairs, texts, words, threshold).select("a", "b"))
        joined = across(members.where("n > 2").select("key", "rep"), hubs, roots, lower, words, bands * rows, threshold)
        steps = [roots] if joined.isEmpty() else [roots, components(joined)]
        for step in steps:
            out = out.join(step.select(F.col("node").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("rep"))
        discard(involved, texts, joined)
    discard(members, hubs, pairs)
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("rep")).alias("class_id"))
