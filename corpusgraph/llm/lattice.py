"""Filter interaction audit by lattice-edge aggregation.

With k filters, the sets of filters already applied form a lattice; an edge (S, f) of it applies filter f after those of S. What
happens to a document at an edge depends on S as a set only, so all k! orders are read off k * 2^(k-1) edges: 80 for five
filters. Documents are first counted by part and by the set of filters that they fail (a bit mask); each such cell then adds to
its edges; and the edges are joined to the k * k! steps of all orders, each order being a path through the lattice.

The Shapley count of a filter is the number of documents that it removes, summed over all orders: an edge (S, f) lies on
|S|! * (k - 1 - |S|)! of them.

Everything is built of DataFrame functions. Texts are read once; what is shuffled is a digest and a few numbers per document,
and after that counts. Copies are counted by digest, part and labels before they meet, so a large group of them is a few rows.

Edge cases: a null text is the empty text, a null part the empty string. A null id has no smaller id and no label; rows that
repeat an id with the same text aren't copies of each other. Of several label rows of an id, one with a 1 decides. An empty
table has no parts, hence no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.session import discard, materialise

WHITE = " \t\n\x0b\f\r"
#: Counts of an edge, and what a cell adds to each of them.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed(rows: DataFrame, min_words: int = 200, min_distinct_percent: int = 50, max_upper_percent: int = 2, symbols: str = "#$%&*|") -> DataFrame:
    """Rows with ``mask``, the bits of the filters A to D that ``text`` fails: few words, few distinct words, many capitals, a symbol."""
    text = F.col("text")
    trimmed = F.btrim(text, F.lit(WHITE))
    split = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    fails = (
        F.size("_words") < min_words, 100 * F.size(F.array_distinct("_words")) < min_distinct_percent * F.size("_words"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > max_upper_percent * F.length(text), text.rlike("[" + symbols + "]"),
    )
    return split.withColumn("mask", sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))).drop("_words")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters failed, as a written table.

    Bit 4 is filter E: the text equals that of a smaller id of the whole table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = failed(rows).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "mask")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col(good_col) == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    once = marked.groupBy("id", *kind).agg(F.count("*").alias("n"))
    copies = once.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"),
    )
    copies = materialise(copies, "copies")
    first = copies.groupBy("digest").agg(F.min("low.id").alias("first"), F.sum("n").alias("all")).where("all > 1").select("digest", "first")
    stay = F.when(F.col("first").isNull(), F.col("n")).otherwise(F.col("unnamed") + F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0))
    met = copies.join(first, "digest", "left").withColumn("stay", stay)
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    counted = met.select("part", "good", "toxic", sides.alias("s")).where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic")
    )
    counted = materialise(counted, "cells")
    discard(copies)
    return counted


def edges(counted: DataFrame, k: int) -> DataFrame:
    """The lattice's edges of each part: (part, applied, filter, the measures, paths), zeros included; paths is the number of orders over the edge."""
    some = [(s, f, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    all_edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(p).cast("long").alias("paths")) for s, f, p in some))
    at = counted.select("*", F.explode(all_edges).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    reaches = F.col("mask").bitwiseAND(F.col("applied")) == 0
    fails = F.col("mask").bitwiseAND(bit) != 0
    adds = {
        "kept": (reaches & ~fails, "n"), "removed": (reaches & fails, "n"), "redundant": (~reaches & fails, "n"), "unique_fails": (F.col("mask") == bit, "n"),
        "good_lost": (reaches & fails, "good"), "toxic_lost": (reaches & fails, "toxic"),
    }
    return at.groupBy("part", "applied", "filter", "paths").agg(*(F.sum(F.when(adds[m][0], F.col(adds[m][1])).otherwise(0)).cast("long").alias(m) for m in MEASURES))


def orders(spark, names: Sequence[str]) -> DataFrame:
    """The steps of all orders of the filters: (filter_order, step, applied, filter); k * k! rows."""
    k = len(names)
    steps = [("".join(names[f] for f in p), s + 1, sum(1 << f for f in p[:s]), p[s]) for p in permutations(range(k)) for s in range(k)]
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")


def audit(counted: DataFrame, names: Sequence[str] = "ABCDE") -> DataFrame:
    """One row per part, order and step: (part, filter_order, step, the measures, shapley). The steps are k * k! rows, so they are broadcast."""
    lattice = edges(counted, len(names))
    # 2^(k-1) rows of a part and filter, however many documents they count
    share = lattice.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).cast("long").alias("shapley"))
    path = F.broadcast(orders(counted.sparkSession, names))
    return lattice.join(share, ["part", "filter"]).join(path, ["applied", "filter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
