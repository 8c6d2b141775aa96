"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources, ranked by name in code-point order (null last), weigh 5, 2, 1 and so on again, and share 150 % of all tokens;
a target stops at twice its source's tokens, and the excess is shared anew by weight until none is above.

Schedule: each source needs a whole number of slots of ``block`` tokens. The slots of all sources, laid one after another, are
the cumulative weights, and slot j of the mix is the source in whose stretch the van der Corput point of j falls. On 2^m points
that map (reversing m bits) is its own inverse, so each source gives its slots directly: those of the points of its stretch. How
many points of a stretch come before another is a sum over m bits, so slots are ranked per source without a window.

Blocks: the documents of a source, shuffled by a hash of the id, are one stream of tokens, cut into blocks. The r-th slot of a
source takes block r, from the start again when all were taken; the last slot is cut at the target. So a source gives
its target to half a token, and since no target is above twice the source's tokens, no document is taken more than twice.

At scale: documents are placed in their stream by sums per source and hash prefix, then within a prefix, where about the
square root of the documents' number share one, so a hot source isn't one task. Blocks and slots meet on (source, block): at
most ``block`` documents and two slots. Numbers of slots and of pieces follow the tokens.

Edge cases: null and empty texts have no tokens, are in no block and are taken 0 times; a null source is one, after all others;
null ids are ordered by size; of repeated rows each is placed and taken by itself. With no tokens at all, all targets are 0. An
empty table gives no rows; extra columns are ignored. The order of the shuffle depends on ids and ``seed`` alone, so reruns agree.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.session import discard, materialise

WEIGHTS, SHARE, MOST, BLOCK, SEED = (5, 2, 1), 1.5, 2, 1024, "mix"
WHITE = " \t\n\x0b\f\r"
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(id, source, size, place) of each document, as a written table: texts are read once. Place is the hash to shuffle by."""
    named = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"), named.alias("place")), "sizes")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their rank (from 0) in a total order, as a written table; sorted by range, so no task sees all rows."""
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row for each partition
    before = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    out = materialise(placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + within).drop("_at", "_n", "_before"), "ranks")
    discard(placed)
    return out


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) of each source, as a written table.

    Each round shares what the capped sources leave by weight, which is one sum over the sources; the level only rises, and
    once no further source is capped, it is done.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranks = ranked(totals, F.col("source").asc_nulls_last())
    known = ranks.select("source", F.col("rank").alias("sid"), "_part", "source_size", weight.alias("weight"))
    wanted = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > most * F.col("source_size")
        full, n, free = known.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.count(F.when(capped, 1)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == before or not free:
            break
        before, level = n, (wanted - (full or 0)) / free
    out = materialise(known.select("source", "sid", "_part", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target")), "targets")
    discard(ranks)
    return out


def slots(goals: DataFrame, block: int = BLOCK, chunk: int = 65536) -> DataFrame:
    """The schedule: (sid, slot, epoch, block, words) with the slot's number in the mix and the tokens that it takes of the block."""
    take = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    need = goals.where("source_size > 0").select("sid", "_part", "source_size", take.alias("take"), F.ceil(F.col("source_size") / block).alias("blocks"))
    need = need.select("*", F.expr("take div source_size").alias("full"), (F.col("take") % F.col("source_size")).alias("rest"))
    need = need.withColumn("n", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block))
    # sums before each source: of whole ranges of sources, then within one
    parts = need.groupBy("_part").agg(F.sum("n").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    need = need.join(F.broadcast(parts), "_part").withColumn("a", F.col("_before") + F.sum("n").over(Window.partitionBy("_part").orderBy("sid")) - F.col("n")).where("n > 0")
    need = need.select("sid", "source_size", "blocks", "full", "rest", "a", (F.col("a") + F.col("n")).alias("b"))
    total = need.agg(F.max("b")).first()[0] or 0
    bits = max(1, (total - 1).bit_length()) if total else 1
    chunks = need.withColumn("c", F.explode(F.sequence(F.expr(f"a div {chunk}"), F.expr(f"(b - 1) div {chunk}")))).repartition("sid", "c")
    points = chunks.withColumn("k", F.explode(F.sequence(F.greatest(F.col("a"), F.col("c") * chunk), F.least(F.col("b"), (F.col("c") + 1) * chunk) - 1)))

    def before(a: Column | int, b: Column | int) -> Column:
        """How many points of [a, b) come before k in the mix."""
        terms = []
        for i in range(bits):
            shift = (2 << i) - 1 - F.col("k").bitwiseAND((1 << i) - 1)
            terms.append(F.when(F.col("k").bitwiseAND(1 << i) != 0, F.shiftright(b + shift, i + 1) - F.shiftright(a + shift, i + 1)).otherwise(0))
        return reduce(Column.__add__, terms)

    at = points.withColumns({"r": before(F.col("a"), F.col("b")), "slot": before(F.lit(0).cast("long"), F.lit(total).cast("long"))})
    at = at.select("sid", "slot", F.expr("r div blocks").alias("epoch"), (F.col("r") % F.col("blocks")).alias("block"), "source_size", "full", "rest")
    held = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    return at.select("sid", "slot", "epoch", "block", F.when(F.col("epoch") < F.col("full"), held).otherwise(F.least(held, F.col("rest") - F.col("block") * block)).alias("words"))


def place(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(id, size, sid, source_size, target, start): where each document begins in its source's stream, as a written table."""
    n = sized.count()
    digits = max(1, round(log(max(n, 16)) / log(16) / 2))
    goal = goals.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    small = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    known = sized.join(small, F.col("source").eqNullSafe(F.col("_source"))).select("id", "size", "sid", "source_size", "target", "place", F.substring("place", 1, digits).alias("prefix"))
    sums = known.groupBy("sid", "prefix").agg(F.sum("size").alias("held"))
    sums = materialise(sums.select("sid", "prefix", (F.sum("held").over(Window.partitionBy("sid").orderBy("prefix")) - F.col("held")).alias("before")), "prefixes")
    within = Window.partitionBy("sid", "prefix").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return materialise(known.join(sums, ["sid", "prefix"]).select("id", "size", "sid", "source_size", "target", start.alias("start")), "placed")


def mix(placed: DataFrame, schedule: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: (slot, offset, sid, start, id, epoch, from_word, to_word); order by slot and offset to read it.

    Each row is a run of words of one document in a slot; (sid, start) is the document's row in ``placed``.
    """
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.select("sid", "block", "id", "start", (low - F.col("block") * block).alias("offset"), (low - F.col("start")).alias("from_word"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - low).alias("n"))
    # slots are made from a small table of sources, so their number can't be told from its size: never a broadcast
    met = pieces.join(schedule.hint("merge"), ["sid", "block"]).withColumn("n", F.least("n", F.col("words") - F.col("offset"))).where("n > 0")
    return met.select("slot", "offset", "sid", "start", "id", "epoch", "from_word", (F.col("from_word") + F.col("n")).alias("to_word"))


def taken(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """The placed documents with the number of words that the mix takes of each, repeats counted."""
    sums = mixed.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    some = placed.where("size > 0").join(sums, ["sid", "start"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, offset, id, text): the words of each run of the mix, joined by one space; ids name one text each."""
    source = docs.select(F.col(id_col).alias("id"), words(F.col(text_col).cast("string")).alias("w"))
    return mixed.join(source, "id").select("slot", "offset", "id", F.array_join(F.slice("w", (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int")), " ").alias("text"))
