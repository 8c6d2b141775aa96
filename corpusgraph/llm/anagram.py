"""Spelling variant grouping by anagram hashing.

A word's key is the sum of a power of each letter's number, so anagrams have one key, and adding, removing or exchanging a letter
changes it by a value that names the letters (fifth powers: no two exchanges of the letters in use have the same value; tested).
Words are near if they differ by one inserted, deleted or replaced code point:

- a word and one that is a letter longer: the key is the longer one's without that letter;
- two words of a length: the keys without one letter each are equal (their difference is the exchange value).

So each word stands under its own key and, for each letter, under its key without it, and words that meet there are compared letter
by letter. An edit also leaves one half of a word as it was; rows meet on that half too. So an anagram group, however large, isn't
compared pair by pair, and each near pair comes out once.

A form is the near word of the largest count (ties: the smallest word), if that is at least ``times`` the word's own. Counts
rise by that factor along a chain of forms, so roots are found in as many joins as a count has digits.

At scale: occurrences are counted within each Arrow batch, then by word; a frequent word is one row a task. All else is one row per
distinct word and letter. Groups that meet are words with the same half, and the same letters but one in the other half.

Edge cases: null texts have no words, null ids count as empty text in the hash; runs of any length are taken whole; repeated rows
count again; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat
from corpusgraph.session import discard, materialise

#: Letters a to z have the numbers 1 to 26, U+00C0 to U+00FF those from 27.
POWER, LATIN = 5, 0xC0
MIN_LETTERS, MIN_COUNT, TIMES, TYPO = 7, 2, 10, 31
#: Runs of more bytes are hashed one by one.
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, code points and texts of the maximal runs of letters with at least so many code points."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none
    lead = data == 0xC3  # in UTF-8 only U+00C0 to U+00FF begin with it
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1] & _TAIL[data[1:]]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    filled = off[:-1] < off[1:]
    first[off[:-1][filled]] = letter[off[:-1][filled]]
    last[off[1:][filled] - 1] = letter[off[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pairs = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (pairs[ends] - pairs[starts])
    some = points >= least
    starts, ends, points = starts[some], ends[some], points[some]
    return starts, ends, points, np.searchsorted(off[1:], starts, "right")


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run, carried on from the checksum begun for it."""
    state, length = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    short = np.flatnonzero(length <= LONG)
    short = short[np.argsort(-length[short], kind="stable")]
    upto = np.searchsorted(-length[short], -np.arange(LONG), "left")  # runs longer than k come first
    for k in range(LONG):
        at = short[: upto[k]]
        if not len(at):
            break
        state[at] = _CRC[(state[at] ^ data[starts[at] + k]) & np.uint32(0xFF)] ^ state[at] >> np.uint32(8)
    out = state ^ np.uint32(0xFFFFFFFF)
    for r in np.flatnonzero(length > LONG):
        out[r] = zlib.crc32(data[starts[r] : ends[r]].tobytes(), int(begun[r]))
    return out


def _batch_counts(ids: list[str], data: np.ndarray, off: np.ndarray, least: int, typo: int) -> pa.StructArray:
    """Distinct words of some texts with their counts."""
    data = _LOWER[data]
    starts, ends, points, doc = runs(data, off, least)
    begun = np.array([zlib.crc32(i.encode() + b":") for i in ids], np.uint32)
    crc = checksums(data, starts, ends, begun[doc])
    hit = crc % typo == 0
    cut = []
    for r in np.flatnonzero(hit & (points > least)):
        word, at = data[starts[r] : ends[r]].tobytes().decode(), int(crc[r]) % int(points[r])
        cut.append(word[:at] + word[at + 1 :])
    starts, ends = starts[~hit], ends[~hit]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    flatbytes = data[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flatbytes.tobytes()))
    return pc.value_counts(pa.chunked_array([whole, pa.array(cut, pa.large_string())]))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): distinct words with their occurrences. Counts are summed in each batch, then in each task, before the shuffle.

    A run whose crc32 of ``<id>:<run>`` is a multiple of ``typo`` loses the code point at that checksum modulo its length.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            data, off = flat.buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            found = []
            for lo, hi in flat.groups(off):
                got = _batch_counts(ids[lo:hi], data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], min_letters, typo)
                found.append(pa.table({"word": got.field(0), "n": got.field(1)}))
            if found:
                whole = pa.concat_tables(found).group_by("word").aggregate([("n", "sum")])
                yield from pa.table({"word": whole["word"].cast(pa.string()), "n": whole["n_sum"].cast(pa.int64())}).to_batches()

    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def power(letter: Column) -> Column:
    """The letter's number to the power, exact."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 128, code - 96).otherwise(code - (LATIN - 27))
    return number * number * number * number * number


def near(counted: DataFrame) -> DataFrame:
    """(word, n, other, m) for every near pair of distinct words, once: the shorter word first, of equal lengths the smaller."""
    keyed = counted.withColumn("key", F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(power(c))))
    left, right = F.expr("left(word, length(word) div 2)"), F.expr("substring(word, length(word) div 2 + 1)")

    def side(name: str, kept: Column, rest: Column) -> Column:
        """The word without each letter of one half, beside the other half."""
        return F.transform(F.filter(F.array_distinct(F.split(rest, "")), lambda c: c != ""), lambda c: F.struct((F.col("key") - power(c)).alias("key"), F.xxhash64(F.lit(name), kept).alias("half"), F.lit(name).alias("side")))

    # the halves of the word that is a letter longer: the cut falls where its own cut would, with the letter in the other half
    more = F.array(
        F.struct(F.col("key"), F.xxhash64(F.lit("l"), F.expr("left(word, (length(word) + 1) div 2)")).alias("half"), F.lit("l").alias("side")),
        F.struct(F.col("key"), F.xxhash64(F.lit("r"), F.expr("substring(word, (length(word) + 1) div 2)")).alias("half"), F.lit("r").alias("side")),
    )
    one = F.transform(F.concat(side("l", left, right), side("r", right, left)), lambda x: F.struct(x["key"], x["half"], x["side"], F.lit(False).alias("whole")))
    rows = keyed.select("word", "n", F.explode(F.concat(one, F.transform(more, lambda x: F.struct(x["key"], x["half"], x["side"], F.lit(True).alias("whole"))))).alias("x"))
    rows = rows.select("word", "n", "x.*")
    a, b = rows.alias("a"), rows.hint("merge").alias("b")  # many rows for each word of a table that may look small: never a broadcast
    exchanged = ~F.col("a.whole") & (F.col("a.word") < F.col("b.word")) & (F.length("a.word") == F.length("b.word"))
    added = F.col("a.whole") & (F.length("a.word") + 1 == F.length("b.word"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.side") == F.col("b.side")) & ~F.col("b.whole") & (exchanged | added))
    met = met.where(F.levenshtein("a.word", "b.word", 1) == 1)
    # a letter added beside its like at the cut can be taken from either half
    twice = F.col("a.whole") & (F.col("a.side") == "r") & (F.expr("left(a.word, length(b.word) div 2)") == F.expr("left(b.word, length(b.word) div 2)"))
    return met.where(~twice).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("m"))


def forms(counted: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of every counted word."""
    both = F.explode(F.array(F.struct(F.col("word").alias("word"), F.col("other").alias("by"), F.col("m").alias("by_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("by"), F.col("n").alias("by_n"))))
    best = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("by_n")).alias("low"), "by")).alias("best"))
    much = -F.col("best.low") >= times * F.col("n")
    return counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.by")).alias("form"), F.when(much, -F.col("best.low")).cast("long").alias("form_n")
    )


def roots(formed: DataFrame) -> DataFrame:
    """The rows of ``forms`` with ``root``: the last of the chain of forms from the word on, the word itself without any."""
    step = materialise(formed.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("to")), "steps")
    named = materialise(step.select(F.col("to").alias("form")).distinct().select("form", F.col("form").alias("root")), "forms")
    ended, spare = [], [step, named]
    while not named.isEmpty():
        going = materialise(named.join(step, F.col("root") == F.col("at"), "left").select("form", "root", "to"), "chains")
        ended.append(going.where("to is null").select("form", "root"))
        named = going.where("to is not null").select("form", F.col("to").alias("root"))
        spare.append(going)
    last = ended[0] if ended else step.select(F.col("to").alias("form"), F.col("to").alias("root")).limit(0)
    for x in ended[1:]:
        last = last.unionByName(x)
    out = materialise(formed.join(last, "form", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "roots")
    discard(*spare)
    return out


def group(docs: DataFrame, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents, as a written table."""
    counted = materialise(words(docs, **options), "words")
    formed = materialise(forms(counted, near(counted)), "formed")
    out = roots(formed)
    discard(counted, formed)
    return out
