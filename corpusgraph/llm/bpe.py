"""BPE encoding and decoding with a deterministic automaton compiled from the merge list.

The automaton reads tokens. It begins as one state with an arc for every base symbol. Each merge (u, v) adds a *merge
gadget*: the target p of the u-arcs is copied to p' without its v-arc, the u-arcs now lead to p', and every state that has a
u-arc gets an arc labelled uv to the target of p's v-arc. When all merges are in, exactly one path spells each word, and it
is the BPE encoding.

All arcs with one label lead to one state (true at the start; each gadget keeps it so), thus a state is given by the label
that leads to it. The gadget of (u, v) takes the v-arc, and the arcs of later labels that begin with v, from u's state and
from the states that were copied from it later. Numbered along the trees of right and of left parts, both are ranges, so a
gadget clears a rectangle of the transition table. States with equal rows and labels with equal columns share them: ``table``
holds one bit for each (row class, column class), about 25 MB for 49,000 tokens, filled once per worker.

Encoding reads the symbols of all new words of a batch in lockstep: a trie of labels gives the arcs that fit at each start,
and for each end position the one arc that the table has from the state reached at its start is taken. Words of more than
``LOCKSTEP`` symbols are stepped through alone, with the same table. Decoding reads ids and emits the labels of their arcs.

Edge cases: null and empty texts give no tokens and an empty text; strings of special tokens give their ids; long runs
without white space are encoded whole; repeated rows and extra columns have no effect (only the two named columns are read).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat

#: Bound of each cache of a worker (entries); of a full cache only what the last batch found in it stays.
CACHE_WORDS = 160_000
#: Longest words (in symbols) that are encoded in lockstep, and how many words go at once (their arrays take about 40 MB).
LOCKSTEP, WORDS_AT_ONCE = 64, 16_384
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _tour(parent: list[int], step: list[int]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Number of each node in a walk that takes later children first, size of its subtree, and its children in that order."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(n), key=lambda i: -step[i]):
        if parent[i] >= 0:
            kids[parent[i]].append(i)
    place, size, order = np.zeros(n, np.int64), [1] * n, []
    todo = [i for i in range(n) if parent[i] < 0]
    while todo:
        i = todo.pop()
        place[i] = len(order)
        order.append(i)
        todo.extend(reversed(kids[i]))
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    return place, np.array(size), kids


class MergeAutomaton:
    """The automaton of a vocabulary file with word-end symbols; ``symbols`` are the characters that stand for bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>", symbols: list[str] | None = None):
        self.suffix, self.labels = suffix, {i: s for s, i in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        self.left, self.right, self.step = [-1] * size, [-1] * size, [_NEVER] * size
        self.gadget: dict[int, int] = {}
        made = {vocab[a + b] for a, b in merges}
        alive = [i for i in vocab.values() if i not in made]
        for step, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.arc(u, v):
                self.left[w], self.right[w], self.step[w] = u, v, step
                self.gadget[u << 24 | v] = step
                alive.append(w)
        self.states = 1 + len(self.gadget)
        self._compile()
        self._trie(alive, {c: b for b, c in enumerate(symbols or byte_symbols())})

    def arc(self, x: int, y: int) -> bool:
        """Whether the state that x leads to has an arc labelled y at this point of the construction."""
        get, cy = self.gadget.get, _NEVER
        while y >= 0:
            z, cx = x, _NEVER
            while z >= 0:
                t = get(z << 24 | y)
                if t is not None and t < cx and t <= cy:
                    return False
                cx, z = self.step[z], self.right[z]
            cy, y = self.step[y], self.left[y]
        return True

    def _compile(self) -> None:
        """The transition table: a set bit for each (row class of a state, column class of a label) that has an arc."""
        px, sx, kx = _tour(self.right, self.step)
        py, sy, ky = _tour(self.left, self.step)
        cuts = []
        for key, t in self.gadget.items():
            z, w = key >> 24, key & 0xFFFFFF
            rows = cols = 1
            for c in kx[z]:
                if self.step[c] <= t:
                    break
                rows += sx[c]
            for c in ky[w]:
                if self.step[c] < t:
                    break
                cols += sy[c]
            cuts.append((px[z], px[z] + rows, py[w], py[w] + cols))
        cut = np.array(cuts, np.int64).reshape(-1, 4)
        row_at, col_at = (np.unique(np.concatenate([[0], cut[:, k], cut[:, k + 1]])) for k in (0, 2))
        self.row, self.col = np.searchsorted(row_at, px, "right") - 1, np.searchsorted(col_at, py, "right") - 1
        r0, r1, c0, c1 = (np.searchsorted(at, cut[:, k]) for at, k in ((row_at, 0), (row_at, 1), (col_at, 2), (col_at, 3)))
        at_row, at_col = np.concatenate([r0, r0, r1, r1]), np.concatenate([c0, c1, c0, c1])
        change = np.repeat(np.array([1, -1, -1, 1], np.int16), len(cut))
        order = np.argsort(at_row, kind="stable")
        at_row, at_col, change = at_row[order], at_col[order], change[order]
        width, block = len(col_at), 512
        self.table = np.zeros((len(row_at), -(-width // 8)), np.uint8)
        covered = np.zeros(width + 1, np.int16)
        for lo in range(0, len(row_at), block):
            hi = min(len(row_at), lo + block)
            some = slice(*np.searchsorted(at_row, [lo, hi]))
            part = np.zeros((hi - lo, width + 1), np.int16)
            np.add.at(part, (at_row[some] - lo, at_col[some]), change[some])
            part[0] += covered
            np.cumsum(part, axis=0, out=part)
            covered = part[-1].copy()
            np.cumsum(part, axis=1, out=part)
            self.table[lo:hi] = np.packbits(part[:, :width] == 0, axis=1)

    def has(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the table has the arc labelled y from the state that x leads to, for arrays of ids."""
        col = self.col[y]
        return (self.table[self.row[x], col >> 3] >> (7 - (col & 7)).astype(np.uint8) & 1).astype(bool)

    def _trie(self, alive: list[int], number: dict[str, int]) -> None:
        """The labels as a trie of bytes, kept as a hash table of (node, byte), and the label that ends at each node."""
        child: dict[int, int] = {}
        inner, final = [-1], [-1]
        for i in alive:
            s = self.labels[i]
            ends = s.endswith(self.suffix) and s != self.suffix
            node = 0
            for c in s[: -len(self.suffix)] if ends else s:
                if c not in number:
                    node = -1
                    break
                key = node << 8 | number[c]
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(inner)
                    inner.append(-1)
                    final.append(-1)
            if node > 0:
                (final if ends else inner)[node] = i
        self.inner, self.final, self.child = np.array(inner), np.array(final), child
        bits = max(4, (3 * len(child)).bit_length())
        self.shift, self.keys, self.next = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, to = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.next[slot[won]] = to[won]
            keys, to, slot = keys[~won], to[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        out, held = np.full(len(key), -1, np.int32), self.keys[slot]
        hit = held == key
        out[hit] = self.next[slot[hit]]
        left = np.flatnonzero(~hit & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def lockstep(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word); ``off`` cuts the bytes into words, none of them empty."""
        size = np.diff(off)
        word = np.repeat(np.arange(len(size)), size)
        begin, stop = off[:-1][word], off[1:][word]
        starts, nodes, length = np.arange(len(data)), np.zeros(len(data), np.int32), 0
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start, last symbol, label
        while len(starts):
            nodes = self._follow(nodes, data[starts + length])
            on = nodes >= 0
            starts, nodes = starts[on], nodes[on]
            last = starts + length
            ends = last + 1 == stop[starts]
            label = np.where(ends, self.final[nodes], self.inner[nodes])
            fits = label >= 0
            arcs.append((starts[fits], last[fits], label[fits]))
            starts, nodes, length = starts[~ends], nodes[~ends], length + 1
        first, last, label = (np.concatenate(x) for x in zip(*arcs, strict=True))
        rank = (last - begin[last]).astype(np.uint16)
        order = np.argsort(rank, kind="stable")
        first, last, label = first[order], last[order], label[order]
        bounds = np.searchsorted(rank[order], np.arange(int(size.max()) + 1))
        took, back = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            a, b, t = first[lo:hi], last[lo:hi], label[lo:hi]
            before = a > begin[a]
            ok = ~before
            ok[before] = self.has(took[a[before] - 1], t[before])
            took[b[ok]], back[b[ok]] = t[ok], a[ok]
        on_path, at = np.zeros(len(data), bool), off[1:] - 1
        while len(at):
            on_path[at] = True
            at = back[at] - 1
            at = at[at + 1 > begin[at + 1]]
        ids = took[on_path]
        if len(ids) and ids.min() < 0:
            raise ValueError("no arc for a symbol")
        return ids, np.add.reduceat(on_path, off[:-1], dtype=np.int64) if len(size) else size

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word of any length, given in bytes, by steps through the table from left to right."""
        n, child, table, row, col = len(raw), self.child, self.table, self.row, self.col
        took, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, x = 0, took[i]
            if i and x < 0:
                continue
            cells = table[row[x]] if i else None
            for j in range(i, n):
                node = child.get(node << 8 | raw[j], -1)
                if node < 0:
                    break
                t = int((self.final if j + 1 == n else self.inner)[node])
                if t >= 0 and (i == 0 or cells[col[t] >> 3] >> (7 - (col[t] & 7)) & 1):
                    took[j + 1], back[j + 1] = t, i
        out = []
        while n:
            if took[n] < 0:
                raise ValueError("no arc for a symbol")
            out.append(took[n])
            n = back[n]
        out.reverse()
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LOCKSTEP]
        for lo in range(0, len(short), WORDS_AT_ONCE):
            some = short[lo : lo + WORDS_AT_ONCE]
            off = np.concatenate([[0], np.cumsum([len(words[k]) for k in some])])
            ids, count = self.lockstep(np.frombuffer(b"".join([words[k] for k in some]), np.uint8), off)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            for k, a, b in zip(some, [0, *ends], ends, strict=False):
                out[k] = raw[a:b]
        for k, w in enumerate(words):
            if len(w) > LOCKSTEP:
                out[k] = np.array(self.word(w), "<u4").tobytes()
        return out


#: Letters and numbers that the splitting pattern's tables in this package know and those of the vocabulary's library don't yet.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
)
#: Capitals that Python's tables don't know yet, first and last, and the small letter of the first.
CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_SMALL = {a + k: small + k for a, b, small in CAPITALS for k in range(b - a + 1)}
_UNKNOWN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


class Tokenizer:
    """Normalising, pre-splitting, encoding and decoding as the vocabulary file says."""

    SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("a BPE file with word ends, NFC, lower case and no decoder is expected")
        self.automaton = MergeAutomaton(model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]], model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.labels = pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.string())
        self.split = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Ids of words of the pre-split, and of runs without white space as they stand in texts.
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _pieces(self, text: str | None) -> list[list[str] | bytes]:
        """Runs without white space, and the ids of special tokens between them."""
        if not text:
            return []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        return [self.special[p].to_bytes(4, "little") if k % 2 else p.split() if not _odd(p) else [c for c in self.SPACE.split(p) if c] for k, p in enumerate(parts)]

    def _learn(self, runs: Iterable[str]) -> None:
        """Puts the ids of runs into the cache; no word of the pre-split crosses white space."""
        known, split, todo, made = self.words, {}, {}, self.runs
        for c in runs:
            s = c if c.isascii() else unicodedata.normalize("NFC", c)
            s = s.lower() if "Σ" not in s else "".join([x.lower() for x in s])
            words = split[c] = [s] if s.isascii() and s.isalpha() else self.split.findall(s) if s.isprintable() else self._newer(s)
            for w in words:
                if w not in known:
                    todo[w] = None
        known.update(zip(todo, self.automaton.encode([w.encode() for w in todo]), strict=True))
        for c, words in split.items():
            made[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def _newer(self, s: str) -> list[str]:
        """The words of a run with code points of later tables: some are no letters to the vocabulary's library yet."""
        s = s.translate(_SMALL)
        return [s[m.start() : m.end()] for m in self.split.finditer(_UNKNOWN.sub("\uffff", s))]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._pieces(t) for t in texts]
        used = {c for pieces in cut for p in pieces if isinstance(p, list) for c in p}
        fresh = used - self.runs.keys()
        self._learn(fresh)
        get = self.runs.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in pieces]) for pieces in cut]
        if len(self.runs) > CACHE_WORDS:  # what came back stays
            self.runs = {c: self.runs[c] for c in used - fresh if len(c) <= LOCKSTEP}
            self.words = {c: self.words[c] for c in self.runs if c in self.words}
        elif any(len(c) > LOCKSTEP for c in fresh):
            self.runs, self.words = ({c: x for c, x in cache.items() if len(c) <= LOCKSTEP} for cache in (self.runs, self.words))
        return out

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The labels of the arcs that the ids of each row name, one space between; from the ids alone."""
        ids = ids.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = ids.buffers()
        off = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        labels = self.labels.take(pa.array(np.frombuffer(raw.tobytes(), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array((off - off[0]) // 4, pa.int32()), labels), " ")


def _odd(s: str) -> bool:
    """Whether it holds one of the four separators that str.split takes for white space and the vocabulary's pattern doesn't."""
    return "\x1c" in s or "\x1d" in s or "\x1e" in s or "\x1f" in s


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once per worker and kept while its tasks are BPE's."""
    return flat.kept(path, lambda: Tokenizer(path))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: (id, ids binary of little-endian unsigned 32-bit integers, decoded string). No shuffle.

    ``decoded`` is decoded from the column ``ids``.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in flat.tidy(batches, path):
            ids = tok.encode_all(batch.column(1).to_pylist())
            lo, held = 0, 0
            for k, x in enumerate(ids):
                held += 3 * len(x)
                if held > out_bytes or k + 1 == len(ids):
                    coded = pa.array(ids[lo : k + 1], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k + 1 - lo), coded, tok.decode_all(coded)], names=["id", "ids", "decoded"])
                    lo, held = k + 1, 0

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
