"""Periodic benchmark items, odd pages, wrapped licences; filter lattices, mixes and spelling variants against brute force."""

import collections
import itertools
import random
import re
import time
import zlib

import pytest

from corpusgraph.llm import anagram, decontam, html_text, lattice, mixing, queries
from corpusgraph.session import ship


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def test_no_periodic_item_is_lost():
    rng = random.Random(3)
    for _ in range(3000):
        unit, m = "".join(rng.choices("abcd ", k=rng.randint(1, 9))), rng.randint(50, 120)
        item = list((unit * m)[:m])
        for _ in range(rng.choice((0, 0, 3))):
            item[rng.randrange(m)] = rng.choice("abcd")
        item, e = "".join(item), int(0.06 * m)
        near = list(item)
        for _ in range(rng.randint(0, e + 1)):
            k = rng.randrange(len(near))
            near[k : k + 1] = rng.choice((["#"], [], ["#", near[k]]))
        text = (unit * 40)[: rng.randint(0, 60)] + "x" * rng.randint(0, 5) + "".join(near) + "".join(rng.choices("abcd ", k=rng.randint(0, 60)))
        hits, best = decontam.Searcher([(1, item)], 0.06).search(text), decontam.myers(decontam.normal(item), decontam.normal(text), e)
        assert bool(hits) == bool(best)
        assert all(b[1] >= a[2] for a, b in itertools.pairwise(hits))


TEXT = "<p>The quick brown fox jumps over the lazy dog, and then it rests. It was a long day, after all.</p>"
PARTS = {
    "<table><tr><td>Alpha</td><td>12</td></tr><tr><td>Beta</td><td>14</td></tr></table>": ["Alpha", "12", "Beta", "14"], "<ul><li>Milk</li><li>Eggs</li><li>Flour</li></ul>": ["Milk", "Eggs", "Flour"],
    "<figure><img><figcaption>A cat</figcaption></figure>": ["A cat"], "<pre>x = 1</pre>": ["x = 1"], "<blockquote><p>Yes.</p></blockquote>": ["Yes."], "<dl><dt>a</dt><dd>b</dd></dl>": ["a", "b"], "<h2>Top</h2>": ["Top"],
}


@pytest.mark.parametrize("around", ["<article>%s</article>", "<nav><ul><li><a href=x>Home</a></li></ul></nav><div id=content>%s</div><footer>c</footer>", "%s", "<main><section>%s</section></main>"])
def test_short_parts_of_a_text_stay(around):
    for part, lines in PARTS.items():
        for page in (TEXT * 2 + part + TEXT * 2, TEXT * 6 + part, part + TEXT * 6, TEXT + part * 3 + TEXT):
            got = html_text.content("<html><body>" + around % page + "</body></html>").split("\n")
            assert [x for x in got if x in lines][: len(lines)] == lines and "Home" not in got and "c" not in got[-1:]


@pytest.mark.parametrize("junk", ["<a", '<a "', "<!", "<?", '<p title="', "<svg></svg", "<a '<b \"", "</p", "<!--", "<script></script ", "<textarea>", "<div>", "< ", "<a b='"])
def test_junk_takes_time_in_proportion(junk):
    began = time.time()
    html_text.content(junk * (1_000_000 // len(junk)))
    assert time.time() - began < 10


DOCS = "doc_id long, text string, source string, part string, n long, mask int, word string"


def test_lattice_equals_brute_force(sp):
    rng = random.Random(1)
    base = ["the cat sat on a mat " * 60, "one " * 30, "HELLO WORLD " * 120, " ".join(f"w{k}" for k in range(250)) + " & so", None, "", " ".join(f"W{k}" for k in range(220))]
    rows = [(k if k % 11 else None, rng.choice(base), rng.choice(["a", "b", None, ""]), "x", 1, 2, None) for k in range(60)]
    rows += [(3, "one " * 30, "b", "y", 2, 3, "z")] * 2
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(40)] + [(5, 1, 0), (None, 1, 1)]
    good, toxic = collections.Counter(), collections.Counter()
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = max(good[i], q == 1), max(toxic[i], t == 1)
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i), strict=True) if bad})
    want, shapley = {}, collections.Counter()
    for part in {r[2] or "" for r in rows}:
        for p in itertools.permutations("ABCDE"):
            for s, f in enumerate(p):
                here, before = [(r, x) for r, x in zip(rows, fails, strict=True) if (r[2] or "") == part], set(p[:s])
                out = [r for r, x in here if f in x and not x & before]
                want[part, "".join(p), s + 1] = [sum(not x & (before | {f}) for _, x in here), len(out), sum(f in x and bool(x & before) for _, x in here), sum(x == {f} for _, x in here), sum(good[r[0]] for r in out), sum(toxic[r[0]] for r in out)]
                shapley[part, f] += len(out)
    got = lattice.audit(lattice.cells(sp.createDataFrame(rows, DOCS), sp.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r[c] for c in lattice.MEASURES] == want[r["part"], r["filter_order"], r["step"]] and r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    none = sp.createDataFrame([], DOCS)
    assert lattice.audit(lattice.cells(none, sp.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def mixed(sp, rows, block):
    docs = sp.createDataFrame(rows, DOCS)
    sized = mixing.sizes(docs)
    goals = mixing.targets(sized)
    placed = mixing.place(sized, goals)
    mix = mixing.mix(placed, mixing.slots(goals, block=block), block=block)
    return docs, goals, mix, mixing.taken(placed, mix)


def test_mix_is_even_and_exact(sp):
    rng = random.Random(2)
    size = {None: 40, "": 7, "a": 900, "b": 15, "é": 60, "z": 3}
    rows = [(k, " ".join(["w"] * rng.randint(0, 12)) or rng.choice([None, "", " \n"]), s, "p", 1, 2, None) for k, s in enumerate(s for s, n in size.items() for _ in range(n))]
    rows += [(None, "x y z", "a", None, None, None, None)] * 3 + [(4, "twice here", "a", None, None, None, None)] * 2 + [(9999, "long " * 5000, "é", None, None, None, None)]
    docs, goals, mix, taken = mixed(sp, rows, 16)
    out, pieces, goal = taken.collect(), mix.orderBy("slot", "offset").collect(), {r["source"]: r for r in goals.collect()}
    order = sorted((s for s in size if s is not None)) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x, *_ in rows if x == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:  # shared anew until none is above
        free = [s for s in order if s not in full]
        level = (left - sum(full.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            break
        full |= {s: 2 * sizes[s] for s in above}
    for s in order:
        assert goal[s]["source_size"] == sizes[s] and abs(goal[s]["target"] - full.get(s, level * weight[s])) < 1e-6
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = collections.Counter()
    for p in pieces:
        by[p["sid"]] += p["to_word"] - p["from_word"]
    assert all(abs(by[g["sid"]] - g["target"]) <= 0.5 for g in goal.values()) and sum(r["taken"] for r in out) == sum(by.values())
    # each stretch of the mix holds each source by its share of the slots
    slots = {p["slot"]: p["sid"] for p in pieces}
    need = collections.Counter(slots.values())
    seen = collections.Counter()
    for j in range(len(slots)):
        seen[slots[j]] += 1
        assert all(abs(seen[s] - need[s] * (j + 1) / len(slots)) < 4 for s in need)
    words = [x for r in mixing.texts(docs.where("doc_id < 1000 and doc_id != 4"), mix.where("id < 1000 and id != 4")).collect() for x in r["text"].split(" ")]
    assert len(words) == sum(p["to_word"] - p["from_word"] for p in pieces if p["id"] is not None and p["id"] < 1000 and p["id"] != 4)
    again = mixed(sp, rows[::-1], 16)[3].collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    for some in ([], [(1, None, "a", None, None, None, None), (2, " ", None, None, None, None, None)]):
        assert [(r["size"], r["target"], r["taken"]) for r in mixed(sp, some, 16)[3].collect()] == [(0, 0.0, 0)] * len(some)


def brute_variants(rows):
    n = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    some = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: max(some[w], key=lambda v: (n[v], [-ord(c) for c in v] + [0])) if some[w] else None for w in n}
    for w in n:
        if some[w]:
            form[w] = min(some[w], key=lambda v: (-n[v], v))
            form[w] = form[w] if n[form[w]] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(some[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(sp):
    rng = random.Random(6)
    stems = ["aabbaab", "ÀbcdéfgH", "nevertheless", "ab" * 5, "÷×øøøøø", "zzzzzzzz", "Straßenbahn", "x" * 200]
    rows = []
    for k in range(150):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [rng.choice("abÀézx")], [w[at], rng.choice("abéz")], [w[at], w[at]]))
            words.append("".join(w))
        rows.append((k, rng.choice([" ", "\n", "1", "—"]).join(words), "s", None, 1, 2, "w"))
    rows += [(7, "aabbaab ÀbcdéfgH " * 30, "s", None, 1, 2, "w")] * 2 + [(None, "nevertheless ab", None, None, None, None, None), (8, None, None, None, None, None, None), (9, "", None, None, None, None, None)]
    got = anagram.group(sp.createDataFrame(rows, DOCS)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_variants(rows)
    assert any(r["root"] != (r["form"] or r["word"]) for r in got)
    assert anagram.group(sp.createDataFrame([], DOCS)).count() == 0


def test_no_two_exchanges_have_one_value():
    powers = [k**5 for k in range(1, 91)]
    values = [a - b for a in powers for b in powers if a != b]
    assert len(values) == len(set(values)) and not set(values) & set(powers)


def test_new_queries_are_registered():
    assert {"op11_filter_audit", "op12_source_mix", "op13_spelling_variants"} <= queries.queries().keys() & queries.oracle_sql().keys()


def test_licences_are_found_at_every_width(sp):
    import textwrap

    from corpusgraph.llm import licenses

    s = licenses.SENTENCES
    full = {
        "MIT": [s["mit.grant"] + ":", s["mit.notice"] + ".", s["asis.software"] + "."], "MIT-0": [s["mit0.grant"] + ".", s["asis.software"] + "."], "ISC": [s["isc.grant"] + ".", s["isc.disclaim"] + "."], "0BSD": [s["0bsd.grant"] + ".", s["isc.disclaim"] + "."],
        "BSD-3-Clause": [s[f"bsd.{k}"] + "." for k in ("grant", "source", "binary", "names", "asis")], "GPL-3.0-or-later": [s["gpl.free"] + "; " + s["gpl3.either"] + "."],
    }
    rows, want = [], {}
    for name, parts in full.items():
        for mark in ("", " * "):
            for width in range(30, 121):
                want[len(rows)] = name
                rows.append((len(rows), "\n".join(mark + line for p in parts for line in [*textwrap.wrap(p, width), ""])))
    notices = {
        "This project is licensed under the MIT License.": "MIT", "Released under the MIT License (see LICENSE).": "MIT", "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT Apache-2.0", "Licensed under MIT": "MIT", "<p>Released under the MIT License.</p>": "MIT",
        "// SPDX-License-Identifier: (GPL-2.0-only OR MIT)\nint x;": "MIT GPL-2.0-only", "This library is released under the\nApache License 2.0, see\nLICENSE for more.": "Apache-2.0", "This project is not licensed under the MIT License.": "", "We read about things that are licensed under the MIT License.": "",
        "# SPDX-License-Identifier: MIT AND (ISC OR GPL-3.0-or-later)\n": "MIT ISC GPL-3.0-or-later", '<p class="x">Our code is licensed under <a href="l">the ISC license</a>.</p>': "ISC",
    }
    for text, name in notices.items():
        want[len(rows)] = name
        rows.append((len(rows), text))
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(sp.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (rows[k][1][:80], sorted(v.split())) for k, v in found.items()} == {k: (rows[k][1][:80], sorted(v.split())) for k, v in want.items()}


def test_texts_under_one_id_are_documents_of_their_own(sp, tmp_path):
    import corpus_pipeline

    item = "which of the seven rivers of the north runs backwards in the spring of every leap year"
    rows = [(1, "the first text of all with words in it", "en", "s", 9), (1, "quite another one that has nothing to do with that", "en", "s", 9), (1, "the first text of all with words in it", "en", "s", 9), (2, "the first text of all with words in it", "en", "s", 9), (3, item, "en", "s", 9), (3, "here is a clean text under a bad number", "en", "s", 9)]
    for kind in ("long", "string"):
        docs = sp.createDataFrame([(r[0] if kind == "long" else str(r[0]), *r[1:]) for r in rows], f"doc_id {kind}, text string, lang string, source string, n_chars long")
        sp.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{kind}/benchmark.parquet")
        kept = corpus_pipeline.near_dedup(sp, docs, "")
        assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows}) and kept.columns == docs.columns
        clean = corpus_pipeline.decontaminate(sp, kept, f"{tmp_path}/{kind}")
        assert sorted(r["text"] for r in clean.collect()) == sorted({r[1] for r in rows} - {item})
