"""The methods, without Spark: against brute force, exact round trips and known values."""

import collections
import io
import itertools
import os
import random
import re
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import bpe, dartminhash, decontam, flat, gbt, html_text, langid, quality, secrets, toxicity, warc

VOCAB = "/opt/tokenizers/word_bpe_49k.json"
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")
TEXTS = ["", None, "a", " \n\t ", "a b c d e", "a b c d e a b c d e", "x\nx\n\nx\n y", "É ß 字 🙂 é", "one two three " * 400, "#*$ % & |<>", "line\nline\nother\n" * 3, "w" * 5000]


def words_of(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


@needs_vocab
def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    mine, theirs = bpe.load(VOCAB), Tokenizer.from_file(VOCAB)
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["it's we're", "a\x1cb\x1fc\x85d\xa0e", "ΣΑΣ İ", "<|endoftext|>x<|startoftext|><|end", "uuuuu aaaaaaaaaaa", "é ẛ̣"]
    texts += ["".join(rng.choice("aeioulrstn th'éß字<|>1_-.́ΣÀ🙂") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    wants = [theirs.encode(s, add_special_tokens=False).ids for s in texts]
    got = mine.encode_all(texts)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == wants
    assert mine.decode_all(pa.array(got, pa.binary())).to_pylist() == [theirs.decode(w, skip_special_tokens=False) for w in wants]
    assert mine.encode_all(texts) == got and mine.encode_all(["J̌ ǰ", None, ""])[1:] == [b"", b""]
    assert mine.encode_all(["J̌", "ǰ"]) == [struct.pack(f"<{len(w)}I", *w) for w in (theirs.encode(x, add_special_tokens=False).ids for x in ("J̌", "ǰ"))]


@needs_vocab
def test_bpe_decodes_from_ids_alone():
    mine = bpe.load(VOCAB)
    ids = mine.encode_all(["one two three", "", "four"])
    swapped = [ids[0][4:] + ids[0][:4], ids[1], ids[0][:4]]
    assert mine.decode_all(pa.array(swapped, pa.binary())).to_pylist() == ["two</w> three</w> one</w>", "", "one</w>"]
    assert mine.decode_all(pa.array([None, b""], pa.binary())).to_pylist() == ["", ""]


@needs_vocab
def test_bpe_lockstep_equals_single_steps_and_the_table_the_construction():
    auto, rng = bpe.load(VOCAB).automaton, random.Random(7)
    words = ["".join(rng.choices("aeioulrstnmhd'é", k=rng.randint(1, 64))).encode()[:64] for _ in range(400)]
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, count = auto.lockstep(np.frombuffer(b"".join(words), np.uint8), off)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [auto.word(w) for w in words]
    x, y = (np.array([rng.randrange(3000 if rng.random() < 0.7 else 49_000) for _ in range(20_000)]) for _ in "xy")
    assert auto.has(x, y).tolist() == [auto.arc(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    long = b"ab" * 100_000
    assert b"".join(auto.labels[i].encode() for i in auto.word(long)) == long + b"</w>"


def test_bpe_automaton_on_a_small_merge_list():
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a"), ("aa", "aa")]
    vocab = {s: k for k, s in enumerate(["a", "b", "a</w>", "b</w>", *(x + y for x, y in merges)])}
    auto = bpe.MergeAutomaton(vocab, merges)
    for n in range(1, 9):
        for w in itertools.product("ab", repeat=n):
            seq = [*w[:-1], w[-1] + "</w>"]
            while True:  # merge the first pair of the lowest rank
                ranked = [(merges.index(p), k) for k, p in enumerate(zip(seq, seq[1:], strict=False)) if p in merges]
                if not ranked:
                    break
                k = min(ranked)[1]
                seq[k : k + 2] = [seq[k] + seq[k + 1]]
            assert [auto.labels[i] for i in auto.word("".join(w).encode())] == seq
            assert auto.encode(["".join(w).encode()]) == [struct.pack(f"<{len(seq)}I", *(vocab[x] for x in seq))]


def brute_counts(s):
    s, w = s or "", words_of(s)
    seen, dup = set(), 0
    for x in s.split("\n"):
        if words_of(x):
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), dup, len(cover)


def test_quality_counts_equal_brute_force():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", "b", "c ", "\n", " ", "é ", "#", "a b c d e f "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    counts, features = quality.statistics(*flat.buffers(pa.array(texts, pa.string())))
    assert [tuple(c) for c in counts] == [brute_counts(s) for s in texts]
    assert np.isfinite(features).all() and features.shape == (len(texts), len(quality.FEATURES))


def test_trees_obey_constraints():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    model = gbt.fit(x, y, [1, -1, 0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    for f, way in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 30), 50)
        assert (np.diff(model.score(grid).reshape(50, 30), axis=1) * way >= -1e-12).all()
    assert 0 < gbt.fit(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(np.zeros((2, 3)))[0] < 1


def naive_bits(grams, symbols, context, s):
    """Code length by walking the contexts from the longest, with exclusion."""
    bits, out = 0.0, set()
    for k in range(len(context), -1, -1):
        seen = {x: n for x, n in grams.get(context[len(context) - k :], {}).items()}
        if not seen:
            continue
        left = {x: n for x, n in seen.items() if x not in out}
        n, d = sum(left.values()), len(left)
        if s in left:
            return bits - np.log2(left[s] / (n + d))
        if left:
            bits -= np.log2(d / (n + d))
        out |= set(seen)
    return bits - np.log2(1 / (symbols - len(out)))


def test_ppm_code_lengths_equal_a_naive_walk():
    train, texts = {"xx": ["abab abba bab", "aab"], "yy": ["cdcd dcc", "ddc a"]}, ["abba", "cdd a", "zz", "a", "ab" * 40]
    langs = sorted(train)
    counted = [langid.count_grams(*flat.buffers(pa.array(train[x]))) for x in langs]
    model = langid.build(langs, [k.astype(np.int64) for k, _ in counted], [c.astype(float) for _, c in counted])
    assert np.allclose(np.exp2(-model.bits.astype(float)).sum(1), 1, atol=1e-5)
    got = langid.code_lengths(model, *flat.buffers(pa.array(texts)))
    for x, lang in enumerate(langs):
        grams: dict = {}
        for t in train[lang]:
            s = [int(model.symbol[b]) for b in t.encode()]
            s = [int(model.symbol[32])] * 3 + s
            for i in range(3, len(s)):
                for k in range(4):
                    g = grams.setdefault(tuple(s[i - k : i]), collections.Counter())
                    g[s[i]] += 1
        for t, text in enumerate(texts):
            s = [int(model.symbol[32])] * 3 + [int(model.symbol[b]) for b in text.encode()]
            assert abs(sum(naive_bits(grams, model.symbols, tuple(s[i - 3 : i]), s[i]) for i in range(3, len(s))) - got[t, x]) < 1e-3


def test_ppm_tells_scripts_and_refuses_models_without_bound(monkeypatch):
    train = {"bg": "те са тук и там ", "ru": "они здесь и там ", "el": "είναι εδώ και εκεί ", "hi": "वे यहाँ और वहाँ हैं ", "en": "they are here and there "}
    counted = [langid.count_grams(*flat.buffers(pa.array([train[x] * 5]))) for x in sorted(train)]
    parts = [k.astype(np.int64) for k, _ in counted], [c.astype(float) for _, c in counted]
    model = langid.build(sorted(train), *parts)
    assert model.symbols == len(set("".join(train.values()).encode())) + 1
    texts = list(train.values())
    assert [model.langs[k] for k in langid.code_lengths(model, *flat.buffers(pa.array(texts))).argmin(1)] == list(train)
    monkeypatch.setattr(langid, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError):
        langid.build(sorted(train), *parts)


def bag(s):
    w = (s or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_dart_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 60)}" for _ in range(300)]
    texts = []
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 25)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 999)}"
        texts.append(" ".join(w + base[: rng.randint(0, 60)]))
    texts += ["a", "a b", "", "a b c d e"]
    data, off = flat.buffers(pa.array(texts))
    cell, doc, *_ = dartminhash.cells(data, off)
    sig = dartminhash.signatures(cell, doc, len(texts), 2000)
    pairs = list(itertools.combinations(range(12), 2))
    exact = [sum((bag(texts[a]) & bag(texts[b])).values()) / sum((bag(texts[a]) | bag(texts[b])).values()) for a, b in pairs]
    assert np.allclose(dartminhash.similarity(pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs])), exact)
    assert np.abs([(sig[a] == sig[b]).mean() - j for (a, b), j in zip(pairs, exact, strict=True)]).max() < 0.06
    assert (sig[14] == 0).all() and (sig[12] != 0).all()


def edit_row(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return row


def test_myers_and_pigeonhole_search():
    rng = random.Random(4)
    for _ in range(300):
        p, t, k = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(0, 30))), rng.randint(0, 6)
        d = edit_row(p, t)[1:]
        assert decontam.myers(p, t, k) == ((d.index(min(d)) + 1, min(d)) if d and min(d) <= k else None)
    item = "".join(rng.choices("abcdefghij ", k=120))
    finder = decontam.Searcher([(7, item), (8, None), (9, "")], 0.06)
    for edits in range(0, 8):
        s = list(item)
        for at in rng.sample(range(120), edits):
            s[at] = "#"
        text = "x" * 50 + "".join(s).upper() + "y" * 50
        best = min(edit_row(item, decontam.normal(text))[1:])
        hits = finder.search(text)
        assert bool(hits) == (best <= 7) and (not hits or hits[0][3] == best and hits[0][0] == 7)
    assert finder.search(None) == [] and finder.search(item + " " + item)[1][1] >= 120


def naive_guesses(value, words):
    """The cheapest segmentation over all pairs of ends."""
    n, low = len(value), value.lower()
    plain = low.translate(secrets._LEET)
    kinds = ((26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)), (10, any(c.isdigit() for c in value)), (33, any(not c.isalnum() for c in value)))
    brute, best = np.log10(max(sum(k for k, some in kinds if some), 10)), [0.0]
    for j in range(1, n + 1):
        costs = [best[j - 1] + brute]
        for i in range(j - 2):
            part, m, v = low[i:j], j - i, value[i:j]
            case = 0.0 if v.islower() or not v.isalpha() else 0.3 if v.istitle() or v.isupper() else np.log10(m) + 0.6
            some = [words[part] + case] if part in words else [words[plain[i:j]] + 0.6 + case] if plain[i:j] in words else []
            steps = {ord(b) - ord(a) for a, b in itertools.pairwise(part)}
            some += [np.log10(47 * 4.6 * m)] if all(b in secrets._NEAR.get(a, ()) for a, b in itertools.pairwise(part)) else []
            some += [np.log10(52 * m)] if steps in ({1}, {-1}) else []
            some += [u * brute + np.log10(m // u) for u in range(1, m // 2 + 1) if m % u == 0 and part == part[:u] * (m // u)]
            some += [2.1 if m == 4 else 4.6] if any(d.fullmatch(part) for d in secrets.DATES) else []
            costs += [best[i] + c + 0.3 for c in some]
        best.append(min(costs))
    return best[n]


def test_guesses():
    words = secrets.dictionary()
    assert secrets.guesses("password", words) < 2 < secrets.guesses("x9$Kq!2mZr", words)
    assert secrets.guesses("qwertyuiop", words) < 5 and secrets.guesses("aaaaaaaaaaaa", words) < 5 and secrets.guesses("2024-01-31", words) < 6
    assert secrets.guesses("P@ssw0rd", words) < secrets.guesses("Pxssqzrd", words)
    words, rng = secrets.Words({"pass": 1.0, "word": 1.2, "abc": 0.7, "aab": 2.0}), random.Random(5)
    for _ in range(600):
        alphabet = rng.choice(["ab", "abc1", "a1b2", "qwerty", "20241-", "Passwordabc019./"])
        v = "".join(rng.choices(alphabet, k=rng.randint(0, 16))) * rng.choice([1, 1, 2, 3])
        assert abs(secrets.guesses(v, words) - naive_guesses(v, words)) < 1e-9


def test_long_inputs_take_little_time():
    began, words = time.time(), secrets.dictionary()
    for v in ("a" * 40_000, "ab" * 20_000, "qw" * 20_000, "".join(random.Random(1).choices("abcdefghijklmnop0123456789", k=40_000))):
        secrets.scan("password = " + v, words, 10.0)
    secrets.scan("token: abcdefghijklm0 " * 20_000, secrets.Words(), 10.0)
    item = "one two three four five six seven eight nine ten eleven twelve"
    assert len(decontam.Searcher([(1, item)], 0.06).search(f"{item} . " * 5_000)) == 5_000
    assert decontam.Searcher([(1, "ab" * 40)], 0.06).search("ab" * 20_000)
    assert toxicity.Matcher({" trash ": 3.0}, ("trash can",)).features("the trash can " * 50_000) == (0.0, 0.0)
    assert time.time() - began < 60


def test_secret_spans():
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    text = f'é token = "{key}" AKIA{"X" * 14} AKIA{"X" * 13} pwd: please passphrase: x9$Kq!2mZr7, API_KEY:short'
    got = secrets.scan(text, secrets.dictionary(), 10.0)
    assert [(k, text[a:b]) for k, a, b, _ in got] == [("assign", f'token = "{key}'), ("hex", key), ("access", "AKIA" + "X" * 14), ("guess", "x9$Kq!2mZr7")]
    assert secrets.scan(None, {}, 10.0) == secrets.scan("", {}, 10.0) == []
    screen = pa.compute.match_substring_regex(pa.array([text]), secrets.SCREEN).to_pylist()
    assert screen == [True]


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>H</header><nav><ul><li><a href="/x">m</a></ul></nav>
    <!-- c --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>Bold.<br>next<p>Two   words&nbsp;here.</p><aside>side</aside><form>f</form><section id="comments"><p>Nice</p></section><ul><li>one<li>two</ul></article><footer>F</footer>"""
    assert html_text.content(page) == "Title & more\nBold. next\nTwo words here.\none\ntwo"
    assert html_text.content(None) == html_text.content("") == html_text.content("<html></html>") == html_text.content("<nav>x</nav>") == ""
    assert html_text.content("just text") == "just text" and html_text.content("a < b <p>c") == "a < b\nc"
    plain = '<body><div class="menu"><a>a</a></div><div><p>A long text, with a sentence. And more, of it; yes.</p><p>Another one here, which is long. It has marks, you see.</p></div><div class="comments"><p>Nice!</p></div><div>x</div></body>'
    assert html_text.content(plain) == "A long text, with a sentence. And more, of it; yes.\nAnother one here, which is long. It has marks, you see."


def test_html_scores_decide_on_every_page():
    said = "Long text of the page, with a sentence or two. It goes on; and on, as such texts do. More follows here, at length. "
    para = lambda name, n: [f"{said * (1 + k % 3)}{name}{k}" for k in range(n)]
    tags = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    cards = "".join(f'<article><h2><a href="/{k}">Teaser number {k}</a></h2><p>A short word on it.</p></article>' for k in range(6))
    assert html_text.content(f"<body><div><h1>Own title</h1>{tags(para('P', 5))}</div><div>{cards}</div></body>").split("\n") == ["Own title", *para("P", 5)]
    page = f"<body><div><div>{tags(para('A', 5))}</div><section>{tags(para('B', 3))}</section><div>x</div></div></body>"
    assert html_text.content(page).split("\n") == para("A", 5) + para("B", 3)


def test_html_raw_elements_names_and_depth():
    text = lambda k: f"Part {k} of the text, as it goes on. And more of it, here."
    for raw in ('<svg viewBox="0 0"/>', "<math/>", '<iframe src="x"/>', "<iframe src=x>", "<noscript>", "<svg><path d='x'/>text</svg>", "<script>var x='<p>';</script>"):
        assert html_text.content(f"<article><p>{text(1)}</p>{raw}<p>{text(2)}</p></article>") == f"{text(1)}\n{text(2)}"
    assert html_text.content(f"<article><p>{text(1)}</p><script>var x = 1;<p>{text(2)}</p></article>") == text(1)
    assert html_text.content(f'<article><p>{text(1)}</p><p class="menu-review">{text(2)}</p></article>') == f"{text(1)}\n{text(2)}"
    assert html_text.content(f'<article>{"".join(f"<p>{text(k)}</p>" for k in range(6))}<div class="comment-list"><p>{text(9)}</p></div></article>') == "\n".join(text(k) for k in range(6))
    began = time.time()
    for page in ("<div>" * 100_000 + "a, b.", "<div>a, b. " * 50_000, "<b>" * 50_000 + "<i>" * 50_000 + "</b>" * 50_000 + "x", "<b>" * 50_000 + "<p>x. " * 50_000, "<svg>" * 100_000 + "x", "<p>Some text, of the page. And more.</p>" * 100_000):
        assert html_text.content(page)
    assert time.time() - began < 60


def test_warc_round_trip_and_damage():
    payloads = [b"", b"x" * 200_000, "é\r\n\r\n".encode() * 3]
    raw = b"".join(warc.record(str(k), None if k else "http://a/\n", p) for k, p in enumerate(payloads)) + warc.record("9", "u", b"", warc.digest(payloads[1]), "1", len(payloads[1]))
    got = list(warc.read(io.BytesIO(raw)))
    assert [p for _, p in got[:3]] == payloads and got[3][0]["WARC-Type"] == "revisit" and got[3][0]["X-Payload-Length"] == "200000"
    assert list(warc.members(io.BytesIO(raw), 7)) == list(warc.members(io.BytesIO(raw)))
    for bad in (raw[:-5], raw[:40] + b"\x00\x01" + raw[42:]):
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(bad)))


def test_toxicity_folding_and_exceptions():
    assert toxicity.fold("SCuм 1d10t st@b x$$$").split() == ["scum", "idiot", "stab", "x"]
    m = toxicity.Matcher({" trash ": 3.0, " idio": 2.0}, ("trash can",))
    assert m.features("the trash can") == (0.0, 0.0) and m.features(None) == (0.0, 0.0)
    assert m.features("you 1D1OTIC trash") == (5 / 3**0.5, 5 / 3)
    assert m.features("xidiot entrash") == (0.0, 0.0)


def naive_toxicity(weights, exceptions, text):
    """Every entry at every place: the largest weight of each place, but inside exception phrases."""
    folded, best = toxicity.fold(text or ""), {}
    excused = [(at, at + len(toxicity.fold(p)) - 1) for p in exceptions for at in range(len(folded)) if folded.startswith(toxicity.fold(p), at)]
    for term, w in weights.items():
        at = folded.find(term)
        while at >= 0:
            if not any(a <= at < b for a, b in excused):
                best[at] = max(w, best.get(at, 0.0))
            at = folded.find(term, at + 1)
    n = max(1, len(folded.split()))
    return sum(best.values()) / n**0.5, sum(best.values()) / n


def test_toxicity_matching_equals_a_naive_search():
    rng = random.Random(8)
    parts = ["trash", "can", "the", "idiot", "1d10t", "scum", "pond", "idio", "clown", "fish", "x"]
    weights = {" trash ": 3.0, " idio": 2.0, " idiot ": 2.5, " scum ": 1.5, " clow": 1.0, " clown ": 0.5}
    match = toxicity.Matcher(weights, toxicity.EXCEPTIONS)
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "", "!"]) for _ in range(rng.randint(0, 20)))
        assert np.allclose(match.features(text), naive_toxicity(weights, toxicity.EXCEPTIONS, text))


def test_tree_scores_equal_a_naive_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    model = gbt.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), [0, 0, 1, -1])

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])


def test_workers_keep_the_tables_of_one_operator():
    made = []
    make = lambda: made.append(1) or object()
    first = flat.kept("one", make)
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert [b.num_rows for b in flat.tidy([batch], "one")] == [1] and flat.kept("one", make) is first and len(made) == 1
    assert [b.num_rows for b in flat.tidy([batch, batch])] == [1, 1] and "one" not in flat._kept
    assert flat.kept("one", make) is not first and len(made) == 2
    assert list(flat.tidy([], "two")) == [] and not flat._kept


def test_tables_that_grew_for_a_long_text_go():
    long = np.full(flat.CHUNK_BYTES + 9, 97, np.uint8)
    whole = flat.span_hash(flat.prefix_hash(long), np.array([5]), np.array([9]))
    assert len(flat._powers[0]) > flat.CHUNK_BYTES + 1
    list(flat.tidy([pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])]))
    assert len(flat._powers[0]) == 0
    assert flat.span_hash(flat.prefix_hash(long[:20]), np.array([5]), np.array([9])) == whole
