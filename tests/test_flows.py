"""Ingesting, detections, messages, decisions, graphs and loops on small cases with known results."""

import datetime as dt
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusgraph.functions import config, models, projects
from corpusgraph.operators import chunking, clusters, detect, ingest, outbox, retrieval, taxonomy
from corpusgraph.sources import files, pdf
from corpusgraph.streaming import loops


def naive_recursive(text, size, overlap, separators):
    """The splitter's rules read slowly: cut at the first separator that occurs, pack what is short, cut what is long further."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    bits, now, k = [], "", 0
    while k < len(text):  # a separator begins a new piece
        if sep and text.startswith(sep, k):
            bits.append(now)
            now, k = sep, k + len(sep)
        else:
            now, k = now + text[k], k + 1
            if not sep:
                bits.append(now)
                now = ""
    bits.append(now)
    bits = [b for b in bits if b]

    def pack(some):
        done, now = [], []
        for b in some:
            if now and sum(map(len, now)) + len(b) > size:
                done.append("".join(now).strip())
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(b) > size):
                    now.pop(0)
            now.append(b)
        done.append("".join(now).strip())
        return [d for d in done if d]

    out, good = [], []
    for b in bits:
        if len(b) < size:
            good.append(b)
        else:
            out += pack(good) if good else []
            good = []
            out += naive_recursive(b, size, overlap, finer) if finer else [b]
    return out + (pack(good) if good else [])


def test_recursive_split_equals_a_naive_one():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", ". ", "\n", "\n\n", "word ", "x" * 30]) for _ in range(rng.randint(0, 120)))
        assert chunking.split_recursive(text, 40, 10) == naive_recursive(text, 40, 10, list(chunking.SEPARATORS))


def test_similarity_split_golden_and_rules():
    vec = {"Alpha one.": [1, 0], "Alpha two.": [1, 0], "Beta three.": [0, 1]}
    embed = lambda some: [vec[s] for s in some]
    assert chunking.split_by_similarity("Alpha one. Alpha two. Beta three.", 0.5, 1, 1000, embed) == ["Alpha one. Alpha two.", "Beta three."]

    def fails(_):
        raise OSError

    long = "One sentence here. " * 40
    assert chunking.split_by_similarity(long, embed=fails) == chunking.split_recursive(long)
    assert chunking.split_by_similarity(" ") == [] and chunking.split_by_similarity("short.") == ["short."] and chunking.split_by_similarity("x" * 200) == ["x" * 200]
    chunks = chunking.split_by_similarity(long, least=100, most=200)
    assert "".join(chunks).replace(" ", "") == long.replace(" ", "") and max(map(len, chunks)) <= 400


def test_structured_chunks_and_headings():
    note = "before\n# A\ntext of a\n## B\ntext of b\n# C\nlast"
    heads = ingest.Headings(note)
    assert [heads.at(k) and heads.at(k)["path"] for k in (0, note.index("text of a"), note.index("text of b"), len(note) - 1)] == [None, "# A", "# A > ## B", "# C"]
    rows = ingest.structured(note, lambda t: chunking.split_recursive(t, 16, 0))
    assert [note[r["start"] :].startswith(r["text"][:50]) for r in rows] == [True] * len(rows) and rows[-1]["section_title"] == "C"
    assert ingest.structured("  ", chunking.split_recursive) == []
    assert ingest.places("ab ab ab", ["ab", "ab", "zz"]) == [0, 3, 5]


def test_semantic_split_rules():
    text = "First sentence of it. Second one here.\n\nNew paragraph starts. And goes on. " + "Another long sentence to fill. " * 5
    cuts = ingest.semantic_boundaries(text, lambda held, s: True)
    assert cuts[0] == text.index("New paragraph")
    no = ingest.semantic_boundaries(text, lambda held, s: False)
    assert len(no) == len(ingest.sentences(text)) - 1
    assert ingest.semantic_boundaries(text, lambda a, b: True, lambda t: '{"boundaries": [5, 9.0, "x"]}') == [5, 9]
    assert ingest.semantic_boundaries(text, lambda a, b: True, lambda t: "no JSON") == cuts
    assert ingest.semantic_boundaries("a " * 700, lambda a, b: True, most=100) == []
    cache, asked = {}, []
    same = lambda a, b: asked.append(b) or True
    assert ingest.split_semantic(text, same, cache=cache, key="k") == ingest.split_semantic(text, None, cache=cache, key="k") and asked
    assert ingest.split_semantic("x" * 50) == ["x" * 50] and ingest.split_semantic(" ") == []

    def fails(a, b):
        raise OSError

    assert ingest.split_semantic(text, fails) == chunking.split_recursive(text)
    with pytest.raises(ValueError):
        ingest.chunk(None, "a", "b", "other")


def test_hybrid_sections():
    short, long = "## A\nshort text\n", "## B\n" + "A sentence that is rather long to fill it. " * 40
    rows = ingest.hybrid(short + long)
    assert rows[0]["text"] == short and rows[0]["heading_path"] == "## A" and len(rows) > 2 and {r["section_title"] for r in rows[1:]} == {"B"} and [r["chunk"] for r in rows] == list(range(len(rows)))
    assert ingest.hybrid("") == [] and ingest.hybrid("no heading")[0]["text"] == "no heading"


def test_detection_goldens(spark):
    stats = spark.createDataFrame([("1", 3, 0, 3), ("2", 1, 2, 3)], "cluster_id string, recent int, previous int, total int")
    ids = spark.createDataFrame([("1",), ("2",)], "cluster_id string")
    assert [r["cluster_ids"] for r in detect.emerging(stats, ids, 2, 0).collect()] == [["1"]]
    assert [(r["cluster_ids"], r["confidence"]) for r in detect.emerging(stats, ids).collect()] == [(["1"], 1.0)]
    links = spark.createDataFrame([("a", "b")], "cluster_id string, neighbor string")
    ab = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    assert [r["cluster_ids"] for r in detect.orphans(ab, links, ab).collect()] == [["b"]]
    reps = spark.createDataFrame([("1", [1.0, 0.0], 1.0), ("2", [0.9, 0.1], -1.0), ("3", [0.0, 1.0], -1.0), ("4", [1.0, 0.0], 0.0)], "cluster_id string, embedding array<double>, polarity double")
    found = detect.contradictions(reps, 0.8, 0.5).collect()
    assert [r["cluster_ids"] for r in found] == [["1", "2"]] and json.loads(found[0]["signals"])["polarity_right"] == -1.0
    one = spark.createDataFrame([("c", [0.9, 0.1])], "cluster_id string, embedding array<double>")
    hit = detect.radar(one, "k", [[1, 0]], [[0, 1]], 0.2).collect()
    assert len(hit) == 1 and hit[0]["discovery_id"].startswith("k:") and detect.radar(one, "k", [[0, 1]], [[1, 0]], 0.2).count() == 0
    assert detect.radar(one, "k", [], [], 0.0).first()["confidence"] == 0.0


def test_greedy_distinct_equals_a_naive_one(spark):
    rng = random.Random(4)
    rows = [("p" + str(k % 2), [str(x) for x in rng.sample(range(12), rng.randint(0, 8))], rng.randint(0, 5) / 10, k) for k in range(120)]
    got = {r["k"] for r in detect.greedy_distinct(spark.createDataFrame(rows, "p string, s array<string>, c double, k int"), "p", "s", [("c", False), ("k", True)]).collect()}
    want, kept = set(), {}
    for p, s, _, k in sorted(rows, key=lambda r: (-r[2], r[3])):
        s = set(s)
        if not any((len(s & o) / len(s | o) if s | o else 1.0) >= 0.8 for o in kept.setdefault(p, [])):
            kept[p].append(s)
            want.add(k)
    assert got == want


def test_dry_run_stores_nothing(spark):
    found = spark.createDataFrame([("k", "orphan", ["1"], 1.0, "{}"), ("k", "orphan", ["1"], 1.0, "{}")], "concept_key string, pattern_type string, cluster_ids array<string>, confidence double, signals string")
    before = found.limit(0).withColumn("run_id", F.lit("r"))
    for dry, counts in ((False, (1, 1)), (True, (0, 1))):
        after, n = detect.store(found, before, "r", dry)
        assert tuple(n.first()) == counts and after.count() == counts[0]
    s = detect.run_summary(found, "r", 2, 1.0, target=60.0).first()
    assert s["errors"] == [] and s["detections_by_type"] == {"orphan": 2}


def test_taxonomy_goldens(spark):
    rows = [("a", "b", 0.9, 0.5), ("b", "c", 0.8, 0.5), ("c", "a", 0.7, 0.5), ("c", "d", 0.1, 0.1)]
    got = {(r["source"], r["target"]): r["kind"] for r in taxonomy.break_cycles(spark.createDataFrame(rows, "source string, target string, score double, overlap double")).collect()}
    assert got == {("a", "b"): "PARENT_OF", ("b", "c"): "PARENT_OF", ("c", "a"): "NEIGHBOR", ("c", "d"): "PARENT_OF"}
    near = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.75), ("b", "c", 0.1)], "a string, b string, similarity double")
    none = spark.createDataFrame([], "source string, target string, kind string")
    picked = {(r["source"], r["target"]) for r in taxonomy.neighbors(near, none, most=2).collect()}
    assert picked == {("a", "b"), ("a", "c"), ("a", "d")}  # d picks a, though a has picked two others
    family = spark.createDataFrame([("a", "b", "PARENT_OF"), ("c", "b", "NEIGHBOR")], "source string, target string, kind string")
    assert {(r["source"], r["target"]) for r in taxonomy.neighbors(near, family).collect()} == {("a", "c"), ("a", "d"), ("b", "c")}
    terms = spark.createDataFrame([("child", t) for t in "abcd"] + [("parent", t) for t in "abc"] + [("x", t) for t in "abc"] + [("y", "d"), ("z", "q")], "cluster_id string, term string")
    over = {(r["a"], r["b"]): r["overlap"] for r in taxonomy.overlaps(terms, 0.4).collect()}
    assert over == {("child", "parent"): 0.75, ("child", "x"): 0.75, ("parent", "x"): 1.0}
    sim = spark.createDataFrame([("child", "parent", 0.9), ("child", "x", 0.8)], "a string, b string, similarity double")
    edges = taxonomy.parents(taxonomy.overlaps(terms, 0.4), sim, taxonomy.generality(terms), gap=0.0, most=1).where("target = 'child'").collect()
    assert [(r["source"], r["overlap"]) for r in edges] == [("parent", 0.75)]


def test_cycles_are_broken_on_random_graphs(spark):
    rng = random.Random(9)
    rows = list({(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(40)})
    rows = [(s, t, rng.randint(0, 9) / 10, 0.5) for s, t in rows if s != t]
    left = [(r["source"], r["target"]) for r in taxonomy.break_cycles(spark.createDataFrame(rows, "source int, target int, score double, overlap double")).where("kind = 'PARENT_OF'").collect()]
    while left:  # only a graph without cycles can be peeled to nothing
        heads = {s for s, _ in left} - {t for _, t in left}
        assert heads
        left = [e for e in left if e[0] not in heads]


def test_ranking_goldens(spark):
    rows = [("q", 0, 0.1, False), ("q", 1, 0.2, False), ("q", 2, 0.3, True), ("q", 3, 0.4, True), ("q", 4, 0.5, True), ("n", 0, 0.1, False)]
    got = {r["q"]: r for r in retrieval.measures(spark.createDataFrame(rows, "q string, k int, d double, rel boolean"), "q", "k", "d", "rel", 3).collect()}
    assert (got["q"]["recall"], got["q"]["rr"]) == (round(1 / 3, 6), round(1 / 3, 6)) and (got["n"]["recall"], got["n"]["ndcg"], got["n"]["rr"]) == (0.0, 0.0, 0.0)
    assert got["q"]["ndcg"] == round(0.5 / (1 + 1 / np.log2(3) + 0.5), 6)
    assert retrieval.keyword_properties("title, text") == ["title", "text", "contextHeader"] and retrieval.keyword_properties(None) == ["text", "contextHeader"]


def test_mentions(spark):
    cases = {'{"cluster_id": 3}': True, '{"cluster_id": "3"}': True, '{"cluster_ids": [1, 3]}': True, '{"clusters": [{"cluster_id": 3}]}': True, '{"cluster_id": 4, "x": 3}': False, '{"cluster_ids": "3"}': False, "{": False, '{"cluster_id": 3': False, "[3]": False}
    rows = spark.createDataFrame([(c,) for c in cases], "j string").select("j", retrieval.mentions(F.col("j"), ["3"]).alias("m")).collect()
    assert {r["j"]: r["m"] for r in rows} == cases


def test_deadlines_and_messages(spark):
    now = F.lit("2026-01-10").cast("timestamp_ntz")
    texts = ["flexible", "2 weeks", "3days", "1 month please", "2026-03-15", "15.3.2026", "March 15, 2027", "15 Mar", "soon", "2026-03-15T10:00:00Z", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", outbox.deadline(F.col("t"), now).alias("d")).collect()
    got = {r["t"]: (r["d"]["readable"], r["d"]["at"] and r["d"]["at"].strftime("%Y-%m-%d")) for r in rows}
    assert got == {"flexible": (True, None), "2 weeks": (True, "2026-01-24"), "3days": (True, "2026-01-13"), "1 month please": (True, "2026-02-09"), "2026-03-15": (True, "2026-03-15"), "15.3.2026": (True, "2026-03-15"), "March 15, 2027": (True, "2027-03-15"), "15 Mar": (True, "2026-03-15"), "soon": (False, None), "2026-03-15T10:00:00Z": (True, "2026-03-15"), "": (False, None)}
    assert all(not re.search(r"[{}]", spark.range(1).select(outbox.message_text(k, {c: F.lit("x") for c in ("title", "importance", "urgency", "hours", "question")})).first()[0]) for k in outbox.TEXTS)


def test_project_note_golden(spark):
    row = {c: F.lit(None).cast("string") for c in projects.FIELDS} | {
        "id": F.lit(42), "title": F.lit("Implement: Dark Mode"), "discovered_by": F.lit("latent_scout"), "discovery_id": F.lit("disco_001"), "cluster_ids": F.array(F.lit("12"), F.lit("a b")), "confidence_score": F.lit(0.85), "status": F.lit("active"), "importance": F.lit(5),
        "deadline": F.lit("2026-12-31 23:59:59").cast("timestamp_ntz"), "created_at": F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), "updated_at": F.lit("2026-01-02 00:00:00").cast("timestamp_ntz"), "verified_by_user": F.lit(True), "description": F.lit("Add it."),
    }
    note = spark.range(1).select(projects.note(row).alias("n")).first()["n"]
    assert note.startswith("---\nid: 42\ntitle: 'Implement: Dark Mode'\ndiscovered_by: latent_scout\ndiscovery_id: disco_001\ncluster_ids:\n- '12'\n- a b\nconfidence_score: 0.85\nstatus: active\nimportance: 5\ndeadline: '2026-12-31T23:59:59+00:00'\nverified_by_user: true\n")
    assert "\n---\n\n# Implement: Dark Mode\n\nAdd it.\n\n## Metadata\n\n- **Status**: active\n- **Importance**: 5/5\n- **Deadline**: 2026-12-31\n\n## Discovery Info\n\n" in note and "- **Confidence**: 85%\n- **Verified**: Yes\n" in note and note.endswith("- **Updated**: 2026-01-02 00:00:00 UTC\n")
    back = spark.createDataFrame([(note,), ("no front matter",), (None,)], "n string").select(projects.parse(F.col("n")).alias("m")).collect()
    assert back[0]["m"]["title"] == "Implement: Dark Mode" and back[0]["m"]["cluster_ids"] == "12\na b" and back[1]["m"] == {} and back[2]["m"] is None


def test_settings_and_plans(tmp_path):
    (tmp_path / "a").write_text("# c\nexport A=1\nB='x y'\nC=2 # note\n")
    (tmp_path / "b").write_text('B="z"\n')
    assert config.layered({"A": "0", "D": "4"}, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")) == {"A": "1", "B": "z", "C": "2", "D": "4"}
    plan = config.run_plan({"PHASE_A_RUNS": "x, y", "PHASE_A_DEFAULT_LLM_PROVIDER": "p", "PHASE_A_RUN_y_CHUNKING_STRATEGY": "hybrid"})
    assert [r["chunking_strategy"] for r in plan] == ["recursive", "hybrid"] and plan[0]["contextual_llm_provider"] == "p" and list(config.run_summary(plan[0], {"chunk_count": 3})) == config.SUMMARY and len(config.SUMMARY) == 22
    with pytest.raises(ValueError):
        config.run_plan({})
    config.snapshot({"PHASE_A_B": "2", "PHASE_A_A": "1", "X": "3"}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"PHASE_A_A": "1", "PHASE_A_B": "2"}
    full = config.reset_plan(config.ResetOptions(vault=True, email=True, vectors=True, collections=["Q"], relational=True, tables=["t"]))
    assert [a for a, *_ in full] == ["delete_file", "delete_table", "delete_table", "delete_file", "delete_rows", "delete_table", "delete_table", "truncate"] and full[4] == ("delete_rows", "TheLethe", "email")
    for bad in (config.ResetOptions(), config.ResetOptions(tables=["t"]), config.ResetOptions(collections=["c"]), config.ResetOptions(env="prod", vault=True)):
        with pytest.raises(ValueError):
            config.reset_plan(bad)
    assert config.reset_plan(config.ResetOptions(env="prod", vault=True, dry_run=True))
    assert config.providers("groq") == ("groq", "ollama") and config.providers("?", embedding="e") == ("ollama", "e")
    assert config.StrictJson("a-b, c").strict("A_B") and not config.StrictJson("a").strict("b") and config.StrictJson("ALL").strict("b") and config.StrictJson("", "yes").fallback


def test_model_functions(spark):
    rows = spark.createDataFrame([("one two",), (None,), ("",)], "t string")
    v = [r["v"] for r in rows.select(models.embedding(models.HashEmbedder)(F.col("t")).alias("v")).collect()]
    assert sum(v[0]) == 2.0 and v[0][zlib.crc32(b"one") % 64] >= 1 and v[1] is None and sum(v[2]) == 0.0
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))
    late = rows.where("t = 'one two'").select(models.late_embedding(models.HashEmbedder)(F.col("t"), spans).alias("v")).first()["v"]
    assert len(late) == 2 and abs(sum(late[0]) - 1) < 1e-9
    said = models.generation(models.RuleWriter)
    docs = spark.createDataFrame([("First thing. Second thing.", "chunk")], "d string, c string")
    text = lambda kind, gen: docs.select(models.embed_text(kind, F.col("c"), F.col("d"), gen).alias("x")).first()["x"]
    assert text("doc_summary", said) == "First thing.\n\nchunk" and text("none", said) == text("late", said) == text("contextual", None) == "chunk"

    class Fails:
        structured = False

        def generate(self, prompts):
            raise OSError

    assert text("doc_summary", models.generation(Fails)) == "chunk"
    with pytest.raises(ValueError):
        text("other", said)
    cache = spark.createDataFrame([("a", "known")], "k string, answer string")
    got, after = models.cached(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), "k", cache, lambda new: new.withColumn("answer", F.lit("new")))
    assert sorted((r["k"], r["answer"]) for r in got.collect()) == [("a", "known"), ("b", "new"), ("b", "new")] and after.count() == 2


def make_pdf(pages, info=b"", compress=True):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< " + info + b" >>"]
    for k, content in enumerate(pages):
        data = zlib.compress(content) if compress else content
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if compress else b"") + data + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (k + 1) + o + b"\nendobj\n" for k, o in enumerate(objects)) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


def test_pdf_files(spark, tmp_path):
    two = make_pdf([rb"BT (Hello \(big\) w\303\266rld) Tj T* [(Sec) -20 (ond) -300 (line)] TJ ET", b"BT <50616765> Tj ET"], rb"/Title (My \051 title) /Author <FEFF00C4> /CreationDate (D:20240131120000+01'00')")
    (tmp_path / "a.pdf").write_bytes(two)
    (tmp_path / "b.pdf").write_bytes(make_pdf([b"", b"BT (later) Tj ET"], compress=False))
    (tmp_path / "c.pdf").write_bytes(b"no pdf \xe9")
    (tmp_path / "d.txt").write_bytes(two)
    got = {r["path"][-5:]: r for r in pdf.pdf_files(spark, str(tmp_path)).collect()}
    a = got["a.pdf"]
    assert a["text"].split("\n")[0].startswith("Hello (big) w") and "Second line" in a["text"] and a["text"].endswith("Page") and (a["title"], a["author"], a["pages"], a["kind"]) == ("My ) title", "Ä", 2, "text")
    assert a["created"].astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H") == "2024-01-31 11" and len(a["stable_id"]) == 64
    assert got["b.pdf"]["kind"] == "bytes" and got["c.pdf"]["text"] == "no pdf é" and len(got) == 3
    assert pdf.read(make_pdf([b""]), lambda data: " scanned ")["text"] == "scanned" and pdf.read(b"")["pages"] == 0


def test_notes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.md").write_text("# ä")
    (tmp_path / "bad.md").write_bytes(b"# \xe9\xff")
    assert [r["raw"] for r in files.notes(spark, str(tmp_path)).collect()] == ["# ä"]
    assert [r["path"][-6:] for r in files.unreadable_notes(spark, str(tmp_path)).collect()] == ["bad.md"]


def test_schema_and_guards(spark):
    table = spark.createDataFrame([(1,)], "a int")
    wide = ingest.ensure_schema(table, StructType([StructField("a", IntegerType()), StructField("b", StringType())]))
    assert wide.columns == ["a", "b"] and wide.first()["b"] is None
    for bad in (StructField("b-c", StringType()), StructField("a", StringType())):
        with pytest.raises(ValueError):
            ingest.ensure_schema(table, StructType([bad]))
    assert ingest.readable(["a.PDF", "b.txt", "c.pdf"], (".pdf",), lambda p: p != "c.pdf") == (["a.PDF"], [("b.txt", "wrong kind"), ("c.pdf", "not found")])
    known = spark.createDataFrame([("p", 1, 2)], "path string, modified long, size long")
    assert ingest.plan(known, known, "once")[0].count() == 0 and ingest.plan(known, known, "again")[0].count() == 1 and ingest.plan(known, known, "once", True)[0].count() == 1
    with pytest.raises(ValueError):
        ingest.plan(known, known, "other")
    with pytest.raises(ValueError):
        clusters.lloyd(known, "path", "size", 0, 1)


def test_jobs_and_progress():
    at, ran = [0.0], []

    def fails():
        raise OSError("no")

    jobs = loops.Jobs({"a": (10, lambda: ran.append("a")), "b": (20, fails)}, lambda: at[0])
    assert jobs.turn() == ["a", "b"] and jobs.errors == {"b": "no"}
    at[0] = 10.0
    assert jobs.turn() == ["a"] and ran == ["a", "a"]
    p = loops.Progress(100, lambda: at[0])
    at[0] = 20.0
    assert p.add(25) == {"done": 25, "percent": 25, "rate": 2.5, "seconds_left": 30.0} and loops.Progress(0, lambda: at[0]).report()["percent"] == 100


def test_watch_and_outbox_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.md", ".hidden.md", "b.md~", "c.txt"):
        (tmp_path / "in" / name).write_text("x")
    seen, errors = [], []

    def handle(kind, rows):
        names = [r["path"][-4:] for r in rows.collect()]
        seen.extend(names)
        if names:
            raise OSError("after")

    started = loops.watch_all(spark, {"vault": str(tmp_path / "in"), "pdf": ""}, handle, lambda kind, e: errors.append((kind, str(e))), str(tmp_path / "state"))
    assert len(started) == 1
    started[0].processAllAvailable()
    assert started[0].isActive and seen == ["a.md"] and errors == [("vault", "after")]
    started[0].stop()
    log = [("m1", 0, "error", False), ("m1", 1, "delivered", True), ("m1", 2, "response", True), ("m2", 0, "error", False), ("m2", 1, "error", False), ("m2", 2, "error", False), ("m3", 0, "response", False)]
    events = spark.createDataFrame(log, "m string, k int, e string, w boolean")
    events.write.parquet(str(tmp_path / "events"))
    want = {"m1": ("delivered", 1), "m2": ("failed", 3), "m3": ("pending", 0)}
    assert {r["m"]: (r["status"], r["attempts"]) for r in loops.fold_outbox(events, "m", ["k"], "e", "w").collect()} == want
    stream = loops.outbox_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "m", "k", "e", "w")
    assert {r["m"]: (r["status"], r["attempts"]) for r in loops.run_stream(stream, "outbox").collect()} == want
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, n int")
    new, known = loops.ingest_batches(rows, rows.limit(0).select("id"), "id", ["n"])
    again, after = loops.ingest_batches(rows.withColumn("id", F.concat("id", F.when(F.col("id") == "b", "2").otherwise(""))), known, "id", ["n"])
    assert sorted(map(tuple, new.collect())) == [("a", 1), ("b", 1)] and [r["id"] for r in again.collect()] == ["b2"] and after.count() == 3


def test_state_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"path": "a", "size": 3}, {"path": "b"}]')
    (tmp_path / "bad.json").write_text("{not JSON")
    read = lambda name: [tuple(r) for r in files.kept_state(spark, str(tmp_path / name), "path string, size long").collect()]
    assert read("good.json") == [("a", 3), ("b", None)] and read("bad.json") == [] and read("none.json") == []


def test_heading_quality_goldens(spark):
    chunks = spark.createDataFrame([("d", "# A > ## B", 2), ("d", "# A", 2), ("e", "", 0)], "k string, heading_path string, heading_level int")
    expected = spark.createDataFrame([("d", "A"), ("d", "B"), ("d", "C")], "k string, heading string")
    got = {r["k"]: (r["preserved"], r["depth"]) for r in ingest.preservation(chunks, expected, "k").collect()}
    assert got == {"d": (round(2 / 3, 6), 0.5), "e": (1.0, 1.0)}
