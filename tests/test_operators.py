"""Operators on small cases with known results."""

import datetime as dt
import os

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.functions import vectors as V
from corpusgraph.operators import chunking, clusters, governance, ranking, state
from corpusgraph.sources import files
from corpusgraph.streaming import debounce


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_of_empty_and_zero_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    assert one(spark, V.cosine(arr(1, 0), arr(1, 0))) == 1.0
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert one(spark, V.cosine(arr(), arr())) == 0.0
    assert one(spark, V.cosine(F.lit(None).cast("array<double>"), arr(1))) == 0.0


def test_jaccard_of_empty_sets(spark):
    s = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, T.jaccard(s("a", "b"), s("a"))) == 0.5
    assert one(spark, T.jaccard(s(), s())) == 1.0
    assert one(spark, T.jaccard(s("a"), s("b"))) == 0.0


def test_gate_boundaries(spark):
    assert [one(spark, governance.gate(F.lit(x))) for x in (0.59, 0.6, 0.89, 0.9)] == ["reject", "ask", "ask", "approve"]


def test_pressure(spark):
    assert round(one(spark, governance.pressure(F.lit(20), F.lit(240.0), F.lit(5), F.lit(4))), 2) == 1.67
    assert one(spark, governance.pressure(F.lit(20), F.lit(-1.0), F.lit(5), F.lit(4))) == 999.0
    assert one(spark, governance.pressure(F.lit(None).cast("int"), F.lit(-1.0), F.lit(5), F.lit(4))) is None


def test_top_per_group_spreads_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", k, k % 3) for k in range(100)] + [("b", 1, None)], "g string, k int, v int")
    got = ranking.top_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 3, ["k"]).orderBy("g", "rank").collect()
    assert [(r["g"], r["k"], r["rank"]) for r in got] == [("a", 2, 1), ("a", 5, 2), ("a", 8, 3), ("b", 1, 1)]


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("b", 2, "p"), ("b", 3, "q"), ("c", 1, None)], "k string, t int, v string")
    assert sorted(map(tuple, state.upsert(old, new, ["k"], ["t"]).collect()), key=str) == [("a", 1, "x"), ("b", 3, "q"), ("c", 1, None)]
    assert sorted(map(tuple, state.insert_absent(old, new, ["k"], ["t"]).collect()), key=str) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)]


def test_changed_clusters(spark):
    t = dt.datetime
    snap = spark.createDataFrame([("new", 1, t(2024, 1, 1)), ("mod", 1, t(2024, 1, 3)), ("count", 9, None), ("old", 5, t(2024, 1, 1))], "cluster_id string, vector_count int, last_modified timestamp")
    sync = spark.createDataFrame([("mod", t(2024, 1, 2), 1), ("count", t(2024, 1, 2), 5), ("old", t(2024, 1, 2), 5)], "cluster_id string, last_sync timestamp, count_at_sync int")
    got = {r["cluster_id"]: r["changed"] for r in state.changed_clusters(snap, sync).collect()}
    assert got == {"new": True, "mod": True, "count": True, "old": False}


def test_recursive_split_keeps_limits_and_text():
    text = ". ".join(f"Sentence number {k} is here" for k in range(60))
    chunks = chunking.split_recursive(text, 120, 30)
    assert max(map(len, chunks)) <= 120 and all(c in text for c in chunks)
    assert chunking.split_recursive("") == [] and chunking.split_recursive("x" * 900, 400, 0) == ["x" * 400, "x" * 400, "x" * 100]


def test_spans():
    assert chunking.spans("Intro\nIntro\n", ["Intro\n", "Intro\n"], 0) == [(0, 6), (6, 12)]
    assert chunking.spans("abcdefghij", ["abcdef", "cdefgh"], 4) == [(0, 6), (2, 8)]
    assert chunking.spans("abc", ["x"], 0) is None


def test_pairwise_cosine_without_vectors(spark):
    empty = spark.createDataFrame([], "v array<double>")
    assert clusters.pairwise_cosine(empty, "v").first()["n"] is None


def test_markdown(spark):
    raw = "---\na: 1\n---\nSee [[x|y]] and [[z]] ![[img]]\nkey:: v\n<b>bold</b>  end\n\n\n\nlast "
    assert one(spark, T.markdown_clean(F.lit(raw))) == "See y and z \n\nbold end\n\nlast"


def test_mail_files(spark, tmp_path):
    m = b"From: a@b.c\nSubject: Hi\nContent-Type: text/plain\n\nHello\n"
    (tmp_path / "x.eml").write_bytes(b"Message-ID: <1@x>\n" + m)
    (tmp_path / "y.mbox").write_bytes(b"From z\n" + m + b"\nFrom z\n" + m)
    (tmp_path / "z.txt").write_bytes(m)
    got = files.mail(spark, str(tmp_path)).orderBy("source_path").collect()
    assert len(got) == 3 and got[0]["unique_id"] == "<1@x>" and got[1]["unique_id"].startswith("hash-") and got[1]["source_path"].endswith("y.mbox:0")


def test_notes_and_ground_truth(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("# T")
    (tmp_path / "blank.md").write_text("  ")
    assert [r["raw"] for r in files.notes(spark, str(tmp_path)).collect()] == ["# T"]
    (tmp_path / "g.json").write_text('{"queries": [{"id": "1", "query": "q", "relevant_docs": ["d"]}]}')
    assert [tuple(r) for r in files.ground_truth(spark, str(tmp_path / "g.json")).collect()] == [("1", "q", ["d"])]


def test_debounce_is_relative_to_the_last_processed(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", base + dt.timedelta(seconds=s), s) for s in (0, 40, 70, 100, 140)] + [("v", base, 0)], "k string, t timestamp, n int")
    got = sorted((r["k"], r["n"]) for r in debounce.debounce_batch(df, "k", "t", "n", 60.0).collect())
    assert got == [("u", 0), ("u", 70), ("u", 140), ("v", 0)]


def test_stream_first_seen_and_debounce(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", base + dt.timedelta(seconds=s), s) for s in (0, 40, 70)] + [("v", base, 0)]
    spark.createDataFrame(rows, "k string, t timestamp, n int").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, t timestamp, n int").parquet(str(tmp_path / "in"))
    for name, df in (("seen", debounce.first_seen(stream(), "k", "t")), ("bounce", debounce.debounce_stream(stream(), "k", "t", 60.0))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    assert sorted((r["k"], r["n"]) for r in spark.table("bounce").collect()) == [("u", 0), ("u", 70), ("v", 0)]
    assert os.path.isdir(tmp_path / "seen")


def test_outline_of_notes():
    from corpusgraph.operators.structure import outline

    assert outline("") == [] and outline("no heading") == []
    note = "# A\nx\n## B\ny\n# C\n"
    got = [(n["level"], n["title"], n["start"], n["end"], n["parent"], n["path"]) for n in outline(note)]
    assert got == [(1, "A", 0, 13, None, "# A"), (2, "B", 6, 13, 0, "# A > ## B"), (1, "C", 13, 17, None, "# C")]


def test_summary_sink(spark, tmp_path):
    import csv
    import glob

    from corpusgraph.sources.sinks import write_summary

    write_summary(spark.createDataFrame([(1, "a,b")], "n int, name string"), str(tmp_path / "s"), ["name", "missing", "n"])
    with open(glob.glob(str(tmp_path / "s/csv/*.csv"))[0], newline="") as f:
        assert list(csv.reader(f)) == [["name", "missing", "n"], ["a,b", "", "1"]]


def test_note_columns_take_nulls_and_empty_texts(spark):
    from pyspark.sql import functions as F

    from corpusgraph.functions import notes as N

    t = F.col("t")
    rows = spark.createDataFrame([(None,), ("",), ("# T\nabout\n## Own\nx",)], "t string").select(
        N.file_title(t).alias("file"), N.front_matter(t).alias("front"), N.custom_sections(t).alias("own"), N.description(t).alias("about"), N.callback(t).alias("call"), N.lenient_json(t, "k int").alias("json"), N.instant(t).alias("at"), N.csv_fields(t).alias("csv"),
    ).collect()
    assert [r["file"] for r in rows] == [None, "", "T-About-Own-x"] and [r["about"] for r in rows] == [None, "", "about"]
    assert [r["own"] for r in rows] == [None, [], ["## Own\nx"]] and not any(r["call"] or r["json"] or r["at"] for r in rows)
    assert rows[1]["csv"] == [] and rows[1]["front"] == {}
