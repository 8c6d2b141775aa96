"""Every registered query with SQL is compared with DuckDB on the small tables; the others are run."""

import glob
import os

import duckdb
import pytest

from corpusgraph import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(map(str, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def local(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", ["recursive_chunks", "assembled_chunks", "cosine_chunks", "semantic_chunks"])
def test_splitter_queries_give_every_chunk_of_every_text(spark, name):
    import re

    from corpusgraph.operators import chunking, ingest

    split = {
        "recursive_chunks": chunking.split_recursive, "assembled_chunks": lambda t: chunking.assemble(t, [m.end() for m in re.finditer(r"(?<=[.!?])\s+", t)]),
        "cosine_chunks": chunking.split_by_similarity, "semantic_chunks": ingest.split_semantic,
    }[name]
    got = sorted((r["doc_id"], r["chunk"], r["text"]) for r in catalog.queries()[name](spark, SF).collect())
    assert got == sorted((d["doc_id"], k, c) for d in local("documents") for k, c in enumerate(split(d["text"] or "")))


def test_places_of_chunks(spark):
    from corpusgraph.operators import chunking

    texts = {d["doc_id"]: d["text"] or "" for d in local("documents")}
    for r in catalog.queries()["chunk_spans"](spark, SF).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == chunking.split_recursive(texts[r["doc_id"]])[r["chunk"]]


def test_headings_of_structured_chunks(spark):
    notes = {}
    for r in sorted(local("conversations"), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"])):
        notes[r["conv_id"]] = notes.get(r["conv_id"], "") + f"## {r['role']}\n{r['text']}\n"
    for r in catalog.queries()["structured_chunks"](spark, SF).collect():
        note = notes[r["conv_id"]]
        assert note[r["start"] :].startswith(r["text"][:50])
        heads = [line for line in note[: r["start"] + 1].split("\n") if line.startswith("#")]
        assert r["heading_path"] == (heads[-1] if len(heads[-1]) > 3 else f"## {r['section_title']}")


def test_clusters_and_components_of_vectors(spark):
    import numpy as np

    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in local("embeddings")}
    x = np.array(list(rows.values()))
    got = {r["vec_id"]: r["cluster"] for r in catalog.queries()["kmeans_mllib"](spark, SF).collect()}
    assert set(got) == set(rows) and len(set(got.values())) == 10
    cents = {c: np.mean([rows[v] for v in got if got[v] == c], 0) for c in set(got.values())}
    assert np.mean([min(cents, key=lambda c: ((rows[v] - cents[c]) ** 2).sum()) == got[v] for v in got]) > 0.95
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    need = int((np.cumsum(share / share.sum()) <= 0.95).sum()) + 1
    assert catalog.queries()["embedding_pca_usage"](spark, SF).first()["needed"] == min(need, x.shape[1])
