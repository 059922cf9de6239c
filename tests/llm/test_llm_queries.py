"""Registered queries against their SQL, and the pipeline against brute force."""

import pathlib

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
import tallymart.llm.queries as llm  # noqa: E402
from tools.check import rows_of  # noqa: E402

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample data is not here")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = llm.QUERIES[name](spark, str(FOLDER))
    result = con.sql(llm.ORACLES[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(result.columns, result.fetchall())


def test_pipeline(spark):
    from test_llm_operators import expected_removal, linked_components, shingles

    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    ids = lambda frame: {row["doc_id"] for row in frame.select("doc_id").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "jaccard_join", "substring_dedup", "packing"]
    ruled = corpus_pipeline.rules(spark, docs, str(FOLDER))
    assert ruled.columns == docs.columns
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    single = corpus_pipeline.near_copies(spark, docs, str(FOLDER))
    want = linked_components({doc: shingles(text) for doc, text in texts.items()})
    assert single.columns == docs.columns and ids(single) == {doc for doc, top in want.items() if doc == top}
    cut = {row["doc_id"]: " ".join(row["text"].split()) for row in corpus_pipeline.passages(spark, docs, str(FOLDER)).collect()}
    assert cut == {doc: " ".join(" ".join(kept).split()) for doc, kept, _ in expected_removal(sorted(texts.items()), 50)}


def test_pipeline_runs_whole(spark):
    pieces = corpus_pipeline.run(spark, str(FOLDER))
    total = spark.read.parquet(str(FOLDER / "documents.parquet")).count()
    kept = pieces.select("doc_id").distinct().count()
    assert 0.6 * total < kept < total
    assert pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "min"}).filter("`sum(length)` <> `min(doc_tokens)`").isEmpty()


def test_near_copies_by_row(spark):
    text = " ".join(f"word{at}" for at in range(40))
    rows = [(1, text), (1, text), (None, text + " tail"), (2, "other words " * 9), (2, text), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((row["doc_id"] or -1, row["text"]) for row in corpus_pipeline.near_copies(spark, docs, str(FOLDER)).collect())
    # One row stays of the group of the long text (id 1), the other text of id 2 stays;
    # texts without words link with nothing, so both null rows of id 3 stay.
    assert kept == sorted([(1, text), (2, "other words " * 9), (3, None), (3, None)], key=lambda r: (r[0], r[1] or ""))
