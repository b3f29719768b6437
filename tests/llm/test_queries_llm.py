"""Queries with SQL against DuckDB, and the pipeline against what each stage promises."""

import duckdb
import pytest

import corpus_pipeline
from runweave.llm import language
from runweave.llm.decontaminate import contamination
from runweave.llm.exact import exact_duplicates
from runweave.llm.jaccard import near_duplicates
from runweave.llm.queries import ORACLES, QUERIES
from runweave.storage import cut_lineage

SF = "/root/testdata/sf0.01"
TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    rows = [sorted(x.astype(object).where(x.notna(), None).itertuples(index=False, name=None), key=repr) for x in (got, want)]
    assert rows[0] == rows[1]


def test_thirteen_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


def test_stages_keep_what_they_should(spark, odd_docs):
    docs = odd_docs.unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True
    ).select(*odd_docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, SF), "after")
        ids = sorted(r.doc_id or -1 for r in after.select("doc_id").collect())
        if name == "language_id":
            want = [r.doc_id or -1 for r in docs.collect() if language.words_of(r.text or "")]
        elif name == "exact_dedup":
            want = [r.doc_id or -1 for r in exact_duplicates(docs).where("kept").collect()]
        elif name == "near_dedup":
            groups = near_duplicates(docs, corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_WORDS).collect()
            want = list({r.root: r.component_id or -1 for r in groups}.values())
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            want = [r.doc_id or -1 for r in contamination(docs, items).where("not contaminated").collect()]
        else:
            want = [r.doc_id or -1 for r in docs.collect()]
            assert after.where("not round_trip").count() == 0
        assert ids == sorted(want), name
        if name != "sentencepiece":
            assert after.columns == docs.columns
        docs = after


def test_pipeline_of_nothing(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), "nothing")
    assert docs.count() == 0
