"""The stages of the pipeline on planted cases and on odd tables, and all registered queries with SQL."""

import os

import pytest

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.shared import stored
from tests.llm.fixtures import documents, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        now = docs.count()
        assert now <= before and (i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns)
        before = now
    assert docs.columns == ["doc_id", "n_tokens", "ids", "n_bytes"] and before > 0


def test_lines_copies_and_benchmark(spark):
    base = " ".join(words(5, 120))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    line = "one and the same line of some length"
    rows = [(1, base), (2, base + " more"), (3, f"{line}\nfirst"), (4, f"{line}\nsecond"), (5, f"{line}\nthird"), (6, " ".join(words(6, 30)) + " " + item), (7, None), (8, ""), (None, base)]
    docs = documents(spark, rows)
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.without_common_lines(spark, docs, SF).collect()}
    assert (cleaned[3], cleaned[4], cleaned[5]) == ("first", "second", f"{line}\nthird") and cleaned[7] is None
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None"])
    assert 6 not in {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, SF).collect()}
    empty = documents(spark, [])
    for stage in (corpus_pipeline.without_common_lines, corpus_pipeline.one_of_each_group, corpus_pipeline.without_benchmark, corpus_pipeline.as_tokens):
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(r[c] for c in columns) for r in rows.collect())
    done = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in done.fetchall())
