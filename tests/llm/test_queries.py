"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import corpus_pipeline  # noqa: E402
from custos.llm.oracle import ORACLE_SQL  # noqa: E402
from custos.llm.queries import QUERIES  # noqa: E402
from oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    import __spark_entry__ as E
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    rows, want = [tuple(r) for r in df.collect()], cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force where there is one."""
    from tests.llm.test_native import shingle_set as containment_set
    from tests.llm.test_near import brute as near_brute
    from tests.llm.test_repeats import brute as repeat_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [containment_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(bad & set(after)) <= 2 and len(good - set(after)) <= 2
        elif name == "near_duplicates":
            want = near_brute([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        elif name == "substring_dedup":
            for i, (_, gone, kept) in zip(before, repeat_brute([r.text for r in before.values()], 35), strict=True):
                assert after[i].text == (kept if gone else before[i].text) and after[i].n_chars == len(after[i].text)
        elif name == "decontamination":
            found = {i for i, r in before.items() for x in [containment_set(r.text)] if any(100 * len(y & x) >= 80 * len(y) for y in items)}
            assert set(after) == set(before) - found
        else:
            assert out.columns == [*docs.columns, "n_tokens", "copies", "leaf_budget"] and all(1 <= r.copies <= 4 for r in rows)
        if name != "mixing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    got = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: r.copies for i, r in after.items()}


def test_pipeline_takes_hard_rows(spark, documents, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for table in (documents, nothing):
            out = stage(spark, table, SF)
            assert set(table.columns) <= set(out.columns) and out.count() <= table.count(), name
