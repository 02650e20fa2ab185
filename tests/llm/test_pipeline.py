"""The pipeline's stages, each against a brute-force version on its own input; and the queries' SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_rows import targets_by_hand
from test_sets import components_by_hand, lines_by_hand

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    columns = stages[0][1].columns
    assert all(df.columns == columns and df.count() > 0 for _, df in stages[:-1])
    assert stages[-1][1].columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_classifier_stage_equals_the_query(spark, stages):
    kept = {r["doc_id"] for r in queries()["op7_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert {d for d, _ in texts(stages[1][1])} == kept
    assert set(texts(stages[1][1])) <= set(texts(stages[0][1]))


def test_line_stage_equals_brute_force(stages):
    before = texts(stages[1][1])
    expected = {d: (t if n else text) for (d, text), (t, n_lines, n) in lines_by_hand(before, 2).items() if not n or n < n_lines}
    assert dict(texts(stages[2][1])) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][1].collect() if dict(before)[r["doc_id"]] != r["text"])


def test_near_dedup_stage_equals_brute_force(stages):
    found = components_by_hand(texts(stages[2][1]))
    assert {d for d, _ in texts(stages[3][1])} == {d for d, (_, least) in found.items() if d == least}


def test_decontamination_stage_equals_search(spark, stages):
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in texts(stages[3][1]) if not any(i in " ".join(t.lower().split()) for i in items)}
    assert {d for d, _ in texts(stages[4][1])} == clean


def test_mixing_stage_takes_all_documents(stages):
    sizes, size_of = {}, {}
    for r in stages[4][1].collect():
        size_of[r["doc_id"]] = len(r["text"].encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + size_of[r["doc_id"]]
    targets = sorted(targets_by_hand(sizes).values())
    found = stages[-1][1].collect()
    assert {r["doc_id"]: r["size"] for r in found} == size_of
    assert sorted({r["target"] for r in found}) == pytest.approx(sorted(set(targets)))
    assert sum(r["taken"] for r in found) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n.startswith("op")])
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = sorted((tuple(r) for r in result.fetchall()), key=repr)
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == expected


def test_stages_on_odd_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = [{"doc_id": None, "text": None}, {"doc_id": 10**9, "text": ""}, {"doc_id": None, "text": "a few words"}]
    rows = [r.asDict() for r in docs.collect()]
    rows += [{**rows[0], **o} for o in odd] + [rows[1], rows[1]]
    names = ["score", "row", "doc", "spans", "h", "c0"]
    table = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).select(
        "*", *[F.lit(n).alias(n) for n in names]
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, table, SF)
        assert found.columns == table.columns, name
        kept = found.collect()
        assert all([r[n] for n in names] == names for r in kept), name
        assert stage(spark, table.limit(0), SF).count() == 0, name
        if name == "near_dedup":
            assert [r["doc_id"] for r in kept].count(rows[1]["doc_id"]) <= 1
            assert len([r for r in kept if not (r["text"] or "").split()]) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, table.limit(0), SF).count() == 0
