"""Each query that SQL expresses against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(df):
    out = df.copy()
    for c in out.columns:
        out[c] = out[c].astype(str) if out[c].dtype in (object, bool) or str(out[c].dtype) in ("str", "string") else out[c].astype(float).round(6)
    return out[sorted(out.columns)].sort_values(sorted(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = rows(Q.queries()[name](spark, SF).toPandas()), rows(con.execute(Q.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_rows_only_queries_are_few():
    assert set(Q.queries()) - set(Q.oracle_sql()) == {"rf_fit", "gbt_fit", "feature_importance", "audio_features", "features36", "cross_validation", "model_artefact", "rerank_model"}


def test_rows_only_queries(spark):
    q = Q.queries()
    heard = q["features36"](spark, SF).collect()
    assert len(heard[0]) == 37 and any(r.f0_mean > 0 for r in heard) and any(r.f0_mean == 0 and r.word_count > 0 for r in heard) and all(r.word_count > 0 for r in heard)
    assert q["audio_features"](spark, SF).where("f0_mean > 100").count() > 0
    ranks = q["rerank_model"](spark, SF).collect()
    best = {}
    for r in sorted(ranks, key=lambda r: (r.lang, r.source or "", r["rank"])):
        assert best.setdefault((r.lang, r.source), r.predicted_score) >= r.predicted_score and r["rank"] <= 3
        best[r.lang, r.source] = r.predicted_score
    assert q["cross_validation"](spark, SF).first().mse > 0 and q["model_artefact"](spark, SF).count() > 0


def test_clips_are_dealt_to_all_cores(spark):
    from quillmark import flows

    clips = flows._clips(spark, SF)
    tasks = clips.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
