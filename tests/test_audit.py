"""The audit observed while writing equals the one that counts apart, and the table holds the rows kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentika.operators.selection import filter_audit, write_filtered

def steps():
    return {"known": F.col("x").isNotNull(), "positive": F.col("x") > 0, "even": F.col("x") % 2 == 0}


def test_observed_audit(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in (None, None, -2, 0, 1, 2, 2, 4, 7)], "x int").repartition(4)
    got = write_filtered(rows, steps(), str(tmp_path / "a"))
    assert got.dtypes == filter_audit(rows, steps()).dtypes and got.collect() == filter_audit(rows, steps()).collect()
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [2, 2, 4]


def test_observed_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "x int").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    assert [tuple(r)[2:] for r in write_filtered(rows, steps(), str(tmp_path / "b")).collect()] == [(0, 0, 0)] * 3
    assert spark.read.parquet(str(tmp_path / "b")).count() == 0
