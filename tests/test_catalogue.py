"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from candlewright import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation events documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert shown(rows) == shown([tuple(x[names.index(c)] for c in columns) for x in found.fetchall()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_controller(spark, tmp_path):
    from pyspark.sql import functions as F

    from candlewright.streaming.live import follow

    for k in range(2):
        spark.createDataFrame([(k, 1.0)], "step long, x double").write.parquet(str(tmp_path / "in" / f"p={k}"))
    records = spark.readStream.schema("step long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([(0.5,)], "buff double")
    query = follow(
        records, str(tmp_path / "state"), start,
        lambda batch, state: batch.join(F.broadcast(state), how="cross").withColumn("reward", F.col("x") + F.col("buff")),
        lambda scored, state: state.join(scored.agg(F.count("*").alias("n")), how="cross").select((F.col("buff") + F.col("n")).alias("buff")),
        str(tmp_path / "out"), str(tmp_path / "checkpoint"),
    )
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert sum(r.reward for r in out.collect()) >= 3.0
