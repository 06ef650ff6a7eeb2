from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import orphans
from gneiss.sources import readers, writers
from gneiss.streaming import incremental


def test_gct_and_tsv(spark, tmp_path):
    (tmp_path / "a.gct").write_text("#1.2\n2\t2\nName\tDescription\tS1\tS2\ng1\td one\t1.5\t2\ng2\td two\tNA\t-3\n")
    assert rows(readers.gct(spark, str(tmp_path / "a.gct"))) == [("g1", "d one", "S1", 1.5), ("g1", "d one", "S2", 2.0), ("g2", "d two", "S2", -3.0)]
    (tmp_path / "b.tsv").write_text("id\tx\n1\t2\n")
    assert rows(readers.delimited(spark, str(tmp_path / "b.tsv"), sep="\t")) == [("1", "2")]


def test_soft(spark, tmp_path):
    (tmp_path / "1.txt").write_text("^SAMPLE = gsm1\n!Sample_title = A\n!Sample_characteristics_ch1 = tissue: x\n!Sample_characteristics_ch1 = age: 3\n!Sample_data_processing = gcRMA then RMA\n")
    (tmp_path / "2.txt").write_text("^SAMPLE = GSM1\n!Sample_title = again\n")
    (tmp_path / "3.txt").write_text("no sample here\n")
    records, failures = readers.soft(spark, str(tmp_path))
    r = records.collect()
    assert len(r) == 1 and r[0]["gsm_id"] == "GSM1" and r[0]["proc_family"] == "gcrma"
    assert r[0]["fields"]["characteristics_ch1"] == "tissue: x | age: 3" and r[0]["fields"]["title"] == "A"
    assert failures.count() == 1


def test_manifest_profile_and_columns(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert readers.manifest(spark, str(tmp_path)).collect()[0]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([(1.0, 2.0)], "`ENSG1.2` double, other double")
    assert readers.feature_columns(df) == ["ENSG1.2"]
    with pytest.raises(ImportError):
        readers.hdf5(spark, "none.h5", "d", "r", "c")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "k long, xs array<string>")
    writers.csv_report(df, str(tmp_path / "c"))
    assert rows(readers.delimited(spark, str(tmp_path / "c"))) == [("1", '["a"]'), ("2", None)]
    writers.clustered(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    for _ in range(2):
        writers.append_once(df, str(tmp_path / "q"), "b", 7)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    data = [(1, at(1), "a", 1.0), (2, at(9), "a", 2.0), (3, at(50), "b", 4.0)]
    spark.createDataFrame(data, "id long, ts timestamp, kind string, v double").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("id long, ts timestamp, kind string, v double").parquet(str(tmp_path / "in"))
    q = incremental.run(incremental.windowed(events, "ts", "kind", "v"), "win", "complete")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["kind"], r["n"], r["total"]) for r in spark.table("win").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_counts_are_maintained_from_a_stream(spark, tmp_path):
    schema = "key string, at timestamp, delta int, is_record boolean"
    t = dt.datetime(2024, 1, 1)
    for i, part in enumerate(([("x", t, 1, False), ("y", t, 1, False)], [("y", t, 1, True)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.maintain_counts(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    state = spark.read.parquet(str(tmp_path / "state" / str(last)))
    assert rows(orphans.orphan_report(state)) == [("x", 1)] and state.where(F.col("key") == "y").collect()[0]["existing"] == 1
