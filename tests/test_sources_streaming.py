from pathlib import Path

import pytest

from sievewright import storage
from sievewright.operators.clean import clean_inspections
from sievewright.plans.inspections import inspections
from sievewright.sources import tables
from sievewright.streaming.clean import cleaned_stream, write_cleaned

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', "1"), ("two\nlines", None, "2"), ("NA", "n/a", "3")], "`License #` string, t string, n string")
    tables.write_csv(df, str(tmp_path / "out"), one_file=True)
    got = tables.read_csv(spark, str(tmp_path / "out"))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a,b", 'say "x"', "1"), ("two\nlines", None, "2"), (None, None, "3")], key=repr)
    typed = tables.read_csv(spark, str(tmp_path / "out"), "`License #` string, t string, n int")
    assert [r["n"] for r in typed.orderBy("n").collect()] == [1, 2, 3]


def test_shared_tables_go_when_discarded(spark):
    table = storage.write_table(spark.range(3), "t")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 3 and folder.exists()
    storage.discard_tables(spark)
    assert not folder.exists()
    storage.discard_tables(spark)


def test_missing_input(spark, tmp_path):
    for read in (tables.read_csv, tables.read_parquet):
        with pytest.raises(tables.InputMissing):
            read(spark, str(tmp_path / "nowhere"))


def test_report_with_byte_order_mark(spark, tmp_path):
    path = tables.write_csv_with_bom(spark.createDataFrame([("é", 1)], "name string, n int"), str(tmp_path / "a" / "r.csv"))
    assert path.read_bytes() == "﻿name,n\né,1\n".encode()


def test_stream_equals_batch(spark, tmp_path):
    df = inspections(spark, SF)
    df.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    write_cleaned(cleaned_stream(spark, str(tmp_path / "in"), stored.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = sorted(map(tuple, clean_inspections(stored).collect()), key=repr)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == want
