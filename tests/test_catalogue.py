import duckdb
import pytest

import __spark_entry__
from sievewright.plans import catalogue

SF = "/root/testdata/sf0.001"
KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KIND[k] for c, k in df.dtypes} == kinds
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got and got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["merged_inspections", "restaurant_dim", "fd_repair_chain", "fd_repair_summary", "repair_and_impute", "entity_kpis", "high_risk_rank", "top_violation_terms", "inspections_fact"])
def test_no_table_holds_columns_that_are_not_used(spark, monkeypatch, name):
    from sievewright import storage

    made = {}
    for module in (catalogue, catalogue.entity, catalogue.repair, catalogue.star, catalogue.kpi, catalogue.modes):
        if hasattr(module, "write_table"):
            monkeypatch.setattr(module, "write_table", lambda df, label, **kw: made.setdefault(label, df.columns) and storage.write_table(df, label, **kw))
    catalogue.QUERIES[name](spark, SF)
    assert "cleaned" not in made
    wide = {label for label, columns in made.items() if "violations" in columns}
    assert wide == {"inspections_fact": {"merged"}, "repair_and_impute": {"normalised"}}.get(name, set())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
