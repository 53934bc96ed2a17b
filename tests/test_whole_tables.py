"""Queries whose whole table counts, on rows that the driver's small tables lack."""

import pytest

from tests.helpers import assert_same
from tracelake import catalog


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(k, 1, k, 1, d, t, f) for k, (d, t, f) in enumerate([(0.01, 0.02, "R"), (0.09, 0.1, "R"), (0.1, 0.09, "R"), (0.0001, 0.001, "R"), (0.02, 0.02, "R"), (None, 0.02, "R"), (0.0, 9.5, "R"), (9.5, 10.0, "R"), (-2.0, -1.0, "R"), (0.01, 0.02, "N")])]
    df = spark.createDataFrame([*rows, rows[0]], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_returnflag string")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    (tmp_path / "duck").mkdir()
    df.toPandas().to_parquet(tmp_path / "duck" / "lineitem.parquet")
    return tmp_path


def test_fields_are_compared_on_every_part(spark, lines):
    assert_same(catalog.QUERIES["field_vs_field"](spark, str(lines)), catalog.ORACLE["field_vs_field"], f"{lines}/duck")
    got = catalog.QUERIES["field_vs_field_all"](spark, str(lines))
    assert {r["artifact_id"]: r["n"] for r in got.collect()} == {f"{k}-1-{k}-1": 1 + (k == 0) for k in (0, 1, 3, 6, 7, 8)}
    assert_same(got, catalog.ORACLE["field_vs_field_all"], f"{lines}/duck")


def test_fields_are_compared_by_the_operator(spark, tiny, monkeypatch):
    monkeypatch.setattr(catalog.correlate, "moved_back", lambda rows: rows.where("false"))
    assert catalog.QUERIES["field_vs_field"](spark, tiny).count() == catalog.QUERIES["field_vs_field_all"](spark, tiny).count() == 0


def test_orders_of_any_key_length_reach_c003(spark, tmp_path):
    keys = [(9, 10), (10, 9), (999, 1000), (9999, 10000), (10000, 9999), (99999, 100000), (2**31, 2**40 + 2), (2**62, 2**63 - 2), (3, 6), (6, 3), (-20, -3), (-3, -20), (None, 9)]
    df = spark.createDataFrame(keys, "o_custkey long, o_orderkey long")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "duck").mkdir()
    df.toPandas().astype("Int64").to_parquet(tmp_path / "duck" / "orders.parquet")
    assert_same(catalog.QUERIES["timestomp_c003"](spark, str(tmp_path)), catalog.ORACLE["timestomp_c003"], f"{tmp_path}/duck")
    got = catalog.QUERIES["timestomp_c003_all"](spark, str(tmp_path))
    assert {"e10", "e1000", "e10000", "e100000", "e6", f"e{2**63 - 2}"} <= {r["artifact_id"] for r in got.collect()}
    assert_same(got, catalog.ORACLE["timestomp_c003_all"], f"{tmp_path}/duck")


def test_a_row_is_parsed_once_however_many_fields_are_compared(spark, lines):
    """Raw data written and parsed again for each of C003's comparisons took the time of the 6 GB run."""
    plan = catalog.QUERIES["field_vs_field_all"](spark, str(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 == plan.count("StructsToJsonEvaluator(")


def test_c003_of_raw_data_that_lacks_fields_or_is_none(spark):
    raw = '{"EventId": %s, "Channel": "Sysmon", "_enrich": {"payload": {"CreationUtcTime": "%s", "PreviousCreationUtcTime": "%s", "Image": "C:\\\\CMD.exe"%s}}}'
    rows = [("1", raw % ("2", "a", "b", ', "TargetFilename": "t"')), ("2", raw % ('"2"', "a", "b", "")), ("3", raw % ("3", "a", "b", "")), ("4", raw % ("2", "b", "a", "")), ("5", raw % ("2", "", "a", "")), ("6", '{"EventId": 2, "Channel": "sysmon"}'), ("7", "no json"), ("8", None)]
    df = spark.createDataFrame([(i, "c", "event_log", r) for i, r in rows], "artifact_id string, case_id string, artifact_type string, raw_data string")
    got = {(r["artifact_id"], r["matched_on"]) for r in catalog.correlate.rewritten_creation_time(df).collect()}
    assert got == {(i, f"{t}: creation time moved back from b to a by C:\\CMD.exe [script interpreter]") for i, t in (("1", "t"), ("2", ""))}
