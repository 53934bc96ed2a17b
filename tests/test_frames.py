"""Searches within time frames: against plain Python, and on frames so full that their pairs would outnumber everything else."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import assert_same
from tracelake import catalog
from tracelake.operators import correlate

ARTIFACT = "artifact_id string, case_id string, host string, artifact_type string, description string, timestamp_utc string, raw_data string"


def most_rows(df) -> int:
    """The most rows that any operator of an executed plan made."""
    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        made = p.metrics().get("numOutputRows")
        below = p.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(below.apply(i)) for i in range(below.length()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def full_hour(tmp_path_factory):
    """3,000 events of one host within a little over an hour, on whole seconds, so many at the same time."""
    d, r = tmp_path_factory.mktemp("full"), random.Random(1)
    rows = [(i, pd.Timestamp("2024-01-05 10:00:00") + pd.Timedelta(seconds=r.randrange(4000)), 7 * r.randrange(9), r.choice(["purchase", "click"]), 0.0, f'{{"k": {r.randrange(100)}}}') for i in range(3000)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(d / "events.parquet")
    return str(d)


def test_runs_of_a_full_hour_arent_paired_with_its_downloads(spark, full_hour):
    got = catalog.QUERIES["download_execute_c001"](spark, full_hour)
    assert_same(got, catalog.ORACLE["download_execute_c001"], full_hour)
    assert most_rows(got) <= 2 * 3000


def test_the_first_click_of_a_full_hour_is_found_without_pairs(spark, full_hour):
    got = catalog.QUERIES["interval_join_first"](spark, full_hour)
    assert_same(got, catalog.ORACLE["interval_join_first"], full_hour)
    assert most_rows(got) <= 2 * 3000


def test_the_first_of_a_frame_by_one_sweep(spark):
    r = random.Random(2)
    made = lambda n, side: [(r.choice(["a", "b", None]), r.choice([None, *range(-400, 400)] if i % 9 == 0 else range(-400, 400)), f"{side}{r.randrange(n)}") for i in range(n)]
    left, right = made(300, "l"), made(120, "r")
    frame = lambda rows: spark.createDataFrame(rows, "host string, s long, id string").select("host", F.timestamp_seconds(F.col("s") * 15).alias("ts"), "id")
    for minutes in (1, 10):
        want = {}
        for host, at, i in left:
            met = [(s, x) for h, s, x in right if None not in (host, at, s) and h == host and 0 <= at - s <= minutes * 4]
            if met:
                want[i] = min(want.get(i, min(met)), min(met))
        got = correlate.interval_first(frame(left), frame(right), ["host"], minutes).select("l.id", F.unix_seconds("r.ts") / 15, "r.id").collect()
        assert {a: (s, x) for a, s, x in got} == want and len(got) == len(want) > 20


def test_the_first_of_all_names_that_a_description_holds(spark):
    day = "2024-03-14T"
    downloads = [("d1", "08:10:00.000000Z", "C:\\d\\Setup.exe"), ("d2", "08:05:00.000000Z", "/tmp/my-setup.exe.part"), ("d3", "07:00:00.000001Z", "C:\\d\\setup.exe"), ("d4", "08:00:00.000000Z", "a.js"), ("d5", "08:00:00.000000Z", None), ("d6", "06:59:59.000000Z", "my-setup.exe")]
    rows = [(i, "c", "h", "browser_download", None, day + t, "{}" if p is None else '{"path": "%s"}' % p.replace("\\", "\\\\")) for i, t, p in downloads]
    rows.append(("d7", "c", "h", "browser_download", None, "2024-03-14 12:00:00", '{"path": "odd.exe"}'))
    runs = [("r1", day + "08:20:00.000000Z", "C:\\MY-SETUP.EXE ran"), ("r2", day + "08:00:00.000001Z", "my-SETUP.exe"), ("r3", day + "08:07:00.000000Z", "setup.exe and my-setup.exe"), ("r4", day + "08:20:00.000000Z", None), ("r5", day + "08:20:00.000000Z", "a.js"), ("r6", "2024-03-14 12:30:00", "odd.exe"), ("r7", None, "odd.exe")]
    rows += [(i, "c", "h", "bam_execution", said, t, "{}") for i, t, said in runs] + [("r8", "c", "other", "bam_execution", "setup.exe", day + "08:20:00.000000Z", "{}")]
    got = {h["artifact_id"]: h["matched_on"] for h in correlate.download_then_execute(spark.createDataFrame(rows, ARTIFACT)).collect()}
    assert got == {
        "r1": f"downloaded my-setup.exe at {day}08:05:00.000000Z, executed at {day}08:20:00.000000Z (+15 min)",
        "r2": f"downloaded setup.exe at {day}07:00:00.000001Z, executed at {day}08:00:00.000001Z (+60 min)",
        "r3": f"downloaded my-setup.exe at {day}08:05:00.000000Z, executed at {day}08:07:00.000000Z (+2 min)",
        "r6": "downloaded odd.exe at 2024-03-14 12:00:00, executed at 2024-03-14 12:30:00 (+30 min)",
    }
