"""Schemas of the four tables and the artifact record that every source yields."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


S, L = StringType(), LongType()
EVENT = _struct(ts_type=S, ts_utc=S, is_primary=BooleanType())
EVIDENCE = _struct(source_id=S, case_id=S, host=S, os=S, tool=S, tool_version=S, tool_cmdline=S, source_path=S, sha256=S, size_bytes=L, acquired_utc=S, imported_utc=S, status=S, error=S)
#: case_id, host and tool are kept beside the artifact, so that reading it needs no join with evidence.
ARTIFACT = _struct(artifact_id=S, source_id=S, case_id=S, host=S, source=S, artifact_type=S, description=S, timestamp_utc=S, primary_ts_type=S, is_noise=BooleanType(), dedup_key=S, raw_data=S, events=ArrayType(EVENT))
DETECTION = _struct(artifact_id=S, case_id=S, engine=S, rule_id=S, rule_title=S, severity=S, score=IntegerType(), attack=ArrayType(S), matched_on=S)

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Score of a rule that names none.
DEFAULT_SCORE = {"info": 5, "low": 10, "medium": 25, "high": 40, "critical": 70}
CANONICAL = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
