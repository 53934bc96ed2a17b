"""From loose records to artifacts: descriptions by template, primary times, noise, identity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake import model

#: Which time stands for an artifact on the timeline; otherwise the earliest does.
PRIMARY = {
    "prefetch_execution": "last_run", "amcache_file": "key_last_write", "event_log": "time_created", "user_assist_execution": "last_executed", "scheduled_task": "created", "browser_download": "download_start",
    "browser_visit": "visit", "shimcache": "last_modified", "service": "name_key_last_write", "bam_execution": "last_executed", "lnk_file": "target_modified", "jumplist": "target_modified", "shellbag": "last_write",
    "recycle_bin": "deleted", "srum_network": "timestamp", "activity": "start", "mft_file": "si_created", "usn_journal": "update", "registry_run": "last_write", "memory_process": "process_start",
    "memory_process_scan": "process_start", "memory_network": "connection_created", "file_entry": "modified", "auth_log": "logged", "shell_history": "executed", "cron_job": "file_modified", "systemd_unit": "file_modified",
    "ssh_authorized_key": "file_modified", "user_account": "file_modified", "process": "collected", "network_connection": "collected", "auditd": "logged", "package_event": "logged", "journal": "logged",
    "system_identity": "file_modified", "persistence_file": "file_modified", "trash_item": "deleted", "memory_shell_history": "executed", "memory_environment": "acquired", "memory_loaded_library": "acquired",
    "memory_open_file": "acquired", "memory_kernel_module": "acquired", "memory_hidden_module": "acquired", "memory_syscall_hook": "acquired", "memory_netfilter_hook": "acquired", "memory_tty_hook": "acquired",
    "memory_process_spoof": "acquired", "memory_ebpf_program": "acquired", "memory_ftrace_hook": "acquired", "memory_mount": "acquired",
}
LONGEST = 1000


def template(text: str, raw: str = "raw", missing: str = "") -> Column:
    """A description from a map column: ``{A|B?x}`` is the first filled of A and B, else x."""
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", text):
        if piece.startswith("{"):
            names, _, default = piece[1:-1].partition("?")
            parts.append(F.coalesce(*[F.nullif(F.col(raw)[n], F.lit("")) for n in names.split("|")], F.lit(default or missing)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def stamps(pairs: list[tuple[str, list[str]]], raw: str = "raw") -> Column:
    """array<struct<label,value>> of the first filled column of each label."""
    one = [F.struct(F.lit(label).alias("label"), F.coalesce(*[F.nullif(F.col(raw)[c], F.lit("")) for c in columns]).alias("value")) for label, columns in pairs]
    return F.array(*one) if one else F.array().cast("array<struct<label:string,value:string>>")


def build(records: DataFrame) -> DataFrame:
    """Artifacts from records.

    A record has case_id, source_id, host, source, artifact_type, description, stamps
    (array<struct<label,value>>), raw (map<string,string>) and enrich (JSON text or null).
    Times that can't be read are dropped; raw loses empty values.
    """
    read = F.array_sort(F.filter(F.transform("stamps", lambda s: F.struct(fn.normalize_timestamp(s["value"]).alias("ts_utc"), s["label"].alias("ts_type"))), lambda s: s["ts_utc"].isNotNull()))
    kept = fn.trimmed_map(F.map_filter("raw", lambda k, v: k != "SourceFile"))
    entries = F.map_from_entries(F.array_sort(F.map_entries(kept)))
    plain = F.to_json(entries)
    joined = F.when(F.col("enrich").isNull(), plain).otherwise(F.concat(F.when(plain == "{}", "{").otherwise(F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(","))), F.lit('"_enrich":'), F.col("enrich"), F.lit("}")))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in PRIMARY.items() for x in kv]), F.col("artifact_type"))
    out = records.withColumns({"read": read, "raw_data": joined, "description": F.substring(F.coalesce("description", F.lit("")), 1, LONGEST), "wanted": wanted})
    out = out.withColumn("primary", F.coalesce(F.get(F.filter("read", lambda s: s["ts_type"] == F.col("wanted")), 0), F.get("read", 0)))
    out = out.withColumns({"timestamp_utc": F.col("primary.ts_utc"), "primary_ts_type": F.col("primary.ts_type"), "is_noise": fn.is_noise(F.col("description"))})
    out = out.withColumn("dedup_key", fn.dedup_key(*[F.col(c) for c in ("case_id", "host", "artifact_type", "timestamp_utc", "description", "raw_data")]))
    events = F.transform("read", lambda s: F.struct(s["ts_type"].alias("ts_type"), s["ts_utc"].alias("ts_utc"), (s["ts_type"] == F.col("primary_ts_type")).alias("is_primary")))
    return out.withColumns({"events": events, "artifact_id": F.col("dedup_key")}).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.ARTIFACT])


def unread_stamps(records: DataFrame) -> DataFrame:
    """(label, n): times that were there but couldn't be read, by label."""
    one = records.select(F.explode("stamps").alias("s")).where(F.col("s.value").isNotNull() & ~F.lower(F.trim("s.value")).isin(fn.NO_TIME))
    return one.where(fn.normalize_timestamp(F.col("s.value")).isNull()).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
