"""Detections that need several rows: interval, anti and self joins, counts, field against field.

All take the artifacts of one or more cases and return detections. Processes are joined
within case and host. "First" always means the first in time, then by artifact_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import all_of, any_of, basename, binary_leaf, canonical
from tracelake.operators.store import first_writer
from tracelake.plans.rules import field_value

# --- fixed values -------------------------------------------------------------------------------------

EXECUTIONS = ["prefetch_execution", "amcache_file", "bam_execution", "user_assist_execution"]
SINGLETONS = {"lsass.exe": 1, "services.exe": 1, "wininit.exe": 1, "smss.exe": 2, "winlogon.exe": 2, "csrss.exe": 2}
EXPECTED_PARENT = {"lsass.exe": ["wininit.exe"], "services.exe": ["wininit.exe"], "svchost.exe": ["services.exe"], "wininit.exe": ["smss.exe"], "winlogon.exe": ["smss.exe"], "spoolsv.exe": ["services.exe"], "taskhostw.exe": ["svchost.exe"]}
ROOT_PIDS = ["0", "4", "1", ""]
#: Programs that rewrite creation times as part of their work.
TIME_KEEPERS = [
    "\\msiexec.exe", "\\tiworker.exe", "\\trustedinstaller.exe", "\\setup.exe", "\\vc_redist", "\\dism.exe", "\\wusa.exe", "\\7z", "\\winrar.exe",
    "\\rar.exe", "\\peazip", "\\bandizip", "\\explorer.exe", "\\robocopy.exe", "\\xcopy.exe", "\\onedrive.exe", "\\dropbox.exe", "\\googledrivefs.exe",
    "\\backup", "\\veeam", "\\git.exe", "\\code.exe", "\\devenv.exe", "\\msbuild.exe", "\\node.exe", "\\python", "\\pip", "\\npm", "\\chrome.exe",
    "\\msedge.exe", "\\firefox.exe", "\\svchost.exe", "\\searchindexer.exe", "\\wmiprvse.exe", "\\searchprotocolhost.exe", "\\csrss.exe",
]
#: Programs that have no reason to.
SCRIPT_HOSTS = ["\\powershell.exe", "\\pwsh.exe", "\\cmd.exe", "\\wscript.exe", "\\cscript.exe", "\\mshta.exe", "\\rundll32.exe", "\\regsvr32.exe", "\\certutil.exe", "\\bitsadmin.exe"]
#: Places where nothing should.
PROTECTED_PATHS = ["\\windows\\system32\\", "\\windows\\syswow64\\", "\\windows\\tasks\\", "\\appdata\\local\\temp\\", "\\windows\\temp\\", "\\programdata\\", "\\users\\public\\", "\\$recycle.bin\\", "\\perflogs\\"]
BURST = 25


#: Process ids that C005 names of each group.
FIRST_PIDS = 20
#: Time frames a slot of interval_first().
SLOT = 16


def _detections(df: DataFrame, rule_id: str, title: str, severity: str, score: int, attack: list[str], matched: Column) -> DataFrame:
    techniques = F.array(*[F.lit(t) for t in attack]) if attack else F.array().cast("array<string>")
    return df.select("artifact_id", "case_id", F.lit("correlation").alias("engine"), F.lit(rule_id).alias("rule_id"), F.lit(title).alias("rule_title"), F.lit(severity).alias("severity"), F.lit(score).alias("score"), techniques.alias("attack"), matched.alias("matched_on"))


def _parsed(artifacts: DataFrame) -> DataFrame:
    """Adds v__, the parsed raw_data that _raw() and _key() read.

    A row is parsed once however many fields are read and compared: as a plain column the optimizer would put the
    parsing into each comparison, but it doesn't see through explode().
    """
    return artifacts.select("*", F.explode(F.array(F.try_parse_json("raw_data"))).alias("v__"))


def _raw(name: str) -> Column:
    return field_value(f"raw_data.{name}", F.col("v__"))


def _key(*parts: str) -> Column:
    """A raw_data value by exact keys (which may hold dots, blanks or parentheses)."""
    return F.try_variant_get("v__", "$" + "".join(f"['{p}']" for p in parts), "string")


def _reached(ts: Column, minutes: int) -> Column:
    """The slot in which a row looks for earlier ones: that of the time ``minutes`` before it. A slot is SLOT frames long.

    It isn't null, so that a join on it doesn't ask for that by computing it once more.
    """
    return F.coalesce(F.floor((F.unix_seconds(ts) - minutes * 60) / (SLOT * minutes * 60)), F.lit(0))


def _reaching(ts: Column, minutes: int) -> Column:
    """The slots whose rows may find a row: its own, and the one before if a frame crosses from there."""
    return F.array_distinct(F.array(_reached(ts, minutes), _reached(ts + F.make_dt_interval(mins=F.lit(minutes)), minutes)))


def interval_first(left: DataFrame, right: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """The keys, a left row (l) and the first right row (r) of equal keys at most ``minutes`` before it; one row a left id.

    Both sides have ts (timestamp) and id. Rows aren't paired: backwards in time over both sides, the last right row
    seen at a left row's time less ``minutes`` is the first of its frame, if the frame has any. So what is sorted
    and shuffled grows with the rows, however many of a key fall into a frame; time is cut into slots, so that a
    key with very many rows is many tasks'.
    """
    known = all_of([F.col(k).isNotNull() for k in [*keys, "ts"]])
    side = lambda df: F.struct(*[c for c in df.columns if c not in keys])
    at, frame = F.unix_micros("ts"), minutes * 60_000_000
    l_rows = left.where(known).select(*keys, _reached(F.col("ts"), minutes).alias("slot__"), (at - frame).alias("at__"), side(left).alias("l"))
    r_rows = right.where(known).select(*keys, F.explode(_reaching(F.col("ts"), minutes)).alias("slot__"), at.alias("at__"), side(right).alias("r"))
    back = Window.partitionBy(*keys, "slot__").orderBy(F.desc("at__"), F.col("l").isNotNull(), F.desc("r.id")).rowsBetween(Window.unboundedPreceding, 0)
    swept = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("r", F.last("r", ignorenulls=True).over(back))
    met = swept.where(F.col("l").isNotNull() & (F.col("r.ts") <= F.col("l.ts")))
    return first_writer(met.select(*keys, "l", "r", F.col("l.id").alias("l_id")), ["l_id"], "r.ts", "r.id").drop("l_id")


def download_then_execute(artifacts: DataFrame, minutes: int = 60) -> DataFrame:
    """C001: an execution on the same host whose description names a file downloaded at most ``minutes`` before.

    Names are looked for in descriptions once for all equal ones of a host and slot; what the join compares doesn't leave it.
    Of times in canonical form no text is carried.
    """
    timed = artifacts.withColumn("ts", F.to_timestamp("timestamp_utc"))
    odd = F.when(F.col("timestamp_utc") != canonical(F.col("ts")), F.col("timestamp_utc")).alias("odd")
    row = ["case_id", "host", "ts", F.col("artifact_id").alias("id"), odd]
    target = F.lower(basename(F.coalesce(_key("path"), F.lit(""))))
    name = F.regexp_replace(F.regexp_replace(target, r"\.crdownload$", ""), r"\.part$", "")
    # a name that came out of explode() is filtered without being parsed again
    downloads = _parsed(timed.where(F.col("artifact_type") == "browser_download").where("ts is not null")).select(*row, F.explode(F.filter(F.array(name), lambda n: F.length(n) > 4)).alias("name"))
    runs = timed.where(F.col("artifact_type").isin(EXECUTIONS)).where("ts is not null").select(*row, F.coalesce(F.lower("description"), F.lit("")).alias("description"), _reached(F.col("ts"), minutes).alias("slot"))
    place = ["case_id", "host", "slot"]
    names = downloads.select("case_id", "host", F.explode(_reaching(F.col("ts"), minutes)).alias("slot"), "name").distinct()
    named = runs.select(*place, "description").distinct().join(names, place).where(F.col("description").contains(F.col("name")))
    met = interval_first(runs.join(named, [*place, "description"]).drop("slot", "description"), downloads, ["case_id", "host", "name"], minutes)
    gap = F.floor((F.unix_micros("l.ts") - F.unix_micros("r.ts")) / 60_000_000).cast("string")
    said = F.concat(F.lit("downloaded "), F.col("name"), F.lit(" at "), F.coalesce("r.odd", canonical(F.col("r.ts"))), F.lit(", executed at "), F.coalesce("l.odd", canonical(F.col("l.ts"))), F.lit(" (+"), gap, F.lit(" min)"))
    return _detections(met.select(F.col("l.id").alias("artifact_id"), "case_id", said.alias("said")), "C001", f"Downloaded file executed within {minutes} minutes", "critical", 70, ["T1204.002"], F.col("said"))


def _processes(artifacts: DataFrame, kind: str = "memory_process") -> DataFrame:
    mine = _parsed(artifacts.where(F.col("artifact_type") == kind))
    return mine.select("artifact_id", "case_id", "host", F.coalesce(_raw("PID"), F.lit("")).alias("pid"), F.coalesce(_raw("PPID"), F.lit("")).alias("ppid"), F.lower(F.trim(F.coalesce(_raw("ImageFileName"), _raw("COMM"), F.lit("")))).alias("name"))


def unlinked_process(artifacts: DataFrame) -> DataFrame:
    """C002: a process that the memory scan finds but the process list lacks."""
    found = _processes(artifacts, "memory_process_scan").where("pid <> ''")
    hidden = found.join(_processes(artifacts).select("case_id", "host", "pid"), ["case_id", "host", "pid"], "left_anti")
    return _detections(hidden, "C002", "Process hidden from the process list", "critical", 70, ["T1055", "T1014"], F.concat(F.col("name"), F.lit(" pid="), F.col("pid"), F.lit(" is in the scan but not in the list")))


def rewritten_creation_time(artifacts: DataFrame) -> DataFrame:
    """C003: a creation time moved back by a script host, or in a protected place, and not by a program whose work that is."""
    logs = _parsed(artifacts.where(F.col("artifact_type") == "event_log")).where(F.lower(F.coalesce(_raw("Channel"), F.lit(""))).contains("sysmon") & (_raw("EventId") == "2"))
    get = lambda k: F.coalesce(_key("_enrich", "payload", k), F.lit(""))
    # inline() for the same reason as in _parsed(): dozens of comparisons read the image
    rows = logs.select("artifact_id", "case_id", F.inline(F.array(F.struct(get("CreationUtcTime").alias("new"), get("PreviousCreationUtcTime").alias("old"), get("Image").alias("image"), get("TargetFilename").alias("target")))))
    return moved_back(rows.where((F.col("new") != "") & (F.col("old") != "")))


def moved_back(rows: DataFrame) -> DataFrame:
    """C003 over rows of artifact_id, case_id, image, target and a new and an old time of any type that has an order; a null time is never moved back."""
    image, target = F.lower("image"), F.lower("target")
    script = any_of([image.contains(x) for x in SCRIPT_HOSTS])
    rows = rows.where((F.col("new") < F.col("old")) & ~any_of([image.contains(x) for x in TIME_KEEPERS]) & (script | any_of([target.contains(x) for x in PROTECTED_PATHS])))
    why = F.when(script, "script interpreter").otherwise("protected path")
    said = F.concat(F.col("target"), F.lit(": creation time moved back from "), F.col("old").cast("string"), F.lit(" to "), F.col("new").cast("string"), F.lit(" by "), F.col("image"), F.lit(" ["), why, F.lit("]"))
    return _detections(rows, "C003", "File creation time rewritten by an unexpected process", "high", 60, ["T1070.006"], said)


def child_of_flagged(artifacts: DataFrame, detections: DataFrame) -> DataFrame:
    """C004: a process started by one that a critical or high rule flagged."""
    starts = _parsed(artifacts.where(F.col("artifact_type") == "event_log")).where(_raw("EventId") == "1")
    get = lambda k: _key("_enrich", "payload", k)
    starts = starts.select("artifact_id", "case_id", F.coalesce(_raw("Channel"), F.lit("")).alias("channel"), get("ProcessGuid").alias("guid"), get("ParentProcessGuid").alias("parent"), F.coalesce(get("Image"), F.lit("None")).alias("image"), F.coalesce(get("CommandLine"), F.lit("None")).alias("command"))
    bad = detections.where(F.col("severity").isin("critical", "high") & (F.col("engine") != "correlation")).select("artifact_id", "rule_id")
    flagged = starts.join(bad, "artifact_id").where("guid <> ''").groupBy("case_id", F.col("guid").alias("parent")).agg(F.min_by("rule_id", F.struct("artifact_id", "rule_id")).alias("by"))
    met = starts.where(F.lower("channel").contains("sysmon")).join(flagged, ["case_id", "parent"])
    return _detections(met, "C004", "Process spawned by an already-flagged parent", "high", 55, ["T1059.001"], F.concat(F.lit("spawned by a process flagged by "), F.col("by"), F.lit(": "), F.col("image"), F.lit(" "), F.substring("command", 1, 120)))


def duplicate_singletons(artifacts: DataFrame) -> DataFrame:
    """C005: more instances of a core process than a system starts; every instance is reported."""
    limit = F.create_map(*[F.lit(x) for kv in SINGLETONS.items() for x in kv])
    rows = _processes(artifacts).where(F.col("name").isin(*SINGLETONS))
    key = ["case_id", "host", "name"]
    over = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit[F.col("name")])
    # every instance is told the first pids only: a text of all would grow with the square of their number
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("pid"))).where(F.col("nth") <= FIRST_PIDS)
    named = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("pid")), ", ").alias("pids"))
    met = rows.join(over.join(named, key), key)
    more = F.when(F.col("n") > FIRST_PIDS, F.concat(F.lit(" and "), (F.col("n") - FIRST_PIDS).cast("string"), F.lit(" more"))).otherwise("")
    said = F.concat(F.col("n").cast("string"), F.lit(" instances of "), F.col("name"), F.lit(" (pids "), F.col("pids"), more, F.lit(")"))
    return _detections(met, "C005", "More instances of a core process than expected", "critical", 80, ["T1036.005", "T1055"], said)


def unexpected_parents(artifacts: DataFrame) -> DataFrame:
    """C006: a core process whose parent is known and isn't one that starts it."""
    rows = _processes(artifacts)
    named = first_writer(rows.where("pid <> ''").select("case_id", "host", F.col("pid").alias("ppid"), F.col("name").alias("parent"), "artifact_id"), ["case_id", "host", "ppid"], F.desc("artifact_id")).drop("artifact_id")
    expected = F.create_map(*[x for k, v in EXPECTED_PARENT.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    met = rows.where(F.col("name").isin(*EXPECTED_PARENT)).join(named, ["case_id", "host", "ppid"]).where((F.col("parent") != "") & ~F.array_contains(expected[F.col("name")], F.col("parent")))
    return _detections(met, "C006", "Core process with an unexpected parent", "critical", 80, ["T1036.005", "T1134"], F.concat(F.col("name"), F.lit(" pid="), F.col("pid"), F.lit(" started by "), F.col("parent"), F.lit(" pid="), F.col("ppid")))


def orphans(artifacts: DataFrame) -> DataFrame:
    """C007: a process whose parent isn't in the process list."""
    rows = _processes(artifacts)
    met = rows.where(~F.col("ppid").isin(ROOT_PIDS)).join(rows.select("case_id", "host", F.col("pid").alias("ppid")), ["case_id", "host", "ppid"], "left_anti")
    return _detections(met, "C007", "Process without a living parent", "low", 15, [], F.concat(F.col("name"), F.lit(" pid="), F.col("pid"), F.lit(": parent "), F.col("ppid"), F.lit(" isn't running")))


def service_binary_mismatch(artifacts: DataFrame) -> DataFrame:
    """C008: a service that runs another program than its configuration names."""
    rows = _parsed(artifacts.where(F.col("artifact_type") == "memory_service")).select("artifact_id", "case_id", F.coalesce(_key("Name"), F.lit("None")).alias("name"), _key("Binary").alias("running"), _key("Binary (Registry)").alias("configured"))
    a, b = F.lower(F.trim("running")), F.lower(F.trim("configured"))
    rows = rows.where((a != "") & (b != "") & ~a.startswith("\\driver\\") & ~a.startswith("\\filesystem\\") & ~(a.contains("svchost.exe") & b.contains("svchost.exe")) & (binary_leaf(a) != binary_leaf(b)))
    return _detections(rows, "C008", "Service binary differs from its registry configuration", "critical", 80, ["T1543.003", "T1036.005"], F.concat(F.col("name"), F.lit(": running "), F.col("running"), F.lit(" but registry says "), F.col("configured")))


def execution_bursts(artifacts: DataFrame, least: int = BURST) -> DataFrame:
    """Hours in which a host ran at least ``least`` programs; reported, not stored."""
    runs = artifacts.where(F.col("artifact_type").isin(EXECUTIONS) & F.col("timestamp_utc").isNotNull())
    return runs.groupBy("case_id", "host", F.substring("timestamp_utc", 1, 13).alias("hour")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "host", "hour")


def run_all(artifacts: DataFrame, detections: DataFrame, minutes: int = 60) -> DataFrame:
    """C001 to C008; what was detected by correlation before is to be replaced by this."""
    others = detections.where(F.col("engine") != "correlation")
    out = download_then_execute(artifacts, minutes)
    for part in (unlinked_process(artifacts), rewritten_creation_time(artifacts), child_of_flagged(artifacts, others), duplicate_singletons(artifacts), unexpected_parents(artifacts), orphans(artifacts), service_binary_mismatch(artifacts)):
        out = out.unionByName(part)
    return out


def processes_window(artifacts: DataFrame) -> DataFrame:
    """Processes with how many of their name run on the host."""
    return _processes(artifacts).withColumn("same_name", F.count(F.lit(1)).over(Window.partitionBy("case_id", "host", "name")))
