"""Exported tables: CSV families by file name, and memory analysis results as JSON arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.sources import files as files_
from tracelake.sources import records


@dataclass(frozen=True)
class Spec:
    """How a family's rows become records; type, times, description template, and what is derived."""

    type: str
    stamps: list = field(default_factory=list)
    text: str = ""
    derived: str = ""


# --- fixed values: file names of the CSV families and the columns their records show ---------------------

CSV_SPECS: list[tuple[str, Spec]] = [
    (r"_PECmd_Output\.csv$", Spec("prefetch_execution", [("last_run", ["LastRun"]), ("source_created", ["SourceCreated"]), ("source_modified", ["SourceModified"]), *[(f"previous_run_{i}", [f"PreviousRun{i}"]) for i in range(8)]], "{ExecutableName} ran {RunCount} times ({SourceFilename|SourceFile})")),
    (r"_EvtxECmd_Output\.csv$", Spec("event_log", [("time_created", ["TimeCreated"])], "EID {EventId} {Channel}: {MapDescription|Provider} user={UserName}", "payload")),
    (r"_MFTECmd_\$J_Output\.csv$", Spec("usn_journal", [("update", ["UpdateTimestamp"])], "{ParentPath}\\{Name}: {UpdateReasons}")),
    (r"_MFTECmd_\$MFT_Output\.csv$", Spec("mft_file", [("si_created", ["Created0x10"]), ("fn_created", ["Created0x30"]), ("si_modified", ["LastModified0x10"]), ("si_accessed", ["LastAccess0x10"]), ("si_record_changed", ["LastRecordChange0x10"])], "{ParentPath}\\{FileName} ({FileSize?0} bytes)", "mft")),
    (r"_RECmd_Batch.*_Output\.csv$", Spec("registry", [("last_write", ["LastWriteTimestamp", "KeyLastWriteTimestamp"])], "{KeyPath}\\{ValueName} = {ValueData} ({Description})")),
    (r"_Amcache_(Un)?AssociatedFileEntries\.csv$", Spec("amcache_file", [("key_last_write", ["FileKeyLastWriteTimestamp", "KeyLastWriteTimestamp"])], "{Name} ({FullPath}) sha1={SHA1}")),
    (r"_UserAssist__.*\.csv$", Spec("user_assist_execution", [("last_executed", ["LastExecuted"])], "{ProgramName} run {RunCounter} times")),
    (r"_TaskCache__.*\.csv$", Spec("scheduled_task", [("created", ["CreatedOn"]), ("last_start", ["LastStart"]), ("last_stop", ["LastStop"])], "Task {KeyName} -> {Path} (author={Author})")),
    (r"_Services__.*\.csv$", Spec("service", [("name_key_last_write", ["NameKeyLastWrite"]), ("parameters_key_last_write", ["ParametersKeyLastWrite"])], "{Name} ({DisplayName}) start={StartMode} image={ImagePath} dll={ServiceDLL}")),
    (r"_AppCompatCache.*\.csv$", Spec("shimcache", [("last_modified", ["LastModifiedTimeUTC", "LastModifiedTime"])], "{Path} executed={Executed??}")),
    (r"_(BamDam|Bam)__.*\.csv$", Spec("bam_execution", [("last_executed", ["ExecutionTime", "LastExecutionTime", "LastExecuted"])], "{Program|Path|ValueName} user={UserName|SID|UserSid}")),
    (r"_LECmd_Output\.csv$", Spec("lnk_file", [(f"{a}_{b}", [f"{a.title()}{b.title()}"]) for a in ("source", "target") for b in ("created", "modified", "accessed")], "{SourceFile} -> {LocalPath|NetworkPath|TargetIDAbsolutePath} {Arguments} vol={VolumeSerialNumber}")),
    (r"_(Automatic|Custom)Destinations\.csv$", Spec("jumplist", [("source_created", ["SourceCreated"]), ("source_modified", ["SourceModified"]), ("target_created", ["TargetCreated"]), ("target_modified", ["TargetModified"]), ("last_modified", ["LastModified"])], "[{AppIdDescription|AppId}] {Path|LocalPath|TargetIDAbsolutePath}")),
    (r"_(UsrClass|NTUSER)\.csv$", Spec("shellbag", [("last_write", ["LastWriteTime", "LastWriteTimestamp"]), ("first_interacted", ["FirstInteracted"]), ("last_interacted", ["LastInteracted"])], "{AbsolutePath|Value} ({ShellType})")),
    (r"_RBCmd_Output\.csv$", Spec("recycle_bin", [("deleted", ["DeletedOn", "DeletedTimestamp"])], "deleted {FileName|FileNameOriginal} ({FileSize?0} bytes)")),
    (r"_SrumECmd_NetworkUsages_Output\.csv$", Spec("srum_network", [("timestamp", ["Timestamp"])], "{ExeInfo|AppId} user={UserName|UserId} sent={BytesSent?0} recv={BytesReceived?0}")),
    (r"_Activity\.csv$", Spec("activity", [("start", ["StartTime"]), ("end", ["EndTime"]), ("last_modified", ["LastModifiedTime", "LastModified"])], "{Executable|AppId}: {DisplayText|Payload}")),
]
SKIPPED = [
    r"_PECmd_Output_Timeline\.csv$", r"_MFTECmd_\$(Boot|SDS)_Output\.csv$", r"_Amcache_(Device|Drive|Driver).*\.csv$", r"_Amcache_ShortCuts\.csv$", r"_Activity_PackageIDs\.csv$", r"_TimeZoneInfo__.*\.csv$", r"_MountedDevices__.*\.csv$",
    r"_AppCompatFlags2__.*\.csv$", r"_FileExts__.*\.csv$", r"_Taskband__.*\.csv$", r"_NetworkAdapters__.*\.csv$", r"_VolumeInfoCache__.*\.csv$", r"_DeviceClasses__.*\.csv$", r"_AppPaths__.*\.csv$", r"_Products__.*\.csv$", r"_UnInstall__.*\.csv$",
    r"_SrumECmd_(EnergyUsage|PushNotifications)_Output\.csv$",
]
MFT = r"_MFTECmd_\$MFT_Output\.csv$"
GENERIC_STAMPS = [
    "TimeCreated", "Timestamp", "LastWriteTimestamp", "KeyLastWriteTimestamp", "LastWriteTime", "NameKeyLastWrite", "ParametersKeyLastWrite", "CreatedOn", "ModifiedOn", "AccessedOn", "CreationTime", "CreatedTime",
    "SourceCreated", "SourceModified", "SourceAccessed", "TargetCreated", "TargetModified", "TargetAccessed", "OpenedOn", "ExecutedOn", "ExecutionTime", "LastExecuted", "LastRun", "LastStart", "LastStop", "RunTime",
    "LastModified", "LastModifiedTime", "LastModifiedTimeUTC", "DeletedOn", "UpdateTimestamp", "StartTime", "EndTime", "FirstInteracted", "LastInteracted", "TrackerCreatedOn", "LastOpened", "LastClosed",
    "ExtensionLastOpened", "LastLoginTime", "LastPasswordChange", "LastIncorrectPassword", "InstallDate", "Date",
]
SHOWN = ["Name", "FileName", "ProgramName", "ExecutableName", "Executable", "ExeInfo", "Path", "FullPath", "AbsolutePath", "LocalPath", "ParentPath", "ImagePath", "KeyPath", "BatchKeyPath", "KeyName", "ValueName", "ValueData", "Url", "DisplayName", "DisplayText", "UserName", "Description"]

MEMORY_SPECS: dict[str, Spec] = {
    "pslist": Spec("memory_process", [("process_start", ["CreateTime"])], "[pslist] {ImageFileName} pid={PID} ppid={PPID} threads={Threads}"),
    "psscan": Spec("memory_process_scan", [("process_start", ["CreateTime"])], "[psscan] {ImageFileName} pid={PID} ppid={PPID}"),
    "pstree": Spec("memory_process_tree", [("process_start", ["CreateTime"])], "[pstree] {ImageFileName} pid={PID} ppid={PPID}"),
    "netscan": Spec("memory_network", [("connection_created", ["Created"])], "{Owner} pid={PID} {LocalAddr}:{LocalPort} -> {ForeignAddr}:{ForeignPort} [{State}]"),
    "cmdline": Spec("memory_cmdline", [], "{Process} pid={PID}: {Args}"),
    "malfind": Spec("memory_injection", [], "injected region in {Process} pid={PID} at {Start VPN} prot={Protection}", "mz"),
    "svcscan": Spec("memory_service", [], "service {Name} state={State} binary={Binary}"),
    "yarascan": Spec("memory_yara_hit", [], "YARA {Rule} in {Process} pid={PID} at {Offset}"),
    "linux_pslist": Spec("memory_process", [("process_start", ["CreateTime"])], "[pslist] {COMM|Name|ImageFileName} pid={PID} ppid={PPID} uid={UID|EUID}"),
    "linux_psscan": Spec("memory_process_scan", [("process_start", ["CreateTime"])], "[psscan] {COMM|Name|ImageFileName} pid={PID} ppid={PPID}"),
    "linux_pstree": Spec("memory_process_tree", [("process_start", ["CreateTime"])], "[pstree] {COMM|Name} pid={PID} ppid={PPID}"),
    "linux_psaux": Spec("memory_cmdline", [], "{COMM|Name} pid={PID}: {ARGS|Args|Arguments?(no arguments)}"),
    "linux_bash": Spec("memory_shell_history", [("executed", ["CommandTime"])], "[{Process|COMM|Name} pid={PID}] {Command}"),
    "linux_envars": Spec("memory_environment", [], "{COMM|Process|Name} pid={PID}: {Key|Variable|Name}={Value}", "preload"),
    "linux_library_list": Spec("memory_loaded_library", [], "{Name|COMM|Process} pid={PID} loaded {Path|LoadAddress}"),
    "linux_lsof": Spec("memory_open_file", [], "{COMM|Process} pid={PID} fd={FD} {Path|Name}"),
    "linux_sockstat": Spec("memory_network", [], "{COMM|Process} pid={PID} {Proto|Protocol} {Source Addr|LocalAddr|Source}:{Source Port|LocalPort} -> {Destination Addr|RemoteAddr|Destination}:{Destination Port|RemotePort} [{State}]"),
    "linux_lsmod": Spec("memory_kernel_module", [], "module {Name} size={Size} offset={Offset|Address}"),
    "linux_malfind": Spec("memory_injection", [], "injected region in {Process|COMM} pid={PID} at {Start|Start VPN} prot={Protection}", "elf"),
    "linux_hidden_modules": Spec("memory_hidden_module", [], "HIDDEN kernel module {Name} at {Offset|Address} size={Size}"),
    "linux_check_syscall": Spec("memory_syscall_hook", [], "syscall {Index} in {Table Name|Table} -> {Handler Symbol|Symbol|Handler} @{Handler Address|Address}"),
    "linux_netfilter": Spec("memory_netfilter_hook", [], "netfilter hook {Name|Symbol} proto={Proto|Protocol} hook={Hook} @{Handler|Address}"),
    "linux_tty_check": Spec("memory_tty_hook", [], "tty hook {Name} -> {Symbol|Handler} @{Address}"),
    "linux_process_spoofing": Spec("memory_process_spoof", [], "process spoofing: pid={PID} argv0={Argv|Command Line} real={Path|Binary Path}"),
    "linux_ebpf": Spec("memory_ebpf_program", [], "eBPF program {Name} type={Type} @{Address|Offset}"),
    "linux_check_ftrace": Spec("memory_ftrace_hook", [], "ftrace hook on {Symbol|Name} -> {Callback|Handler} module={Module}"),
    "linux_mountinfo": Spec("memory_mount", [], "{DEVNAME|Device} on {MOUNT_PATH|Mount Point|Path} type={FSTYPE|Type} opts={MNT_OPTS|Options}"),
}
PRELOADS = ["LD_PRELOAD", "LD_LIBRARY_PATH", "LD_AUDIT"]


# --- derived values -----------------------------------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _first_wins(entries: Column) -> Column:
    """A map of entries in which a key's first value counts."""
    told = lambda es, keys: F.map_from_entries(F.filter(es, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
    return _let(entries, lambda es: _let(F.transform(es, lambda e: e["key"]), lambda keys: told(es, keys)))


_ENTRIES = "array<struct<key:string,value:string>>"


def _nested(v: Column) -> Column:
    return v.startswith("{") | v.startswith("[")


def _pairs(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _named(m: Column) -> Column:
    name, value = F.coalesce(m["@Name"], m["Name"]), F.coalesce(m["#text"], m["Text"], F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("key"), value.alias("value")))


def _named_data(data: Column) -> Column:
    """Entries of a part's Data: a list of named values (the last of a name counts), one named value, an object or a text."""
    many = F.reverse(F.array_compact(F.transform(F.from_json(data, "array<map<string,string>>"), lambda m: _named(m))))
    plain = lambda m: _pairs(F.map_filter(m, lambda k, v: ~_nested(F.coalesce(v, F.lit("")))))
    single = _let(F.from_json(data, "map<string,string>"), lambda m: F.when(_named(m).isNotNull(), F.array(_named(m))).otherwise(plain(m)))
    return F.when(data.startswith("["), many).when(data.startswith("{"), single).when(data != "", F.array(F.struct(F.lit("Data").alias("key"), data.alias("value"))))


def payload(text: Column) -> Column:
    """Flat map of an event's payload: named data first, then the scalars of each part, then those beside them."""
    none = F.array().cast(_ENTRIES)
    parts = ("EventData", "UserData", "System")
    scalars = lambda m, left_out: _pairs(F.map_filter(m, lambda k, v: ~k.isin(*left_out) & v.isNotNull() & ~_nested(v)))

    def flat(top: Column) -> Column:
        both = [_let(F.from_json(top[p], "map<string,string>"), lambda m: F.struct(F.coalesce(_named_data(m["Data"]), none).alias("named"), F.coalesce(F.filter(scalars(m, ["Data"]), lambda e: e["value"] != ""), none).alias("scalars"))) for p in parts]
        return _let(F.array(*both), lambda b: F.concat(*[b[i]["named"] for i in (2, 1, 0)], *[b[i]["scalars"] for i in range(3)], F.coalesce(scalars(top, parts), none)))

    return _first_wins(_let(F.from_json(text, "map<string,string>"), flat))


def _truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "y"), F.lit(False))


def _derived(kind: str) -> Column:
    raw = F.col("raw")
    if kind == "payload":
        return F.to_json(F.struct(payload(raw["Payload"]).alias("payload")))
    if kind == "mft":
        older = F.coalesce((raw["Created0x10"] != "") & (raw["Created0x30"] != "") & (raw["Created0x10"] < raw["Created0x30"]), F.lit(False))
        return F.to_json(F.struct((_truth(raw["SI<FN"]) | older).alias("si_lt_fn"), _truth(raw["uSecZeros"]).alias("usec_zeros"), _truth(raw["Timestomped"]).alias("timestomped"), _truth(raw["IsDirectory"]).alias("is_directory")))
    if kind == "mz":
        return F.to_json(F.struct(fn.mz_header(raw["Hexdump"]).alias("mz_header")))
    if kind == "elf":
        return F.to_json(F.struct(F.lit(False).alias("mz_header"), fn.elf_header(raw["Hexdump"]).alias("elf_header")))
    if kind == "preload":
        return F.to_json(F.struct(F.upper(fn.first_filled(raw["Key"], raw["Variable"], raw["Name"])).isin(PRELOADS).alias("is_preload")))
    return F.lit(None).cast("string")


def registry_type() -> Column:
    """registry_run for autostart keys, else registry_ and the category."""
    raw = F.col("raw")
    key = F.lower(fn.first_filled(raw["KeyPath"], raw["BatchKeyPath"]))
    return F.when(key.contains("currentversion\\run"), "registry_run").otherwise(F.concat(F.lit("registry_"), F.replace(F.lower(F.coalesce(F.nullif(raw["Category"], F.lit("")), F.lit("unknown"))), F.lit(" "), F.lit("_"))))


_FLAGS = {"mz": (" [MZ HEADER]", "mz_header"), "elf": (" [ELF HEADER]", "elf_header"), "preload": (" [PRELOAD]", "is_preload")}


def by_spec(rows: DataFrame, spec: Spec, missing: str = "") -> DataFrame:
    """Records from rows with case_id, source_id, host, source and raw."""
    out = rows.withColumn("enrich", _derived(spec.derived))
    text = records.template(spec.text, missing=missing)
    if spec.derived in _FLAGS:
        mark, flag = _FLAGS[spec.derived]
        text = F.concat(text, F.when(F.get_json_object("enrich", f"$.{flag}") == "true", mark).otherwise(""))
    kind = registry_type() if spec.type == "registry" else F.lit(spec.type)
    if spec.type == "activity":
        text = F.substring(text, 1, 280)
    return out.withColumns({"artifact_type": kind, "description": text, "stamps": records.stamps(spec.stamps)})


def generic(rows: DataFrame, file_name: str, columns: list[str]) -> DataFrame:
    """Records of a table that no family knows: type from the file's name, known time columns, the telling columns."""
    stem = re.sub(r"(?i)^\d{14}_|_Output|\.csv$", "", file_name)
    stem = re.sub(r"__[A-Za-z]_[\w_]+$", "", stem).lower()
    shown = lambda names: F.array_compact(F.array(*[F.when(F.col("raw")[c] != "", F.concat(F.lit(f"{c}="), F.col("raw")[c])) for c in names])) if names else F.array().cast("array<string>")
    telling, first = shown([c for c in SHOWN if c in columns]), shown(columns[:6])
    bits = F.when(F.size(telling) < 3, first).otherwise(telling)
    pairs = [(c.lower(), [c]) for c in GENERIC_STAMPS if c in columns]
    return rows.withColumns({"enrich": F.lit(None).cast("string"), "artifact_type": F.lit("unparsed_" + stem), "description": F.substring(F.array_join(F.slice(bits, 1, 8), ", "), 1, 300), "stamps": records.stamps(pairs)})


# --- readers ----------------------------------------------------------------------------------------------------

def spec_for(file_name: str, include_mft: bool = False) -> Spec | str:
    """The family's spec, "skip" or "generic"."""
    if any(re.search(p, file_name, re.I) for p in SKIPPED) or (not include_mft and re.search(MFT, file_name, re.I)):
        return "skip"
    return next((s for p, s in CSV_SPECS if re.search(p, file_name, re.I)), "generic")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark is no part of the header."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, maxCharsPerColumn=-1, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _with_raw(df: DataFrame, case_id: str, source_id: str, host: str, source: str) -> DataFrame:
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    return df.select(F.lit(case_id).alias("case_id"), F.lit(source_id).alias("source_id"), F.lit(host).alias("host"), F.lit(source).alias("source"), raw.alias("raw"))


def literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files below a folder on any file system that Spark reads, in path order; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").load(literal(folder))
    return sorted(r["path"] for r in files.select("path").toLocalIterator())  # one row a file


def ingest_csv_folder(spark: SparkSession, folder: str, case_id: str, host: str, source_id: str, include_mft: bool = False, source: str = "tables") -> DataFrame:
    """Artifacts of every CSV file below a folder; files of skipped families are left out."""
    out = None
    for path in csv_files(spark, folder):
        name = path.rpartition("/")[2]
        spec = spec_for(name, include_mft)
        if spec == "skip":
            continue
        df = read_csv(spark, literal(path))
        rows = _with_raw(df, case_id, source_id, host, source)
        part = records.build(generic(rows, name, df.columns) if spec == "generic" else by_spec(rows, spec))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else records.build(_with_raw(spark.createDataFrame([("",)], "x string").where("false"), case_id, source_id, host, source).withColumns({"enrich": F.lit(None).cast("string"), "artifact_type": F.lit(""), "description": F.lit(""), "stamps": records.stamps([])}))


def ingest_memory(spark: SparkSession, files: dict[str, str], case_id: str, host: str, source_id: str, acquired: str | None = None, source: str = "memory") -> DataFrame:
    """Artifacts of plugin results: ``files`` maps plugin names to files that each hold one JSON array of objects, or objects one after another; a large file is read by ranges."""
    out = None
    for plugin, path in sorted(files.items()):
        spec = MEMORY_SPECS.get(plugin)
        if spec is None:
            continue
        objects = files_.json_objects(files_.at(spark, [path]))
        rows = objects.select(F.from_json("value", "map<string,string>").alias("raw")).where("raw is not null")
        rows = rows.select(F.lit(case_id).alias("case_id"), F.lit(source_id).alias("source_id"), F.lit(host).alias("host"), F.lit(source).alias("source"), "raw")
        made = by_spec(rows, spec, missing="" if plugin.startswith("linux_") else "None")
        when = F.array(F.struct(F.lit("acquired").alias("label"), F.lit(acquired).cast("string").alias("value")))
        made = made.withColumn("stamps", F.when(F.size(F.filter("stamps", lambda s: s["value"].isNotNull())) > 0, F.col("stamps")).otherwise(when))
        part = records.build(made)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no known plugin among the files")
    return out
