"""Linux text evidence: logs, histories and configuration files as artifact records.

Readers take paths inside a collection, dispatched by glob; parsing is column expressions.
Formats of lines are read line by line and split freely; where neighbouring lines belong
together (shell history, audit and apt logs) they carry their place in the file. Only small
files that mean something as a whole (units, settings) are read one file a row.
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.sources import files, records

# --- fixed values: first matching glob (on the lower-cased path inside the collection) names the parser -----

GLOBS = [
    ("bodyfile/*", "bodyfile"), ("*/var/log/auth.log*", "authlog"), ("*/var/log/secure*", "authlog"),
    ("*/.bash_history", "history"), ("*/.zsh_history", "history"), ("*/.sh_history", "history"),
    ("*/etc/crontab", "cron"), ("*/etc/cron.d/*", "cron"), ("*/var/spool/cron/*", "cron"), ("*/var/spool/cron/crontabs/*", "cron"),
    ("*/etc/systemd/system/*.service", "unit"), ("*/lib/systemd/system/*.service", "unit"), ("*/.config/systemd/user/*.service", "unit"),
    ("*/.ssh/authorized_keys*", "keys"), ("*/etc/passwd", "passwd"),
    ("live_response/process/ps*", "ps"), ("live_response/process/*process*", "ps"),
    ("live_response/network/ss*", "network"), ("live_response/network/netstat*", "network"),
    ("*/var/log/audit/audit.log*", "auditd"), ("*/var/log/dpkg.log*", "dpkg"), ("*/var/log/apt/history.log*", "apt"),
    ("*/var/log/yum.log*", "yum"), ("*/var/log/dnf.rpm.log*", "yum"),
    ("live_response/*journal*", "journal"), ("*/var/log/journal*.txt", "journal"), ("*/var/log/journal*.json", "journal"),
    ("*/etc/timezone", "identity"), ("*/etc/hostname", "identity"), ("*/etc/machine-id", "identity"), ("*/etc/os-release", "identity"), ("*/etc/hosts", "identity"), ("*/etc/ssh/sshd_config", "identity"),
    ("*/etc/ld.so.preload", "persistence"), ("*/etc/rc.local", "persistence"), ("*/etc/profile.d/*", "persistence"), ("*/.bashrc", "persistence"), ("*/.bash_profile", "persistence"), ("*/.profile", "persistence"),
    ("*/.zshrc", "persistence"), ("*/.xprofile", "persistence"), ("*/.xinitrc", "persistence"), ("*/.config/autostart/*", "persistence"), ("*/etc/modprobe.d/*", "persistence"), ("*/etc/modules-load.d/*", "persistence"),
    ("*/etc/modules", "persistence"), ("*/etc/init.d/*", "persistence"), ("*/etc/cron.hourly/*", "persistence"), ("*/etc/cron.daily/*", "persistence"), ("*/etc/cron.weekly/*", "persistence"), ("*/etc/cron.monthly/*", "persistence"),
    ("*/etc/sudoers", "persistence"), ("*/etc/sudoers.d/*", "persistence"), ("*/var/spool/at/*", "persistence"), ("*/etc/group", "persistence"), ("*/.ssh/known_hosts*", "persistence"),
    ("*/etc/systemd/system/*.timer", "persistence"), ("*/lib/systemd/system/*.timer", "persistence"), ("*/.local/share/trash/info/*.trashinfo", "trash"),
]
IGNORED = ["uac.log*", "*.sha256", "*.md5", "hash_executables/*", "live_response/hardware/*", "live_response/packages/*", "chkrootkit/*", "memory_dump/*"]
AUTH_EVENTS = [
    (r"Accepted (\w+) for (\S+) from (\S+)", "ssh_login_success"), (r"Failed password for (?:invalid user )?(\S+) from (\S+)", "ssh_login_failure"), (r"session opened for user (\S+)", "session_open"),
    (r"sudo:\s+(\S+)\s*:.*COMMAND=(.+)$", "sudo_command"), (r"new user: name=(\S+)", "user_added"), (r"new group: name=(\S+)", "group_added"), (r"authentication failure", "auth_failure"),
]
AUDIT_FIELDS = ["comm", "exe", "auid", "uid", "euid", "gid", "pid", "ppid", "success", "key", "cwd", "name", "terminal", "res", "acct", "hostname", "addr", "syscall"]
DPKG_ACTIONS = ["install", "upgrade", "remove", "purge", "configure", "trigproc"]
PERSISTENCE_KINDS = [
    ("ld.so.preload", "ld_preload"), ("/etc/profile.d/", "shell_startup"), (".bashrc", "shell_startup"), (".bash_profile", "shell_startup"), (".profile", "shell_startup"), (".zshrc", "shell_startup"), (".bash_logout", "shell_startup"),
    ("/autostart/", "desktop_autostart"), (".xprofile", "x_startup"), (".xinitrc", "x_startup"), ("/modprobe.d/", "kernel_module"), ("/modules-load.d/", "kernel_module"), ("/etc/modules", "kernel_module"), ("rc.local", "boot_script"),
    ("/init.d/", "sysv_init"), ("/rc.d/", "sysv_init"), ("/etc/init/", "upstart"), ("/cron.hourly/", "cron_script"), ("/cron.daily/", "cron_script"), ("/cron.weekly/", "cron_script"), ("/cron.monthly/", "cron_script"),
    ("/var/spool/at/", "at_job"), ("/sudoers", "sudoers"), (".timer", "systemd_timer"), ("/etc/group", "group_membership"), ("known_hosts", "ssh_known_hosts"),
]
IDENTITY_NAMES = {"hostname": "hostname", "machine-id": "machine_id", "os-release": "os_release", "timezone": "timezone", "hosts": "hosts_file", "sshd_config": "sshd_config"}
CRON = r"^\s*([\d*/,\-]+\s+[\d*/,\-]+\s+[\d*/,\-]+\s+[\d*/,\-]+\s+[\d*/,\-]+|@\w+)\s+(.+)$"
SS = r"(?i)^(tcp|udp)\s+(\S+)\s+\S+\s+\S+\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
NETSTAT = r"(?i)^(tcp6?|udp6?)\s+\d+\s+\d+\s+(\S+)\s+(\S+)\s+(\S*)\s*(.*)$"
AUDIT = r"type=(\S+)\s+msg=audit\((\d+\.\d+):(\d+)\):\s*(.*)$"
YUM = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\S+T\S+)\s+(?:\w+\s+)?(Installed|Erased|Updated|Obsoleted|Upgraded):\s*(.+)$"
JOURNAL = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(.*)$"
SYSLOG_ISO = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*(?:[+-]\d{2}:?\d{2}|Z)?)\s+(.*)$"


def parser_for(path: str) -> str | None:
    """The parser of a path inside a collection; None if it is ignored or unknown."""
    low = path.replace("\\", "/").lower().lstrip("/")
    if any(fnmatch.fnmatch(low, p) for p in IGNORED):
        return None
    return next((name for p, name in GLOBS if fnmatch.fnmatch(low, p) or fnmatch.fnmatch("/" + low, p)), None)


# --- reading --------------------------------------------------------------------------------------------------

def literal(paths: list[str]) -> list[str]:
    """Paths whose glob characters (collections have folders like [root]) stand for themselves."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


@dataclass(frozen=True)
class Paths:
    """Evidence text in files."""

    spark: SparkSession
    paths: list[str]

    def _read(self, whole: bool, *more: str) -> DataFrame:
        """(value, path, name, mtime). Spark doesn't list names that start with a dot or an underscore: tasks read those files by path."""
        hidden = [p for p in self.paths if p.rpartition("/")[2].startswith((".", "_"))]
        shown = [p for p in self.paths if p not in set(hidden)]
        parts = []
        if shown:
            df = self.spark.read.text(literal(shown), wholetext=whole, lineSep=None if whole else "\n").select("value", "_metadata.file_path", "_metadata.file_modification_time", *more)
            plain = F.regexp_replace("file_path", "^file:(//)?", "")
            path = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
            parts.append(df.select("value", path.alias("path"), F.col("file_modification_time").alias("mtime"), *[m.rpartition(".")[2] for m in more]))
        if hidden:
            found = files.at(self.spark, hidden)
            read = files.texts(found.where("size > 0")).withColumn("offset", F.lit(0).cast("long")) if whole else files.lines(found)
            parts.append(read.select("value", "path", F.col("modified").alias("mtime"), *[F.col("offset").alias(m.rpartition(".")[2]) for m in more]))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return df.withColumn("name", F.substring_index("path", "/", -1)).select("value", "path", "name", "mtime", *[m.rpartition(".")[2] for m in more])

    def files(self) -> DataFrame:
        """(path, name, mtime, text), one row a file; an empty file has none."""
        return self._read(True).withColumnRenamed("value", "text")

    def empty(self) -> DataFrame | None:
        """files() of the empty files."""
        return files.at(self.spark, self.paths).where("size = 0").select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modified").alias("mtime"), F.lit("").alias("text"))

    def lines(self) -> DataFrame:
        """(path, name, mtime, line) of formats whose lines stand alone; blank lines are left out."""
        return _clean(self._read(False)).drop("value")

    def ordered(self) -> DataFrame:
        """lines() with no, which sorts as the lines of a file do: a split of a file is read in order by one task, so a file of any size is read by many."""
        df = self._read(False, "_metadata.file_block_start").withColumn("no", F.struct("file_block_start", F.monotonically_increasing_id().alias("row")))
        return _clean(df).select("path", "name", "mtime", "no", "line")


@dataclass(frozen=True)
class Rows:
    """Evidence text that is a table already: path, mtime, no (which sorts as the lines of a path do) and line."""

    table: DataFrame

    def files(self) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
        return self.table.groupBy("path").agg(F.max("mtime").alias("mtime"), text.alias("text")).select("path", F.substring_index("path", "/", -1).alias("name"), "mtime", "text")

    def empty(self) -> DataFrame | None:
        """A path without a line isn't in the table."""
        return None

    def lines(self) -> DataFrame:
        return self.ordered().drop("no")

    def ordered(self) -> DataFrame:
        return _clean(self.table.withColumn("value", F.col("line"))).select("path", F.substring_index("path", "/", -1).alias("name"), "mtime", "no", "line")


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.regexp_replace("value", r"\r$", "")).where(F.trim("line") != "")


def numbered(df: DataFrame) -> DataFrame:
    """Lines of files() with their number, for formats in which the number itself counts."""
    return df.select("path", "name", "mtime", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).where(F.trim("line") != "")


def owner(path: Column) -> Column:
    """Owner of a per-user file, from its path inside the collection; what stands left of the marker is the analyst's machine."""
    inside = F.regexp_replace(path, r"^.*/(\[root\]|live_response|bodyfile)/", "/")
    named = F.regexp_extract(inside, r"/(?:home|Users)/([^/]+)/", 1)
    return F.when(named != "", named).when(inside.rlike(r"^/?([^/]+/)?root/"), "root").otherwise("unknown")


def _stamp(label: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")))


def _raw(**values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))


def _mtime() -> Column:
    return _stamp("file_modified", fn.canonical(F.col("mtime")))


def _record(df: DataFrame, kind: str, stamps: Column, text: Column, raw: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("artifact_type"), stamps.alias("stamps"), text.alias("description"), raw.alias("raw"))


def _at(line: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(line, pattern, i)


def syslog_time(line: Column, mtime: Column, zone: Column) -> tuple[Column, Column]:
    """(time, rest) of a syslog line; a time without offset is local, one without year is near the file's."""
    iso = line.rlike(SYSLOG_ISO)
    stamp = _at(line, SYSLOG_ISO, 1)
    local = fn.local_to_utc(fn.canonical(fn.infer_year(_at(line, SYSLOG, 1), mtime)), zone)
    named = F.when(stamp.contains("T") | stamp.contains("+"), fn.normalize_timestamp(stamp)).otherwise(fn.local_to_utc(fn.normalize_timestamp(stamp), zone))
    rest = F.when(iso, _at(line, SYSLOG_ISO, 2)).when(line.rlike(SYSLOG), _at(line, SYSLOG, 2)).otherwise(line)
    return F.when(iso, named).otherwise(F.when(line.rlike(SYSLOG), local)), rest


# --- parsers: each takes (Paths or Rows, collected, zone) and yields artifact_type, stamps, description, raw ------

def bodyfile(src, collected, zone):
    f = F.split("line", r"\|")
    df = src.lines().where(F.size(f) >= 11).select(*[f[i].alias(n) for i, n in enumerate(("md5", "path", "inode", "mode", "uid", "gid", "size", "a", "m", "c", "b"))])
    times = F.array(*[F.struct(F.lit(label).alias("label"), fn.epoch_time(F.col(c)).alias("value")) for label, c in (("accessed", "a"), ("modified", "m"), ("changed", "c"), ("created", "b"))])
    text = F.concat("path", F.lit(" ("), "size", F.lit(" bytes, "), "mode", F.lit(", uid="), "uid", F.lit(" gid="), "gid", F.lit(")"))
    return _record(df, "file_entry", times, text, _raw(path=F.col("path"), inode=F.col("inode"), mode=F.col("mode"), uid=F.col("uid"), gid=F.col("gid"), size=F.col("size"), md5=F.when(F.col("md5") != "0", F.col("md5"))))


def authlog(src, collected, zone):
    ts, rest = syslog_time(F.col("line"), F.col("mtime"), zone)
    df = src.lines().select("name", ts.alias("ts"), rest.alias("rest"))
    event = F.lit(None).cast("string")
    for pattern, name in reversed(AUTH_EVENTS):
        event = F.when(F.col("rest").rlike(pattern), name).otherwise(event)
    df = df.withColumn("event", event).where("event is not null")
    return _record(df, "auth_log", _stamp("logged", F.col("ts")), F.concat(F.lit("["), "event", F.lit("] "), "rest"), _raw(event=F.col("event"), line=F.col("rest"), log=F.col("name"), tz=F.coalesce(zone, F.lit("unknown"))))


def history(src, collected, zone):
    """A `#epoch` line dates the command after it; a zsh line carries its own epoch."""
    df = src.ordered()
    marker = F.col("line").rlike(r"^#\s*\d+\s*$")
    before = F.lag("line").over(Window.partitionBy("path").orderBy("no"))
    df = df.withColumns({"before": before, "marker": marker}).where("not marker")
    zsh = F.col("line").startswith(": ") & F.col("line").contains(":0;")
    epoch = F.when(zsh, F.trim(F.regexp_extract("line", r"^: ([^:;]*)", 1))).when(F.col("before").rlike(r"^#\s*\d+\s*$"), F.trim(F.substring("before", 2, 40)))
    df = df.withColumns({"ts": fn.epoch_time(epoch), "command": F.when(zsh, F.regexp_replace("line", r"^[^;]*;", "")).otherwise(F.col("line")), "user": owner(F.col("path"))})
    return _record(df, "shell_history", _stamp("executed", F.col("ts")), F.concat(F.lit("["), "user", F.lit("] "), "command"), _raw(user=F.col("user"), command=F.col("command"), file=F.col("name")))


def cron(src, collected, zone):
    """System crontabs name the user before the command; those of users don't."""
    df = src.lines().where(~F.ltrim("line").startswith("#") & F.col("line").rlike(CRON))
    system = F.col("path").contains("cron.d") | (F.col("name") == "crontab")
    whole = _at(F.col("line"), CRON, 2)
    first, rest = F.regexp_extract(whole, r"^(\S+)\s+(.*)$", 1), F.regexp_extract(whole, r"^(\S+)\s+(.*)$", 2)
    named = system & (first != "") & (rest != "") & ~first.contains("/")
    df = df.withColumns({"schedule": _at(F.col("line"), CRON, 1), "user": F.when(named, first).otherwise(""), "command": F.when(named, rest).otherwise(whole)})
    who = F.when(F.col("user") != "", F.col("user")).otherwise(owner(F.col("path")))
    return _record(df, "cron_job", _mtime(), F.concat(F.lit("["), who, F.lit("] "), "schedule", F.lit(" -> "), "command"), _raw(schedule=F.col("schedule"), command=F.col("command"), user=F.col("user"), file=F.col("name")))


def unit(src, collected, zone):
    """The first value of each key in the first 200 lines; a unit that starts nothing is left out."""
    df = numbered(src.files()).where("no < 200").where(F.col("line").contains("=") & ~F.ltrim("line").rlike(r"^[#;\[]"))
    pairs = df.select("path", "name", "mtime", "no", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("v"))
    first = pairs.groupBy("path", "name", "mtime", "k").agg(F.min_by("v", "no").alias("v"))
    body = first.groupBy("path", "name", "mtime").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("body")).where(F.coalesce(F.col("body")["ExecStart"], F.lit("")) != "")
    text = F.concat("name", F.lit(": ExecStart="), F.col("body")["ExecStart"], F.lit(" (desc="), F.coalesce(F.col("body")["Description"], F.lit("")), F.lit(")"))
    return _record(body, "systemd_unit", _mtime(), text, F.map_concat(_raw(unit=F.col("name"), exec_start=F.col("body")["ExecStart"], user=F.coalesce(F.col("body")["User"], F.lit(""))), F.map_filter("body", lambda k, v: ~k.isin("unit", "exec_start", "user"))))


def keys(src, collected, zone):
    df = src.lines().where(~F.ltrim("line").startswith("#")).withColumn("bits", F.split(F.trim("line"), r"\s+")).where(F.size("bits") >= 2)
    is_type = lambda b: b.startswith("ssh-") | b.startswith("ecdsa-") | b.startswith("sk-")
    kind = F.coalesce(F.get(F.filter("bits", is_type), 0), F.col("bits")[0])
    df = df.withColumns({"user": owner(F.col("path")), "key_type": kind, "comment": F.when(F.size("bits") > 2, F.element_at("bits", -1)).otherwise(""), "options": F.when(is_type(F.col("bits")[0]), "").otherwise(F.col("bits")[0])})
    return _record(df, "ssh_authorized_key", _mtime(), F.concat(F.lit("["), "user", F.lit("] "), "key_type", F.lit(" "), "comment"), _raw(user=F.col("user"), key_type=F.col("key_type"), comment=F.col("comment"), options=F.col("options"), file=F.col("path")))


def passwd(src, collected, zone):
    f = F.split("line", ":")
    df = src.lines().where(F.size(f) >= 7).select("mtime", *[f[i].alias(n) for i, n in enumerate(("user", "x", "uid", "gid", "gecos", "home", "shell"))])
    text = F.concat("user", F.lit(" uid="), "uid", F.lit(" gid="), "gid", F.lit(" shell="), "shell", F.lit(" home="), "home")
    return _record(df, "user_account", _mtime(), text, _raw(**{n: F.col(n) for n in ("user", "uid", "gid", "shell", "home", "gecos")}))


def ps(src, collected, zone):
    """`ps aux` (11 fields) or `ps -ef` (8 fields); processes are dated by the collection."""
    aux, ef = r"^\s*(\S+)\s+(\d+)" + r"\s+\S+" * 6 + r"\s+(\S+)\s+\S+\s+(.+)$", r"^\s*(\S+)\s+(\d+)\s+(\d+)\s+\S+\s+(\S+)\s+\S+\s+\S+\s+(.+)$"
    line, is_aux = F.col("line"), F.col("line").rlike(aux)
    df = src.lines().where(~F.lower(F.ltrim("line")).rlike("^(user|uid|pid )") & (is_aux | line.rlike(ef)))
    pick = lambda i, j: F.when(is_aux, _at(line, aux, i)).otherwise(_at(line, ef, j))
    df = df.withColumns({"user": pick(1, 1), "pid": pick(2, 2), "ppid": F.when(is_aux, "").otherwise(_at(line, ef, 3)), "start": pick(3, 4), "command": pick(4, 5)})
    when = F.coalesce(collected, fn.canonical(F.col("mtime")))
    return _record(df, "process", _stamp("collected", when), F.concat(F.lit("["), "user", F.lit("] pid="), "pid", F.lit(" "), "command"), _raw(**{n: F.col(n) for n in ("user", "pid", "ppid", "start", "command")}))


def network(src, collected, zone):
    line = F.col("line")
    is_ss = line.rlike(SS)
    pick = lambda i, j: F.when(is_ss, _at(line, SS, i)).otherwise(_at(line, NETSTAT, j))
    df = src.lines().where(is_ss | line.rlike(NETSTAT)).withColumns({"proto": pick(1, 1), "local": pick(3, 2), "remote": pick(4, 3), "process": pick(5, 5)})
    df = df.where(~F.col("local").isin("Local", "Address") & ~F.col("remote").isin("Peer", "Address"))
    when = F.coalesce(collected, fn.canonical(F.col("mtime")))
    return _record(df, "network_connection", _stamp("collected", when), F.trim(F.concat("proto", F.lit(" "), "local", F.lit(" -> "), "remote", F.lit(" "), "process")), _raw(**{n: F.col(n) for n in ("proto", "local", "remote", "process")}))


def auditd(src, collected, zone):
    """Lines of one serial are one event; a key's first value counts, EXECVE arguments become the command line."""
    df = src.ordered().where(F.col("line").rlike(AUDIT))
    line = F.col("line")
    df = df.select("path", "no", _at(line, AUDIT, 1).alias("type"), _at(line, AUDIT, 2).alias("epoch"), _at(line, AUDIT, 3).alias("serial"), _at(line, AUDIT, 4).alias("rest"))
    pair = F.regexp_extract_all("rest", F.lit(r'(\w+=(?:"(?:[^"\\]|\\.)*"|\S+))'), F.lit(1))
    fields = F.transform(pair, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^\w+=", ""), '^"|"$', "").alias("v")))
    df = df.withColumn("fields", fields)
    value = lambda k: F.get(F.transform(F.filter("fields", lambda f: f["k"] == k), lambda f: f["v"]), 0)
    argc = F.coalesce(value(F.lit("argc")).try_cast("int"), F.lit(0))
    args = F.transform(F.sequence(F.lit(0), F.greatest(argc - 1, F.lit(0))), lambda i: value(F.concat(F.lit("a"), i.cast("string"))))
    df = df.withColumn("cmdline", F.when((F.col("type") == "EXECVE") & (argc > 0), F.array_join(args, " ")))
    one = F.array_sort(F.collect_list(F.struct("no", "type", "fields", "cmdline", "epoch")))
    by = df.groupBy("path", "serial").agg(one.alias("e"))
    flat = F.flatten(F.transform(F.filter("e", lambda x: x["type"] != "EXECVE"), lambda x: x["fields"]))
    by = by.select("serial", F.col("e")[0]["epoch"].alias("epoch"), F.col("e")[0]["type"].alias("first"), F.array_join(F.array_sort(F.array_distinct(F.transform("e", lambda x: x["type"]))), ",").alias("types"), F.coalesce(F.get(F.array_compact(F.transform("e", lambda x: x["cmdline"])), 0), F.lit("")).alias("cmdline"), flat.alias("fields"))
    get = lambda k: F.get(F.transform(F.filter("fields", lambda f: f["k"] == k), lambda f: f["v"]), 0)
    by = by.withColumns({f"v_{k}": get(k) for k in AUDIT_FIELDS})
    who = F.when(F.coalesce(F.col("v_auid"), F.lit("?")).isin("?", "4294967295", "-1"), F.concat(F.lit("uid="), F.coalesce("v_uid", F.lit("?")))).otherwise(F.concat(F.lit("auid="), "v_auid"))
    body, kind = fn.first_filled(F.col("cmdline"), F.col("v_exe"), F.col("v_comm"), F.col("v_name")), F.when(F.col("cmdline") != "", "EXECVE").otherwise(F.col("first"))
    raw = _raw(**{k: F.col(f"v_{k}") for k in AUDIT_FIELDS}, serial=F.col("serial"), types=F.col("types"), cmdline=F.col("cmdline"))
    return _record(by, "auditd", _stamp("logged", fn.epoch_time(F.col("epoch"))), F.concat(F.lit("["), kind, F.lit("] "), who, F.lit(" "), body), raw)


def dpkg(src, collected, zone):
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
    line = F.col("line")
    df = src.lines().where(line.rlike(pattern)).select(_at(line, pattern, 1).alias("ts"), _at(line, pattern, 2).alias("action"), _at(line, pattern, 3).alias("detail")).where(F.col("action").isin(DPKG_ACTIONS))
    bits = F.split(F.trim("detail"), r"\s+")
    text = F.concat(F.lit("[dpkg] "), "action", F.lit(" "), bits[0], F.lit(" "), F.array_join(F.slice(bits, 2, F.size(bits)), " "))
    return _record(df, "package_event", _stamp("logged", F.col("ts")), text, _raw(manager=F.lit("dpkg"), action=F.col("action"), package=bits[0], detail=F.col("detail")))


def apt(src, collected, zone):
    """Blocks from one Start-Date to the next; within a block a key's last value counts."""
    df = src.ordered().where(F.col("line").contains(":"))
    block = F.sum(F.col("line").startswith("Start-Date:").cast("int")).over(Window.partitionBy("path").orderBy("no"))
    pairs = df.withColumn("block", block).where("block > 0").select("path", "block", "no", F.trim(F.substring_index("line", ":", 1)).alias("k"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("v"))
    last = pairs.groupBy("path", "block", "k").agg(F.max_by("v", "no").alias("v"))
    by = last.groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("b")).withColumn("get", F.col("b"))
    get = lambda k, default="": F.coalesce(F.col("b")[k], F.lit(default))
    actions = ["Install", "Remove", "Upgrade", "Purge", "Downgrade"]
    summary = F.array_join(F.array_compact(F.array(*[F.when(F.col("b")[a].isNotNull(), F.concat(F.lit(f"{a}: "), F.col("b")[a])) for a in actions])), "; ")
    text = F.concat(F.lit("[apt] "), get("Commandline"), F.lit(" by="), get("Requested-By", "root"), F.lit(" "), summary)
    raw = _raw(manager=F.lit("apt"), commandline=get("Commandline"), requested_by=get("Requested-By", "root"), end_date=get("End-Date"), **{a: F.col("b")[a] for a in actions})
    return _record(by, "package_event", _stamp("logged", F.regexp_replace(get("Start-Date"), r"\s+", " ")), text, raw)


def yum(src, collected, zone):
    line = F.col("line")
    df = src.lines().where(line.rlike(YUM)).select("mtime", _at(line, YUM, 1).alias("when"), _at(line, YUM, 2).alias("action"), F.trim(_at(line, YUM, 3)).alias("package"))
    ts = F.when(F.col("when").contains("T"), F.col("when")).otherwise(fn.canonical(fn.infer_year(F.col("when"), F.col("mtime"))))
    return _record(df, "package_event", _stamp("logged", ts), F.concat(F.lit("[yum] "), "action", F.lit(" "), "package"), _raw(manager=F.lit("yum"), action=F.lower("action"), package=F.col("package")))


def journal(src, collected, zone):
    """JSON lines, whose time is UTC, or short lines, whose time is local and without year."""
    df = src.lines()
    j = lambda k: F.get_json_object("line", f"$.{k}")
    told = df.where(F.col("line").startswith("{") & F.get_json_object("line", "$").isNotNull())
    unit_name = F.coalesce(F.nullif(j("_SYSTEMD_UNIT"), F.lit("")), F.nullif(j("SYSLOG_IDENTIFIER"), F.lit("")), F.lit("?"))
    one = _record(told, "journal", _stamp("logged", fn.unix_micros_time(j("__REALTIME_TIMESTAMP").try_cast("long"))), F.concat(F.lit("["), unit_name, F.lit("] "), F.coalesce(j("MESSAGE"), F.lit(""))), _raw(unit=unit_name, message=F.substring(j("MESSAGE"), 1, 600), pid=j("_PID"), uid=j("_UID"), exe=j("_EXE"), cmdline=j("_CMDLINE"), priority=j("PRIORITY"), tz=F.lit("utc")))
    line = F.col("line")
    short = df.where(~line.startswith("{") & line.rlike(JOURNAL))
    dated = fn.canonical(fn.infer_year(_at(line, JOURNAL, 1), F.col("mtime")))
    name, message = F.trim(_at(line, JOURNAL, 3)), _at(line, JOURNAL, 5)
    two = _record(short, "journal", _stamp("logged", fn.local_to_utc(dated, zone)), F.concat(F.lit("["), name, F.lit("] "), message), _raw(unit=name, pid=_at(line, JOURNAL, 4), message=F.substring(message, 1, 600), hostname=_at(line, JOURNAL, 2), tz=F.coalesce(zone, F.lit("unknown"))))
    return one.unionByName(two)


def _content(df: DataFrame, comment: str) -> DataFrame:
    kept = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(comment))
    return df.withColumn("kept", kept)


def persistence_kind(path: Column) -> Column:
    p, out = F.lower(path), F.lit("config")
    for part, kind in reversed(PERSISTENCE_KINDS):
        out = F.when(p.contains(part), kind).otherwise(out)
    return out


def persistence(src, collected, zone):
    """Files whose place is their meaning; an empty one says nothing, but for ld.so.preload."""
    found = src.files()
    empty = src.empty()
    if empty is not None:
        found = found.unionByName(empty)
    df = _content(found, "^(#|;|//)").where((F.size("kept") > 0) | F.col("path").contains("ld.so.preload")).withColumn("kind", persistence_kind(F.col("path")))
    text = F.concat(F.lit("["), "kind", F.lit("] "), "name", F.lit(": "), F.array_join(F.slice("kept", 1, 4), " ; "))
    return _record(df, "persistence_file", _mtime(), text, _raw(kind=F.col("kind"), path=F.col("path"), name=F.col("name"), lines=F.size("kept"), content=F.substring(F.array_join(F.slice("kept", 1, 80), "\n"), 1, 3000)))


def identity(src, collected, zone):
    df = _content(src.files(), "^#")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IDENTITY_NAMES.items() for x in kv]), F.col("name")), F.col("name"))
    text = F.concat(F.lit("["), label, F.lit("] "), F.array_join(F.slice("kept", 1, 6), "; "))
    return _record(df, "system_identity", _mtime(), text, _raw(file=label, path=F.col("path"), content=F.substring(F.array_join(F.slice("kept", 1, 60), "\n"), 1, 2000)))


def trash(src, collected, zone):
    df = src.files()
    get = lambda k: F.trim(F.regexp_extract("text", rf"(?m)^{k}=(.*)$", 1))
    # a plus is a plus in these paths, not a blank
    df = df.select("name", F.coalesce(F.try_url_decode(F.replace(get("Path"), F.lit("+"), F.lit("%2B"))), get("Path")).alias("original"), F.replace(get("DeletionDate"), F.lit("T"), F.lit(" ")).alias("deleted")).where("original <> ''")
    return _record(df, "trash_item", _stamp("deleted", F.col("deleted")), F.concat(F.lit("deleted "), "original"), _raw(original_path=F.col("original"), deleted=F.col("deleted"), trashinfo=F.col("name")))


PARSERS = {"bodyfile": bodyfile, "authlog": authlog, "history": history, "cron": cron, "unit": unit, "keys": keys, "passwd": passwd, "ps": ps, "network": network, "auditd": auditd, "dpkg": dpkg, "apt": apt, "yum": yum, "journal": journal, "persistence": persistence, "identity": identity, "trash": trash}


def ingest_collection(spark: SparkSession, root: str, case_id: str, host: str, source_id: str, collected: str | None = None, zone: str | None = None, source: str = "collection") -> tuple[DataFrame | None, list[str]]:
    """(artifacts, files that no parser knows) of an extracted collection folder.

    ``zone`` is the host's Olson zone; if none is given, etc/timezone of the collection tells it.
    """
    todo: dict[str, list[str]] = {}
    unknown = []
    base = root.rstrip("/") if "://" in root else files.place(root)[1].rstrip("/")
    # one row a file, as for Spark's own list of files
    for path in sorted(r["path"] for r in files.listing(spark, root).select("path").toLocalIterator()):
        inside = path[len(base) + 1 :]
        kind = parser_for(inside)
        if kind:
            todo.setdefault(kind, []).append(path)
        elif not any(fnmatch.fnmatch(inside.lower(), p) for p in IGNORED):
            unknown.append(inside)
        if zone is None and inside.endswith("etc/timezone"):
            told = files.texts(files.at(spark, [path])).first()
            zone = told["value"].partition("\n")[0].strip() or None
    where, when = F.lit(zone).cast("string"), F.lit(collected).cast("string")
    out = None
    for kind, paths in sorted(todo.items()):
        rows = PARSERS[kind](Paths(spark, paths), when, where).withColumns({"case_id": F.lit(case_id), "source_id": F.lit(source_id), "host": F.lit(host), "source": F.lit(source), "enrich": F.lit(None).cast("string")})
        part = records.build(rows)
        out = part if out is None else out.unionByName(part)
    return out, unknown
