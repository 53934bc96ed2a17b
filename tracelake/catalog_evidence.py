"""Queries of the evidence readers: the driver's rows written as log lines and exported tables, read back.

Each event, order or customer becomes a line, a file or a table row of one evidence format;
the query parses it by the engine's own reader, and its SQL twin states the record that must
come out from the row itself. Expressions that both engines share are plain SQL texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.operators import cluster, correlate, store
from tracelake.registry import register, table
from tracelake.sources import linux_text, records, tabular

EVENTS = "e AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
SEEN = "2024-01-16 00:00:00"
ZONE = "Asia/Kolkata"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _utc(sql: str) -> str:
    """The canonical text of a time, in DuckDB."""
    return f"strftime({sql}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _no_year(zone: bool) -> str:
    """The time that a line without a year gets in a file last written at SEEN, in DuckDB."""
    local = f"CASE WHEN date_trunc('second', ts) > TIMESTAMP '{SEEN}' + INTERVAL 1 DAY THEN try_strptime('2023-' || strftime(ts, '%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') ELSE date_trunc('second', ts) END"
    return _utc(f"({local}) - INTERVAL 330 MINUTE" if zone else local)


def _text(df: DataFrame, path, no, line) -> linux_text.Rows:
    """Rows as evidence text; without a line a row adds nothing."""
    return linux_text.Rows(df.select(path.alias("path"), F.lit(SEEN).cast("timestamp").alias("mtime"), no.alias("no"), line.alias("line")).where("line is not null"))


def _built(parsed: DataFrame) -> DataFrame:
    plain = {"case_id": "case-a", "source_id": "s1", "host": "h", "source": "evidence"}
    return records.build(parsed.withColumns({k: F.lit(v) for k, v in plain.items()} | {"enrich": F.lit(None).cast("string")}))


def _parsed(parser: str, text: linux_text.Rows, zone: str | None = None, collected: str | None = None) -> DataFrame:
    return _built(linux_text.PARSERS[parser](text, F.lit(collected).cast("string"), F.lit(zone).cast("string")))


def _told(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("artifact_type", "description", "timestamp_utc")


def _short_time():
    return F.date_format("ts", "MMM d HH:mm:ss")


# --- logs -----------------------------------------------------------------------------------------------------

@register("parse_authlog", f"""WITH {EVENTS}, l AS (SELECT *, CASE event_type
    WHEN 'click' THEN '[ssh_login_success] box sshd[' || event_id || ']: Accepted password for u' || user_id || ' from 10.0.0.' || k
    WHEN 'error' THEN '[ssh_login_failure] box sshd[' || event_id || ']: Failed password for invalid user u' || user_id || ' from 10.0.0.' || k
    WHEN 'purchase' THEN '[sudo_command] box sudo:   u' || user_id || ' : TTY=pts/0 ; COMMAND=/bin/x' || event_id
    WHEN 'signup' THEN '[user_added] box useradd[1]: new user: name=u' || user_id || ', UID=' || event_id END AS description FROM e)
SELECT 'auth_log' AS artifact_type, description, {_no_year(True)} AS timestamp_utc FROM l WHERE description IS NOT NULL""")
def parse_authlog(spark, d):
    """Events as lines of an auth log without year, of a host in a zone of its own; views are lines of no meaning."""
    said = F.expr("""CASE event_type WHEN 'click' THEN 'sshd[' || event_id || ']: Accepted password for u' || user_id || ' from 10.0.0.' || k
        WHEN 'error' THEN 'sshd[' || event_id || ']: Failed password for invalid user u' || user_id || ' from 10.0.0.' || k
        WHEN 'purchase' THEN 'sudo:   u' || user_id || ' : TTY=pts/0 ; COMMAND=/bin/x' || event_id
        WHEN 'signup' THEN 'useradd[1]: new user: name=u' || user_id || ', UID=' || event_id ELSE 'cron[1]: nothing' END""")
    return _told(_parsed("authlog", _text(_events(spark, d), F.lit("/[root]/var/log/auth.log"), F.col("event_id"), F.concat(_short_time(), F.lit(" box "), said)), ZONE))


@register("parse_history", f"""WITH {EVENTS} SELECT 'shell_history' AS artifact_type, '[' || CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'root' END || '] run ' || event_id AS description,
CASE WHEN k % 3 < 2 THEN {_utc("date_trunc('second', ts)")} END AS timestamp_utc FROM e""")
def parse_history(spark, d):
    """Events as commands of their users: dated by a marker line before, by the line itself, or not at all."""
    lines = F.expr("""CASE k % 3 WHEN 0 THEN array('#' || unix_seconds(ts), 'run ' || event_id) WHEN 1 THEN array(': ' || unix_seconds(ts) || ':0;run ' || event_id) ELSE array('run ' || event_id) END""")
    path = F.expr("CASE WHEN user_id % 2 = 0 THEN '/cases/home/analyst/[root]/home/u' || user_id || '/.bash_history' ELSE '/cases/home/analyst/[root]/root/' || user_id || '/.zsh_history' END")
    one = _events(spark, d).select(path.alias("path"), "event_id", F.posexplode(lines).alias("at", "line"))
    return _told(_parsed("history", _text(one, F.col("path"), F.struct("event_id", "at"), F.col("line"))))


@register("parse_auditd", f"""WITH {EVENTS} SELECT 'auditd' AS artifact_type, CASE WHEN k % 2 = 0 THEN '[EXECVE] auid=' || user_id || ' curl -s http://x/' || event_id ELSE '[SYSCALL] uid=' || k || ' /usr/bin/curl' || event_id END AS description,
{_utc("date_trunc('millisecond', ts)")} AS timestamp_utc, CASE WHEN k % 2 = 0 THEN 'EXECVE,PATH,SYSCALL' ELSE 'SYSCALL' END AS types, CAST(k AS VARCHAR) AS uid FROM e""")
def parse_auditd(spark, d):
    """Events as audit records of one to three lines, which share a serial."""
    head = lambda kind: f"'type={kind} msg=audit(' || unix_seconds(ts) || '.' || date_format(ts, 'SSS') || ':' || event_id || '): '"
    call = f"{head('SYSCALL')} || 'auid=' || CASE WHEN k % 2 = 0 THEN user_id ELSE 4294967295 END || ' uid=' || k || ' comm=\"curl\" exe=\"/usr/bin/curl' || event_id || '\"'"
    more = f"array({head('EXECVE')} || 'argc=3 a0=\"curl\" a1=\"-s\" a2=\"http://x/' || event_id || '\"', {head('PATH')} || 'name=\"/usr/bin/curl\" uid=7')"
    lines = F.expr(f"CASE WHEN k % 2 = 0 THEN concat(array({call}), {more}) ELSE array({call}) END")
    one = _events(spark, d).select("event_id", F.posexplode(lines).alias("at", "line"))
    got = _parsed("auditd", _text(one, F.lit("/[root]/var/log/audit/audit.log"), F.struct("event_id", "at"), F.col("line")))
    return got.select("artifact_type", "description", "timestamp_utc", F.get_json_object("raw_data", "$.types").alias("types"), F.get_json_object("raw_data", "$.uid").alias("uid"))


@register("parse_packages", f"""WITH {EVENTS} SELECT 'package_event' AS artifact_type, '[dpkg] ' || CASE WHEN k < 50 THEN 'install' ELSE 'remove' END || ' p' || event_id || ' <none> ' || k AS description, {_utc("date_trunc('second', ts)")} AS timestamp_utc FROM e WHERE k < 90
UNION ALL SELECT 'package_event', '[yum] Installed p' || event_id, {_no_year(False)} FROM e
UNION ALL SELECT 'package_event', '[apt] apt ' || o_orderkey || ' by=' || CASE WHEN o_custkey % 2 = 0 THEN 'root' ELSE 'c' || o_custkey END || ' Install: p' || o_orderkey || '; Remove: last', {_utc("o_orderdate")} FROM orders""")
def parse_packages(spark, d):
    """Events as lines of two package managers, orders as blocks of a third, in which a key's last value counts."""
    e = _events(spark, d)
    dpkg = F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss') || CASE WHEN k < 50 THEN ' install' WHEN k < 90 THEN ' remove' ELSE ' status' END || ' p' || event_id || ' <none>  ' || k")
    block = F.expr("""array('Start-Date: ' || date_format(o_orderdate, 'yyyy-MM-dd  HH:mm:ss'), 'Commandline: apt ' || o_orderkey, 'Install: p' || o_orderkey, 'Remove: first', CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'Requested-By: c' || o_custkey END, 'Remove: last', 'End-Date: x')""")
    apt = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.posexplode(block).alias("at", "line"))
    one = _parsed("dpkg", _text(e, F.lit("/[root]/var/log/dpkg.log"), F.col("event_id"), dpkg))
    two = _parsed("yum", _text(e, F.lit("/[root]/var/log/yum.log"), F.col("event_id"), F.concat(_short_time(), F.expr("' Installed: p' || event_id"))))
    three = _parsed("apt", _text(apt, F.expr("'/[root]/var/log/apt/history.log.' || o_custkey"), F.struct("o_orderkey", "at"), F.col("line")))
    return _told(one.unionByName(two).unionByName(three))


@register("parse_journal", f"""WITH {EVENTS} SELECT 'journal' AS artifact_type, CASE WHEN k % 2 = 0 THEN '[u' || user_id || '.service] did ' || event_id ELSE '[sshd] hello: ' || event_id END AS description,
CASE WHEN k % 2 = 0 THEN {_utc("ts")} ELSE {_no_year(True)} END AS timestamp_utc FROM e""")
def parse_journal(spark, d):
    """Events as journal lines: JSON, whose time is UTC, or short ones in the host's zone."""
    line = F.expr("""CASE WHEN k % 2 = 0 THEN to_json(named_struct('__REALTIME_TIMESTAMP', CAST(unix_micros(ts) AS STRING), '_SYSTEMD_UNIT', 'u' || user_id || '.service', 'MESSAGE', 'did ' || event_id))
        ELSE date_format(ts, 'MMM d HH:mm:ss') || ' box sshd[9]: hello: ' || event_id END""")
    return _told(_parsed("journal", _text(_events(spark, d), F.lit("/live_response/journal.txt"), F.col("event_id"), line), ZONE))


@register("parse_bodyfile", f"""WITH {EVENTS} SELECT 'file_entry' AS artifact_type, '/etc/f' || event_id || ' (' || k || ' bytes, r/rw, uid=' || user_id || ' gid=0)' AS description,
{_utc("date_trunc('second', ts)")} AS timestamp_utc, 'modified' AS primary_ts_type, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS times FROM e""")
def parse_bodyfile(spark, d):
    """Events as files with two or three of four times; the modification stands for the file though others are earlier."""
    line = F.expr("concat_ws('|', '0', '/etc/f' || event_id, '12', 'r/rw', user_id, '0', k, unix_seconds(ts) - 100, unix_seconds(ts), '0', CASE WHEN k % 2 = 0 THEN unix_seconds(ts) + 7 ELSE 0 END)")
    got = _parsed("bodyfile", _text(_events(spark, d), F.lit("/bodyfile/b.txt"), F.col("event_id"), line))
    return got.select("artifact_type", "description", "timestamp_utc", "primary_ts_type", F.size("events").alias("times"))


@register("parse_live_response", f"""WITH {EVENTS} SELECT 'process' AS artifact_type, '[u' || user_id || '] pid=' || event_id || ' /bin/x -n ' || k AS description, '2024-03-15T10:00:00.000000Z' AS timestamp_utc FROM e
UNION ALL SELECT 'network_connection', CASE WHEN k % 2 = 0 THEN 'tcp 10.0.0.1:22 -> 9.9.' || k || '.9:' || event_id || ' users' ELSE 'udp6 10.0.0.1:53 -> 9.9.' || k || '.9:' || event_id || ' ' || user_id || '/x' END, '2024-03-15T10:00:00.000000Z' FROM e""")
def parse_live_response(spark, d):
    """Events as listed processes (two listings) and sockets (two listings), dated by the collection."""
    e = _events(spark, d)
    ps = F.expr("CASE WHEN k % 2 = 0 THEN concat_ws(' ', 'u' || user_id, event_id, '0.0 0.1 1 2 ? Ss 09:00 0:01', '/bin/x -n ' || k) ELSE concat_ws('  ', 'u' || user_id, event_id, '1 0 09:00 ? 00:00:01', '/bin/x -n ' || k) END")
    net = F.expr("CASE WHEN k % 2 = 0 THEN 'tcp ESTAB 0 0 10.0.0.1:22 9.9.' || k || '.9:' || event_id || ' users' ELSE 'udp6 0 0 10.0.0.1:53 9.9.' || k || '.9:' || event_id || ' ESTABLISHED ' || user_id || '/x' END")
    when = "2024-03-15 10:00:00"
    return _told(_parsed("ps", _text(e, F.lit("/p"), F.col("event_id"), ps), None, when).unionByName(_parsed("network", _text(e, F.lit("/n"), F.col("event_id"), net), None, when)))


# --- settings ---------------------------------------------------------------------------------------------------

@register("parse_accounts", """SELECT 'user_account' AS artifact_type, c_name || ' uid=' || c_custkey || ' gid=' || c_nationkey || ' shell=/bin/sh home=/home/' || c_custkey AS description FROM customer
UNION ALL SELECT 'ssh_authorized_key', '[c' || c_custkey || '] ' || CASE WHEN c_custkey % 2 = 0 THEN 'ssh-rsa' ELSE 'ecdsa-sha2' END || ' ' || c_name || '@x' FROM customer
UNION ALL SELECT 'cron_job', CASE WHEN c_custkey % 2 = 0 THEN '[c' || c_custkey || '] */5 * * * * -> run it' ELSE '[unknown] @daily -> run ' || c_custkey END FROM customer""")
def parse_accounts(spark, d):
    """Customers as accounts, as holders of keys (with and without options) and as owners of timed jobs (system table and their own)."""
    c = table(spark, d, "customer")
    account = F.expr("concat_ws(':', c_name, 'x', c_custkey, c_nationkey, '', '/home/' || c_custkey, '/bin/sh')")
    key = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'ssh-rsa AAAA ' ELSE 'no-pty ecdsa-sha2 AAAA ' END || c_name || '@x'")
    cron = F.expr("CASE WHEN c_custkey % 2 = 0 THEN '*/5 * * * * c' || c_custkey || ' run it' ELSE '@daily run ' || c_custkey END")
    out = [
        _parsed("passwd", _text(c, F.lit("/[root]/etc/passwd"), F.col("c_custkey"), account)),
        _parsed("keys", _text(c, F.expr("'/[root]/home/c' || c_custkey || '/.ssh/authorized_keys'"), F.col("c_custkey"), key)),
        _parsed("cron", _text(c, F.expr("CASE WHEN c_custkey % 2 = 0 THEN '/[root]/etc/crontab' ELSE '/[root]/var/spool/cron/c' || c_custkey END"), F.col("c_custkey"), cron)),
    ]
    return reduce(DataFrame.unionByName, out).select("artifact_type", "description")


_KIND = "CASE c_nationkey % 4 WHEN 0 THEN 'ld_preload' WHEN 1 THEN 'shell_startup' WHEN 2 THEN 'systemd_timer' ELSE 'config' END"


@register("parse_whole_files", f"""SELECT 'systemd_unit' AS artifact_type, 'c' || c_custkey || '.service: ExecStart=/bin/a' || c_custkey || ' (desc=' || c_name || ')' AS description FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'persistence_file', '[' || {_KIND} || '] ' || CASE c_nationkey % 4 WHEN 0 THEN 'ld.so.preload: ' WHEN 1 THEN '.bashrc: a' || c_custkey || ' ; b ; c ; d' WHEN 2 THEN 't.timer: a' || c_custkey || ' ; b ; c ; d' ELSE 'cfg: a' || c_custkey || ' ; b ; c ; d' END FROM customer
UNION ALL SELECT 'system_identity', '[hostname] box' || c_custkey FROM customer
UNION ALL SELECT 'trash_item', 'deleted /home/a b+' || c_custkey FROM customer""")
def parse_whole_files(spark, d):
    """Customers as files that mean something as a whole; a unit that starts nothing and a settings file of comments are none."""
    c = table(spark, d, "customer")

    def read(parser, path, lines):
        one = c.select(F.expr(path).alias("path"), F.posexplode(F.expr(lines)).alias("at", "line"))
        return _parsed(parser, _text(one, F.col("path"), F.col("at"), F.col("line")))

    kind = "CASE c_nationkey % 4 WHEN 0 THEN '/etc/ld.so.preload' WHEN 1 THEN '/home/x/.bashrc' WHEN 2 THEN '/lib/systemd/system/t.timer' ELSE '/etc/cfg' END"
    out = [
        read("unit", "'/' || c_custkey || '/c' || c_custkey || '.service'", "array('[Unit]', 'Description=' || c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'ExecStart=/bin/a' || c_custkey ELSE '#ExecStart=x' END, CASE WHEN c_nationkey % 2 = 0 THEN 'ExecStart=/bin/b' ELSE 'User=x' END)"),
        read("persistence", f"'/' || c_custkey || {kind}", "CASE WHEN c_nationkey % 4 = 0 THEN array('# only a remark') ELSE array('# remark', 'a' || c_custkey, ' b', 'c', 'd', 'e') END"),
        read("identity", "'/' || c_custkey || '/etc/hostname'", "array('# name', 'box' || c_custkey)"),
        read("trash", "'/' || c_custkey || '/t.trashinfo'", "array('[Trash Info]', 'Path=/home/a%20b+' || c_custkey, 'DeletionDate=2024-03-14T09:15:01')"),
    ]
    return reduce(DataFrame.unionByName, out).select("artifact_type", "description")


# --- exported tables and memory results ---------------------------------------------------------------------------

#: Family, its columns as SQL over an event, and the description that must come out.
_B = "chr(92)"
FAMILIES = [
    ("1_PECmd_Output.csv", {"ExecutableName": "'A' || event_id", "RunCount": "'' || k", "SourceFile": "'f.pf'"}, "'A' || event_id || ' ran ' || k || ' times (f.pf)'"),
    ("1_EvtxECmd_Output.csv", {"EventId": "'' || k", "Channel": "'Sys'", "Provider": "'P'", "UserName": "'u' || user_id", "Payload": "'{}'"}, "'EID ' || k || ' Sys: P user=u' || user_id"),
    ("1_MFTECmd_$J_Output.csv", {"ParentPath": "'d'", "Name": "'n' || event_id", "UpdateReasons": "'Close'"}, f"'d' || {_B} || 'n' || event_id || ': Close'"),
    ("1_MFTECmd_$MFT_Output.csv", {"ParentPath": "'d'", "FileName": "'n' || event_id"}, f"'d' || {_B} || 'n' || event_id || ' (0 bytes)'"),
    ("1_RECmd_Batch_x_Output.csv", {"KeyPath": "'K'", "ValueName": "'v'", "ValueData": "'' || event_id", "Description": "'D'"}, f"'K' || {_B} || 'v = ' || event_id || ' (D)'"),
    ("1_Amcache_UnassociatedFileEntries.csv", {"Name": "'n'", "FullPath": "'p' || event_id", "SHA1": "'s'"}, "'n (p' || event_id || ') sha1=s'"),
    ("1_UserAssist__x.csv", {"ProgramName": "'p' || event_id", "RunCounter": "'' || k"}, "'p' || event_id || ' run ' || k || ' times'"),
    ("1_TaskCache__x.csv", {"KeyName": "'t' || event_id", "Path": "'p'"}, "'Task t' || event_id || ' -> p (author=)'"),
    ("1_Services__x.csv", {"Name": "'n' || event_id", "DisplayName": "'d'", "StartMode": "'2'", "ImagePath": "'i'", "ServiceDLL": "'l'"}, "'n' || event_id || ' (d) start=2 image=i dll=l'"),
    ("1_AppCompatCache_x.csv", {"Path": "'p' || event_id"}, "'p' || event_id || ' executed=?'"),
    ("1_BamDam__x.csv", {"Path": "'p' || event_id", "SID": "'S-1'"}, "'p' || event_id || ' user=S-1'"),
    ("1_LECmd_Output.csv", {"SourceFile": "'s'", "NetworkPath": "'n' || event_id", "Arguments": "'-a'", "VolumeSerialNumber": "'9'"}, "'s -> n' || event_id || ' -a vol=9'"),
    ("1_AutomaticDestinations.csv", {"AppId": "'id'", "LocalPath": "'l' || event_id"}, "'[id] l' || event_id"),
    ("1_UsrClass.csv", {"AbsolutePath": "'a' || event_id", "ShellType": "'Dir'"}, "'a' || event_id || ' (Dir)'"),
    ("1_RBCmd_Output.csv", {"FileName": "'f' || event_id", "FileSize": "'' || k"}, "'deleted f' || event_id || ' (' || k || ' bytes)'"),
    ("1_SrumECmd_NetworkUsages_Output.csv", {"AppId": "'a' || event_id", "UserName": "'u'", "BytesSent": "'' || k"}, "'a' || event_id || ' user=u sent=' || k || ' recv=0'"),
    ("1_Activity.csv", {"Executable": "'x' || event_id", "Payload": "'pay'"}, "'x' || event_id || ': pay'"),
]
PLUGINS = [
    ("pslist", {"ImageFileName": "'a.exe'", "PID": "'' || event_id", "PPID": "'4'"}, "'[pslist] a.exe pid=' || event_id || ' ppid=4 threads='"),
    ("psscan", {"ImageFileName": "'a.exe'", "PID": "'' || event_id", "PPID": "'4'"}, "'[psscan] a.exe pid=' || event_id || ' ppid=4'"),
    ("pstree", {"ImageFileName": "'a.exe'", "PID": "'' || event_id", "PPID": "'4'"}, "'[pstree] a.exe pid=' || event_id || ' ppid=4'"),
    ("netscan", {"Owner": "'o'", "PID": "'' || event_id", "LocalAddr": "'l'", "LocalPort": "'1'", "ForeignAddr": "'f'", "ForeignPort": "'2'", "State": "'UP'"}, "'o pid=' || event_id || ' l:1 -> f:2 [UP]'"),
    ("cmdline", {"Process": "'p'", "PID": "'' || event_id", "Args": "'-a'"}, "'p pid=' || event_id || ': -a'"),
    ("malfind", {"Process": "'p'", "PID": "'' || event_id", "Start VPN": "'5'", "Protection": "'RWX'", "Hexdump": "CASE WHEN k % 2 = 0 THEN '4d 5a 90' ELSE '00 4d' END"}, "'injected region in p pid=' || event_id || ' at 5 prot=RWX' || CASE WHEN k % 2 = 0 THEN ' [MZ HEADER]' ELSE '' END"),
    ("svcscan", {"Name": "'n' || event_id", "State": "'UP'", "Binary": "'b'"}, "'service n' || event_id || ' state=UP binary=b'"),
    ("yarascan", {"Rule": "'R'", "Process": "'p'", "PID": "'' || event_id", "Offset": "'7'"}, "'YARA R in p pid=' || event_id || ' at 7'"),
    ("linux_pslist", {"COMM": "'c'", "PID": "'' || event_id", "PPID": "'1'", "EUID": "'0'"}, "'[pslist] c pid=' || event_id || ' ppid=1 uid=0'"),
    ("linux_psscan", {"Name": "'c'", "PID": "'' || event_id", "PPID": "'1'"}, "'[psscan] c pid=' || event_id || ' ppid=1'"),
    ("linux_pstree", {"COMM": "'c'", "PID": "'' || event_id", "PPID": "'1'"}, "'[pstree] c pid=' || event_id || ' ppid=1'"),
    ("linux_psaux", {"COMM": "'c'", "PID": "'' || event_id"}, "'c pid=' || event_id || ': (no arguments)'"),
    ("linux_bash", {"Process": "'bash'", "PID": "'' || event_id", "Command": "'ls'"}, "'[bash pid=' || event_id || '] ls'"),
    ("linux_envars", {"COMM": "'c'", "PID": "'' || event_id", "Key": "CASE WHEN k % 2 = 0 THEN 'ld_preload' ELSE 'PATH' END", "Value": "'v'"}, "'c pid=' || event_id || CASE WHEN k % 2 = 0 THEN ': ld_preload=v [PRELOAD]' ELSE ': PATH=v' END"),
    ("linux_library_list", {"Name": "'c'", "PID": "'' || event_id", "Path": "'/l.so'"}, "'c pid=' || event_id || ' loaded /l.so'"),
    ("linux_lsof", {"COMM": "'c'", "PID": "'' || event_id", "FD": "'3'", "Path": "'/f'"}, "'c pid=' || event_id || ' fd=3 /f'"),
    ("linux_sockstat", {"COMM": "'c'", "PID": "'' || event_id", "Proto": "'TCP'", "Source Addr": "'s'", "Source Port": "'1'", "RemoteAddr": "'r'", "RemotePort": "'2'", "State": "'UP'"}, "'c pid=' || event_id || ' TCP s:1 -> r:2 [UP]'"),
    ("linux_lsmod", {"Name": "'m' || event_id", "Size": "'8'", "Address": "'x'"}, "'module m' || event_id || ' size=8 offset=x'"),
    ("linux_malfind", {"Process": "'p'", "PID": "'' || event_id", "Start": "'5'", "Protection": "'RWX'", "Hexdump": "CASE WHEN k % 2 = 0 THEN '7f 45 4C 46 02' ELSE '4d 5a' END"}, "'injected region in p pid=' || event_id || ' at 5 prot=RWX' || CASE WHEN k % 2 = 0 THEN ' [ELF HEADER]' ELSE '' END"),
    ("linux_hidden_modules", {"Name": "'m' || event_id", "Address": "'x'"}, "'HIDDEN kernel module m' || event_id || ' at x size='"),
    ("linux_check_syscall", {"Index": "'' || event_id", "Table": "'64'", "Symbol": "'s'", "Address": "'x'"}, "'syscall ' || event_id || ' in 64 -> s @x'"),
    ("linux_netfilter", {"Symbol": "'s' || event_id", "Proto": "'IP'", "Hook": "'IN'", "Handler": "'x'"}, "'netfilter hook s' || event_id || ' proto=IP hook=IN @x'"),
    ("linux_tty_check", {"Name": "'t' || event_id", "Symbol": "'s'", "Address": "'x'"}, "'tty hook t' || event_id || ' -> s @x'"),
    ("linux_process_spoofing", {"PID": "'' || event_id", "Command Line": "'a'", "Path": "'/b'"}, "'process spoofing: pid=' || event_id || ' argv0=a real=/b'"),
    ("linux_ebpf", {"Name": "'e' || event_id", "Type": "'kprobe'", "Address": "'x'"}, "'eBPF program e' || event_id || ' type=kprobe @x'"),
    ("linux_check_ftrace", {"Symbol": "'s' || event_id", "Callback": "'c'", "Module": "'m'"}, "'ftrace hook on s' || event_id || ' -> c module=m'"),
    ("linux_mountinfo", {"Device": "'d' || event_id", "Path": "'/m'", "Type": "'ext4'", "Options": "'rw'"}, "'d' || event_id || ' on /m type=ext4 opts=rw'"),
]


def _by_specs(spark, d, entries, spec_of) -> DataFrame:
    """Every event as one row of the entry that its number deals it to."""
    e = _events(spark, d).withColumn("entry", F.col("event_id") % len(entries))
    out = []
    for i, (name, columns, _) in enumerate(entries):
        raw = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.expr(x) for x in columns.values()]))
        out.append(records.build(tabular.by_spec(e.where(F.col("entry") == i).select(*[F.lit(x).alias(c) for c, x in (("case_id", "case-a"), ("source_id", "s1"), ("host", "h"), ("source", "tables"))], raw.alias("raw")), spec_of(name))))
    return reduce(DataFrame.unionByName, out).select("artifact_type", "description")


def _specs_sql(entries, spec_of) -> str:
    kind = lambda n: "registry_unknown" if spec_of(n).type == "registry" else spec_of(n).type
    return f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{kind(n)}' AS artifact_type, {said} AS description FROM e WHERE event_id % {len(entries)} = {i}" for i, (n, _, said) in enumerate(entries))


def _family(name: str) -> tabular.Spec:
    return tabular.spec_for(name, include_mft=True)


@register("csv_families", _specs_sql(FAMILIES, _family))
def csv_families(spark, d):
    """Events dealt to the 17 families of exported tables."""
    return _by_specs(spark, d, FAMILIES, _family)


@register("memory_plugins", _specs_sql(PLUGINS, tabular.MEMORY_SPECS.__getitem__))
def memory_plugins(spark, d):
    """Events dealt to the 27 kinds of memory results."""
    return _by_specs(spark, d, PLUGINS, tabular.MEMORY_SPECS.__getitem__)


@register("generic_table", f"""WITH {EVENTS} SELECT 'unparsed_odd' AS artifact_type, CASE WHEN k % 2 = 0 THEN 'Name=n' || event_id || ', Path=p, UserName=u' || user_id ELSE 'Name=n' || event_id || ', Path=p, Weird=w, CreatedOn=' || strftime(ts, '%Y-%m-%d %H:%M:%S') END AS description,
{_utc("date_trunc('second', ts)")} AS timestamp_utc, 'createdon' AS primary_ts_type FROM e""")
def generic_table(spark, d):
    """Events as rows of a table that no family knows; with fewer than three telling values the first columns speak."""
    columns = {"Name": "'n' || event_id", "Path": "'p'", "Weird": "'w'", "CreatedOn": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "UserName": "CASE WHEN k % 2 = 0 THEN 'u' || user_id ELSE '' END"}
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.expr(x) for x in columns.values()]))
    rows = _events(spark, d).select(*[F.lit(x).alias(c) for c, x in (("case_id", "case-a"), ("source_id", "s1"), ("host", "h"), ("source", "tables"))], raw.alias("raw"))
    return records.build(tabular.generic(rows, "20240101000000_Odd_Output.csv", list(columns))).select("artifact_type", "description", "timestamp_utc", "primary_ts_type")


@register("payload_flatten", f"WITH {EVENTS} SELECT event_id, 'C:/a' || event_id AS image, 'u' || user_id AS the_user, 'pc' || k AS computer, 'first' AS twice, NULL AS deep FROM e")
def payload_flatten(spark, d):
    """Events as log payloads: named data, a named single value, scalars; a key's first part wins, nested values fall away."""
    text = F.expr("""to_json(named_struct('EventData', named_struct('Data', array(map('@Name', 'Image', '#text', 'C:/a' || event_id), map('@Name', 'Twice', '#text', 'first'))),
        'UserData', named_struct('Data', map('@Name', 'Who', '#text', 'u' || user_id), 'Twice', 'second'), 'System', named_struct('Computer', 'pc' || k, 'Deep', named_struct('x', 1))))""")
    p = F.col("p")
    return _events(spark, d).withColumn("p", tabular.payload(text)).select("event_id", p["Image"].alias("image"), p["Who"].alias("the_user"), p["Computer"].alias("computer"), p["Twice"].alias("twice"), p["Deep"].alias("deep"))


@register("timestomp_flags", f"WITH {EVENTS} SELECT event_id, k < 50 OR k % 10 = 0 AS si_lt_fn, k % 3 = 0 AS usec_zeros FROM e")
def timestomp_flags(spark, d):
    """Events as file records: the standard time before the name's time, or the tool's own flag."""
    columns = {"ParentPath": "'d'", "FileName": "'' || event_id", "Created0x10": "'2024-01-' || lpad(k, 3, '0')", "Created0x30": "'2024-01-050'", "SI<FN": "CASE WHEN k % 10 = 0 THEN 'True' ELSE 'False' END", "uSecZeros": "CASE WHEN k % 3 = 0 THEN ' YES ' ELSE '' END"}
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.expr(x) for x in columns.values()]))
    rows = _events(spark, d).select("event_id", *[F.lit(x).alias(c) for c, x in (("case_id", "case-a"), ("source_id", "s1"), ("host", "h"), ("source", "tables"))], raw.alias("raw"))
    flag = lambda n: F.get_json_object("enrich", f"$.{n}").cast("boolean").alias(n)
    return tabular.by_spec(rows, _family("1_MFTECmd_$MFT_Output.csv")).select("event_id", flag("si_lt_fn"), flag("usec_zeros"))


@register("registry_kind", f"WITH {EVENTS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'registry_run' WHEN 1 THEN 'registry_user_' || event_type ELSE 'registry_unknown' END AS kind FROM e")
def registry_kind(spark, d):
    raw = F.expr(r"CASE k % 3 WHEN 0 THEN map('KeyPath', '', 'BatchKeyPath', 'HKLM\\CurrentVersion\\RunOnce', 'Category', 'x') WHEN 1 THEN map('KeyPath', 'HKLM', 'Category', 'User ' || event_type) ELSE map('KeyPath', 'HKLM', 'Category', '') END")
    return _events(spark, d).withColumn("raw", raw).select("event_id", tabular.registry_type().alias("kind"))


@register("epoch_decode", f"""WITH {EVENTS} SELECT event_id, CASE WHEN k > 5 THEN {_utc("ts")} END AS webkit, CASE WHEN k > 5 THEN {_utc("ts")} END AS firefox, CASE WHEN k > 5 THEN {_utc("date_trunc('second', ts)")} END AS unix, {_utc("ts - INTERVAL 330 MINUTE")} AS moved FROM e""")
def epoch_decode(spark, d):
    """Browser, file and local times of every event; values of 0 and below are no times."""
    value = lambda c: F.when(F.col("k") > 5, c).otherwise(F.lit(0) - F.col("k"))
    micros = F.unix_micros("ts")
    return _events(spark, d).select("event_id", fn.webkit_time(value(micros + F.lit(11_644_473_600_000_000))).alias("webkit"), fn.unix_micros_time(value(micros)).alias("firefox"), fn.epoch_time(value(F.unix_seconds("ts")).cast("string")).alias("unix"), fn.local_to_utc(fn.canonical(F.col("ts")), F.lit(ZONE)).alias("moved"))


@register("labelled_hashes", "SELECT doc_id, kind, value FROM (SELECT doc_id, unnest(['md5', 'sha256']) AS kind, unnest([md5(coalesce(text, '')), sha256(coalesce(text, ''))]) AS value FROM documents)")
def labelled_hashes(spark, d):
    """Digests of every document as one labelled text; IMPHASH is no file hash and a repeated one counts once."""
    text = F.coalesce("text", F.lit(""))
    blob = F.concat(F.lit("MD5="), F.upper(F.md5(text)), F.lit(",SHA256="), F.sha2(text, 256), F.lit(",IMPHASH="), F.md5(text), F.lit(', md5 ="'), F.md5(text), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", F.explode(fn.labelled_hashes(blob)).alias("h")).select("doc_id", "h.kind", "h.value")


@register("path_parts", "SELECT page_id, 'p' || page_id || '.exe' AS base, 'p' || page_id AS leaf, CASE WHEN page_id % 3 = 0 THEN 'root' WHEN page_id % 3 = 1 THEN 'u' || page_id ELSE 'unknown' END AS owner, CASE WHEN page_id % 2 = 0 THEN 'b' ELSE '' END AS filled FROM pages")
def path_parts(spark, d):
    page = F.col("page_id")
    path = F.expr(r"CASE page_id % 2 WHEN 0 THEN '\"C:\\x y\\' ELSE '\"/usr/bin/' END || 'p' || page_id || '.exe'")
    whose = F.expr("'/home/analyst/case/[root]' || CASE page_id % 3 WHEN 0 THEN '/root/.bashrc' WHEN 1 THEN '/home/u' || page_id || '/.bashrc' ELSE '/etc/x' END")
    return table(spark, d, "pages").select("page_id", fn.basename(path).alias("base"), fn.binary_leaf(F.concat(path, F.lit('" -k run'))).alias("leaf"), linux_text.owner(whose).alias("owner"), fn.first_filled(F.lit(None).cast("string"), F.lit(""), F.when(page % 2 == 0, "b")).alias("filled"))


# --- correlation and store ------------------------------------------------------------------------------------------

@register("download_execute_c001", f"""WITH {EVENTS}, h AS (SELECT *, user_id % 7 AS host FROM e), m AS (SELECT l.event_id, l.ts, l.k, arg_min(r.ts, struct_pack(a := r.ts, b := CAST(r.event_id AS VARCHAR))) AS got FROM h l JOIN h r ON l.host = r.host AND l.k % 3 = r.k % 3 AND r.ts <= l.ts AND l.ts - r.ts <= INTERVAL 60 MINUTE WHERE l.event_type = 'purchase' AND r.event_type = 'click' GROUP BY ALL)
SELECT CAST(event_id AS VARCHAR) AS artifact_id, 'downloaded tool-' || k % 3 || '.exe at ' || {_utc("got")} || ', executed at ' || {_utc("ts")} || ' (+' || CAST(floor((epoch_us(ts) - epoch_us(got)) / 60000000) AS BIGINT) || ' min)' AS matched_on FROM m""")
def download_execute_c001(spark, d):
    """Clicks as downloads, purchases as executions of one of three tools, on the same host within the hour."""
    raw = F.expr(r"CASE event_type WHEN 'click' THEN to_json(named_struct('path', 'C:\\d\\Tool-' || k % 3 || '.exe.crdownload')) ELSE '{}' END")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'browser_download' WHEN 'purchase' THEN 'prefetch_execution' ELSE event_type END")
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), (F.col("user_id") % 7).cast("string").alias("host"), kind.alias("artifact_type"), F.expr("'TOOL-' || k % 3 || '.EXE ran'").alias("description"), fn.canonical(F.col("ts")).alias("timestamp_utc"), raw.alias("raw_data"))
    return correlate.download_then_execute(rows).select("artifact_id", "matched_on")


@register("insert_detections", "SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, substr(o_orderpriority, 1, 1) AS rule_id, min(o_orderstatus) AS matched_on FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0) GROUP BY ALL")
def insert_detections(spark, d):
    """Orders as detections; those of even customers are stored already, once and again the first writer wins."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.lit("rules").alias("engine"), F.col("o_orderstatus").alias("matched_on"), "o_custkey")
    old, new = o.where("o_custkey % 2 = 0"), o.where("o_custkey % 2 = 1")
    again = new.withColumn("matched_on", F.concat("matched_on", F.lit("+")))
    return store.insert_detections(old, new.unionByName(again).unionByName(old)).select("artifact_id", "rule_id", "matched_on")


@register("clear_source", "SELECT 'artifact' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'detection', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 2 = 0")
def clear_source(spark, d):
    """Orders as artifacts, of the source that their status names, and detections on those of even customers; source F goes."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.col("o_orderstatus").alias("source_id"), "o_custkey")
    left, found = store.clear_source(o.drop("o_custkey"), o.where("o_custkey % 2 = 0").select("artifact_id"), "F")
    tally = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return tally(left, "artifact").unionByName(tally(found, "detection"))


@register("unread_times", f"WITH {EVENTS} SELECT event_type AS label, count(*) AS n FROM e WHERE k >= 90 GROUP BY 1")
def unread_times(spark, d):
    """Times that no format reads, by their label; sentinels and missing times are none."""
    value = F.expr("CASE WHEN k >= 90 THEN k || '/03/2024 noon' WHEN k < 10 THEN 'n/a' WHEN k < 20 THEN NULL ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END")
    return records.unread_stamps(_events(spark, d).select(F.array(F.struct(F.col("event_type").alias("label"), value.alias("value"))).alias("stamps")))


@register("cluster_identity", "SELECT 'guid:g' || o_custkey AS key, CAST(count(DISTINCT substr(o_orderpriority, 1, 1)) AS INT) AS rules FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 'pid:' || o_custkey, CAST(count(DISTINCT substr(o_orderpriority, 1, 1)) AS INT) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def cluster_identity(spark, d):
    """Orders as detections on processes known by a GUID (status F) or by a number only."""
    o = table(spark, d, "orders")
    raw = F.expr("CASE WHEN o_orderstatus = 'F' THEN to_json(named_struct('_enrich', named_struct('payload', named_struct('ProcessGuid', 'g' || o_custkey, 'Image', 'a.exe')))) ELSE to_json(named_struct('PID', o_custkey, 'COMM', 'x')) END")
    key = F.concat("o_orderkey", F.lit("-"), "o_custkey")
    a = o.select(key.alias("artifact_id"), F.lit("h").alias("host"), F.when(F.col("o_orderstatus") == "F", "event_log").otherwise("memory_process").alias("artifact_type"), F.lit("t").alias("timestamp_utc"), raw.alias("raw_data"))
    found = o.select(key.alias("artifact_id"), F.lit("case-a").alias("case_id"), F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.lit("low").alias("severity"), F.lit(1).alias("score"), F.array().cast("array<string>").alias("attack"))
    return cluster.clusters(found, a).select("key", F.col("rule_count").cast("int").alias("rules"))
