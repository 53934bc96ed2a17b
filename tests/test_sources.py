import json
import os
import sqlite3
import tarfile

import pytest
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.operators import cluster, correlate, ioc, store
from tracelake.sources import containers, linux_text, manifest, records, tabular

HASH = "ab" * 32


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(path, (1710500000, 1710500000))  # 2024-03-15
    return str(path)


def by_type(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["artifact_type"], []).append(r)
    return out


@pytest.mark.parametrize(("text", "want"), [
    ("2024-03-14 09:15:01.1234567", "2024-03-14T09:15:01.123456Z"), ("2024-03-14T09:15:01Z", "2024-03-14T09:15:01.000000Z"), ("2024-03-14 09:15:01+0530", "2024-03-14T03:45:01.000000Z"), ("2024-03-14", "2024-03-14T00:00:00.000000Z"),
    ("1601-01-01 00:00:00", None), ("03/04/2024", None), ("", None), (None, None), ("n/a", None), ("2999-01-01 00:00:00", None), ("2024-13-01 00:00:00", None),
])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.normalize_timestamp(F.col("t"))).first()[0] == want


def test_csv_families(spark, tmp_path):
    root = str(tmp_path / "t")
    put(f"{root}/1_PECmd_Output.csv", "﻿ExecutableName,RunCount,SourceFilename,LastRun,SourceCreated\nA.EXE,3,C:\\p\\A.pf,2024-03-14 09:00:00.0000000,2024-03-13 00:00:00\n,,,,\n")
    payload = json.dumps({"EventData": {"Data": [{"@Name": "Image", "#text": "C:\\a.exe"}, {"@Name": "Hashes", "#text": f"MD5={'a' * 32},SHA256={HASH},IMPHASH={'b' * 32}"}]}, "System": {"Computer": "pc", "Deep": {"x": 1}}})
    put(f"{root}/2_EvtxECmd_Output.csv", 'EventId,Channel,MapDescription,Provider,UserName,TimeCreated,Payload\n1,Sysmon,,Prov,me,2024-03-14 10:00:00,"' + payload.replace('"', '""') + '"\n')
    put(f"{root}/3_RECmd_Batch_x_Output.csv", "KeyPath,ValueName,ValueData,Category,LastWriteTimestamp\nHKLM\\CurrentVersion\\Run,v,d,Autoruns,2024-01-01 00:00:00\nHKLM\\x,v,d,User Activity,2024-01-01 00:00:00\n")
    put(f"{root}/4_Odd_Output.csv", "Name,Weird,CreatedOn\nn1,w,2024-02-02 02:02:02\n")
    put(f"{root}/5_FileExts__x.csv", "a\n1\n")
    got = by_type(tabular.ingest_csv_folder(spark, root, "c", "h", "s"))
    assert sorted(got) == ["event_log", "prefetch_execution", "registry_run", "registry_user_activity", "unparsed_4_odd"]
    p = next(r for r in got["prefetch_execution"] if "A.EXE" in r["description"])
    assert p["description"] == "A.EXE ran 3 times (C:\\p\\A.pf)" and p["timestamp_utc"] == "2024-03-14T09:00:00.000000Z" and len(p["events"]) == 2
    e = got["event_log"][0]
    assert e["description"] == "EID 1 Sysmon: Prov user=me"
    assert json.loads(e["raw_data"])["_enrich"]["payload"] == {"Image": "C:\\a.exe", "Hashes": f"MD5={'a' * 32},SHA256={HASH},IMPHASH={'b' * 32}", "Computer": "pc"}
    assert got["unparsed_4_odd"][0]["description"] == "Name=n1, Weird=w, CreatedOn=2024-02-02 02:02:02"
    assert tabular.spec_for("x_MFTECmd_$MFT_Output.csv") == "skip" and tabular.spec_for("x_MFTECmd_$MFT_Output.csv", True).type == "mft_file"


def test_memory_results_and_correlation(spark, tmp_path):
    procs = [(4, 0, "System"), (400, 4, "smss.exe"), (500, 400, "wininit.exe"), (600, 500, "services.exe"), (700, 500, "lsass.exe"), (701, 999, "lsass.exe"), (800, 700, "svchost.exe")]
    files = {
        "pslist": put(str(tmp_path / "pslist.json"), json.dumps([{"PID": p, "PPID": q, "ImageFileName": n, "Threads": 1, "CreateTime": "2024-03-14T09:00:00"} for p, q, n in procs])),
        "psscan": put(str(tmp_path / "psscan.json"), json.dumps([{"PID": p, "PPID": 4, "ImageFileName": "x.exe"} for p in (4, 1234)])),
        "svcscan": put(str(tmp_path / "svcscan.json"), json.dumps([{"Name": "a", "Binary": "C:\\x\\bad.exe -k", "Binary (Registry)": "C:\\x\\good.exe"}, {"Name": "b", "Binary": "\\Driver\\b", "Binary (Registry)": "b.sys"}, {"Name": "c", "Binary": '"C:\\y\\s.exe"', "Binary (Registry)": "D:\\z\\S.EXE -a"}])),
        "malfind": put(str(tmp_path / "malfind.json"), json.dumps([{"Process": "p", "PID": 1, "Start VPN": 5, "Protection": "RWX", "Hexdump": "\n4d 5a 90"}])),
    }
    a = tabular.ingest_memory(spark, files, "c", "h", "s", acquired="2024-03-14 12:00:00").cache()
    got = by_type(a)
    assert got["memory_injection"][0]["description"].endswith("[MZ HEADER]") and got["memory_injection"][0]["primary_ts_type"] == "acquired"
    none = spark.createDataFrame([], "artifact_id string, case_id string, engine string, rule_id string, rule_title string, severity string, score int, attack array<string>, matched_on string")
    found = sorted((r["rule_id"], r["matched_on"]) for r in correlate.run_all(a, none).collect())
    assert [f[0] for f in found] == ["C002", "C005", "C005", "C006", "C006", "C007", "C008"] or [f[0] for f in found] == ["C002", "C005", "C005", "C006", "C007", "C008"]
    assert any("pid=1234" in m for r, m in found if r == "C002") and any("started by lsass.exe" in m for r, m in found if r == "C006") and any("bad.exe" in m for r, m in found if r == "C008")


def test_linux_collection(spark, tmp_path):
    root = str(tmp_path / "col")
    put(f"{root}/bodyfile/body.txt", "0|/etc/x|12|r/rw|0|0|10|1710400000|1710400001|0|1710400002\nshort|line\n")
    put(f"{root}/[root]/var/log/auth.log", "Mar 14 09:15:01 box sshd[1]: Accepted password for bob from 1.2.3.4\nDec 31 23:59:59 box sudo:  bob : TTY=x ; COMMAND=/bin/sh\n2024-03-14T09:15:01+02:00 box sshd: Failed password for invalid user eve from 5.6.7.8\nMar 14 00:00:00 box cron: nothing\n")
    put(f"{root}/[root]/home/bob/.bash_history", "ls\n#1710403200\nwhoami\n: 1710403300:0;id\n")
    put(f"{root}/[root]/etc/crontab", "# c\n*/5 * * * * root /bin/x -a\n@reboot bob /y\n")
    put(f"{root}/[root]/etc/systemd/system/a.service", "[Unit]\nDescription=D\n[Service]\nExecStart=/bin/a\nExecStart=/bin/b\n")
    put(f"{root}/[root]/home/bob/.ssh/authorized_keys", "ssh-rsa AAAA bob@x\n")
    put(f"{root}/[root]/etc/passwd", "root:x:0:0:r:/root:/bin/bash\n")
    put(f"{root}/live_response/process/ps_aux.txt", "USER PID %CPU\nroot 1 0.0 0.1 1 2 ? Ss 09:00 0:01 /sbin/init splash\n")
    put(f"{root}/live_response/network/ss_-a.txt", "tcp ESTAB 0 0 10.0.0.1:22 9.9.9.9:55 users\n")
    put(f"{root}/[root]/var/log/audit/audit.log", 'type=SYSCALL msg=audit(1710403200.123:456): auid=1000 uid=0 comm="curl" exe="/usr/bin/curl"\ntype=EXECVE msg=audit(1710403200.123:456): argc=3 a0="curl" a1="-s" a2="http://x"\ntype=PATH msg=audit(1710403200.123:456): name="/usr/bin/curl" uid=7\n')
    put(f"{root}/[root]/var/log/dpkg.log", "2024-03-14 09:15:01 install curl:amd64 <none> 7.8\n2024-03-14 09:15:02 status installed x\n")
    put(f"{root}/[root]/var/log/apt/history.log", "\nStart-Date: 2024-03-14  09:15:01\nCommandline: apt install x\nInstall: x:amd64\nEnd-Date: 2024-03-14  09:15:05\n\nStart-Date: 2024-03-15  09:15:01\nRequested-By: bob\nRemove: y\n")
    put(f"{root}/[root]/var/log/yum.log", "Mar 14 09:15:01 Installed: curl-7\n")
    put(f"{root}/live_response/journal.txt", '{"__REALTIME_TIMESTAMP":"1710403200000000","_SYSTEMD_UNIT":"u","MESSAGE":"m"}\nMar 14 09:15:01 box sshd[9]: hello\n')
    put(f"{root}/[root]/etc/ld.so.preload", "")
    put(f"{root}/[root]/etc/rc.local", "# only\n")
    put(f"{root}/[root]/etc/hostname", "box\n")
    put(f"{root}/[root]/etc/timezone", "Europe/Paris\n")
    put(f"{root}/[root]/home/bob/.local/share/Trash/info/a.trashinfo", "[Trash Info]\nPath=/home/bob/a%20b+c\nDeletionDate=2024-03-14T09:15:01\n")
    put(f"{root}/strange.bin", "x")
    df, unknown = linux_text.ingest_collection(spark, root, "c", "h", "s", collected="2024-03-15 10:00:00")
    got = by_type(df)
    text = {k: sorted(r["description"] for r in v) for k, v in got.items()}
    assert unknown == ["strange.bin"]
    assert text["file_entry"] == ["/etc/x (10 bytes, r/rw, uid=0 gid=0)"] and got["file_entry"][0]["timestamp_utc"] == "2024-03-14T07:06:41.000000Z" and len(got["file_entry"][0]["events"]) == 3
    times = {r["description"].split("]")[0]: r["timestamp_utc"] for r in got["auth_log"]}
    assert times == {"[ssh_login_success": "2024-03-14T08:15:01.000000Z", "[sudo_command": "2023-12-31T22:59:59.000000Z", "[ssh_login_failure": "2024-03-14T07:15:01.000000Z"}
    assert {(r["description"], r["timestamp_utc"]) for r in got["shell_history"]} == {("[bob] ls", None), ("[bob] whoami", "2024-03-14T08:00:00.000000Z"), ("[bob] id", "2024-03-14T08:01:40.000000Z")}
    assert text["cron_job"] == ["[bob] @reboot -> /y", "[root] */5 * * * * -> /bin/x -a"]
    assert text["systemd_unit"] == ["a.service: ExecStart=/bin/a (desc=D)"] and text["ssh_authorized_key"] == ["[bob] ssh-rsa bob@x"] and text["user_account"] == ["root uid=0 gid=0 shell=/bin/bash home=/root"]
    assert text["process"] == ["[root] pid=1 /sbin/init splash"] and text["network_connection"] == ["tcp 10.0.0.1:22 -> 9.9.9.9:55 users"]
    audit = got["auditd"][0]
    assert audit["description"] == "[EXECVE] auid=1000 curl -s http://x" and json.loads(audit["raw_data"])["uid"] == "0" and audit["timestamp_utc"] == "2024-03-14T08:00:00.123000Z"
    assert text["package_event"] == ["[apt]  by=bob Remove: y", "[apt] apt install x by=root Install: x:amd64", "[dpkg] install curl:amd64 <none> 7.8", "[yum] Installed curl-7"]
    assert sorted((r["description"], r["timestamp_utc"]) for r in got["journal"]) == [("[sshd] hello", "2024-03-14T08:15:01.000000Z"), ("[u] m", "2024-03-14T08:00:00.000000Z")]
    assert text["persistence_file"] == ["[ld_preload] ld.so.preload: "] and "[hostname] box" in text["system_identity"] and text["trash_item"] == ["deleted /home/bob/a b+c"]


def test_a_file_of_many_splits_keeps_its_order(spark, tmp_path):
    """An audit log and a history larger than a split: every event's lines meet, every marker dates the command after it."""
    audit = "".join(f'type=SYSCALL msg=audit({1710403200 + i}.000:{i}): auid=1 uid=0 name="first{i}"\ntype=PATH msg=audit({1710403200 + i}.000:{i}): name="second{i}"\n' for i in range(400))
    shell = "".join(f"#{1710403200 + i}\nrun {i}\n" for i in range(400))
    paths = [put(f"{tmp_path}/audit.log", audit), put(f"{tmp_path}/[root]/home/bob/.bash_history", shell)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = linux_text.Paths(spark, [paths[0]])
        assert read.ordered().rdd.getNumPartitions() > 3
        got = {r["raw"]["serial"]: r["raw"]["name"] for r in linux_text.auditd(read, F.lit(None), F.lit(None)).collect()}
        assert got == {str(i): f"first{i}" for i in range(400)}
        runs = linux_text.history(linux_text.Paths(spark, [paths[1]]), F.lit(None), F.lit(None)).collect()
        assert {r["raw"]["command"]: r["stamps"][0]["value"] for r in runs} == {f"run {i}": f"2024-03-14T{8 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000000Z" for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("path", "parser"), [
    ("[root]/home/b/.ssh/known_hosts.old", "persistence"), ("[root]/etc/known_hosts", None), ("[root]/etc/systemd/system/a.timer", "persistence"), ("[root]/home/b/egg.timer", None),
    ("[root]/var/spool/at/a01", "persistence"), ("[root]/home/b/.local/share/Trash/info/a.trashinfo", "trash"), ("uac.log", None),
])
def test_paths_name_their_parser(path, parser):
    assert linux_text.parser_for(path) == parser


def test_tar_stays_inside(spark, tmp_path):
    good, bad = tmp_path / "a.txt", tmp_path / "evil.tar.gz"
    good.write_text("x")
    with tarfile.open(bad, "w:gz") as t:
        t.add(good, "ok/a.txt")
        t.add(good, "../out.txt")
        link = tarfile.TarInfo("ok/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    into = tmp_path / "into"
    into.mkdir()
    got = containers.extract_tar(spark, str(bad), str(into)).collect()
    assert sorted(r["member"] for r in got if r["state"] == "refused") == ["../out.txt", "ok/link"] and (into / "ok/a.txt").read_text() == "x"
    assert not (tmp_path / "out.txt").exists() and [r["size"] for r in got if r["state"] == "extracted"] == [1]


def test_browsers_and_download_then_execute(spark, tmp_path):
    os.makedirs(tmp_path / "Chrome")
    with sqlite3.connect(tmp_path / "Chrome/History") as db:
        db.executescript("create table downloads(target_path,tab_url,start_time integer,total_bytes,danger_type); create table urls(id,url,title); create table visits(url,visit_time)")
        at = (1710403200 + 11644473600) * 1_000_000
        db.execute("insert into downloads values('C:\\d\\Tool.exe.crdownload','http://x',?,5,0)", (at,))
        db.execute("insert into urls values(1,'http://evil-site.net/a','t')")
        db.execute("insert into visits values(1,?)", (at,))
    with sqlite3.connect(tmp_path / "places.sqlite") as db:
        db.executescript("create table moz_places(id,url,title); create table moz_historyvisits(place_id,visit_date); create table moz_annos(place_id,anno_attribute_id,content,dateAdded); create table moz_anno_attributes(id,name); insert into moz_places values(1,'http://y','T'); insert into moz_historyvisits values(1,1710403200000000); insert into moz_annos values(1,2,'file:///z',1710403200000000); insert into moz_anno_attributes values(2,'downloads/destinationFileURI')")
    a = containers.ingest_browsers(spark, str(tmp_path), "c", "h", "s").cache()
    got = by_type(a)
    assert sorted(r["description"] for r in got["browser_visit"]) == ["[chrome] http://evil-site.net/a - t", "[firefox] http://y - T"] and len(got["browser_download"]) == 2
    runs = spark.createDataFrame([("r1", "c", "h", "prefetch_execution", "TOOL.EXE ran", "2024-03-14T08:30:00.000000Z"), ("r2", "c", "h", "prefetch_execution", "TOOL.EXE ran", "2024-03-14T09:30:00.000000Z"), ("r3", "c", "other", "prefetch_execution", "TOOL.EXE ran", "2024-03-14T08:30:00.000000Z")], "artifact_id string, case_id string, host string, artifact_type string, description string, timestamp_utc string")
    both = a.select(*runs.columns, "raw_data").unionByName(runs.withColumn("raw_data", F.lit("{}")))
    hits = correlate.download_then_execute(both).collect()
    assert [(h["artifact_id"], h["matched_on"]) for h in hits] == [("r1", "downloaded tool.exe at 2024-03-14T08:00:00.000000Z, executed at 2024-03-14T08:30:00.000000Z (+30 min)")]
    put(str(tmp_path / "feeds/one.csv"), "# first_seen,domain,comment\n2024,evil-site[.]net,x\n2024,microsoft.com,x\n")
    put(str(tmp_path / "feeds/two.txt"), "hxxp://evil-site[.]net/b\n# c\n10.0.0.1\nreport.docx\n")
    feeds = ioc.merge_feeds(containers.load_feeds(spark, str(tmp_path / "feeds")))
    hit = ioc.match(a, feeds).collect()
    assert [(h["rule_id"], h["score"], h["rule_title"]) for h in hit] == [("IOC-DOMAIN", 65, "Known-bad domain listed by 2 independent feeds")]


def test_store_replaces_and_ignores(spark, tmp_path):
    raw = spark.createDataFrame([("c", "s1", "h", "k", "t", "d", None)], "case_id string, source_id string, host string, source string, artifact_type string, description string, enrich string").withColumns({"raw": F.create_map(F.lit("PID"), F.lit("7"), F.lit("e"), F.lit("")), "stamps": F.array(F.struct(F.lit("x").alias("label"), F.lit("2024-01-01 00:00:00").alias("value")))})
    a = records.build(raw)
    assert json.loads(a.first()["raw_data"]) == {"PID": "7"}
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.read("artifacts").count() == 0
    s.replace("artifacts", a)
    s.replace("artifacts", a)
    assert s.read("artifacts").count() == 1 and store.insert_artifacts(s.read("artifacts"), a.union(a)).count() == 0
    ev = spark.createDataFrame([("c", "h", "/p", "tool", None), ("c", "h", "/q", "tool", "bad")], "case_id string, host string, source_path string, tool string, status string")
    full = ev.select(*[F.col(f) if f in ev.columns else F.lit(None).cast("string").alias(f) for f in ("source_id", "case_id", "host", "os", "tool", "tool_version", "tool_cmdline", "source_path", "sha256", "size_bytes", "acquired_utc", "imported_utc", "status", "error")]).withColumn("size_bytes", F.col("size_bytes").cast("long"))
    s.rewrite_evidence(store.register_evidence(s.read("evidence"), full))
    first = {r["source_path"]: r["source_id"] for r in s.read("evidence").collect()}
    s.rewrite_evidence(store.register_evidence(s.read("evidence"), full.where("source_path = '/p'").withColumn("tool", F.lit(None).cast("string"))))
    again = {r["source_path"]: (r["source_id"], r["tool"], r["status"]) for r in s.read("evidence").collect()}
    assert again == {"/p": (first["/p"], "tool", "ok"), "/q": (first["/q"], "tool", "bad")}


def test_manifest(spark, tmp_path):
    put(str(tmp_path / "m/a"), "1")
    put(str(tmp_path / "m/b"), "2")
    manifest.hash_files(spark, str(tmp_path / "m")).write.parquet(str(tmp_path / "was"))
    was = spark.read.parquet(str(tmp_path / "was"))
    put(str(tmp_path / "m/b"), "3")
    os.remove(tmp_path / "m/a")
    put(str(tmp_path / "m/c"), "4")
    state = {r["path"].rsplit("/", 1)[1]: r["state"] for r in manifest.compare(was, manifest.hash_files(spark, str(tmp_path / "m"))).collect()}
    old = was.withColumn("path", F.concat(F.lit("file:"), "path"))
    assert {r["path"].rsplit("/", 1)[1]: r["state"] for r in manifest.compare(old, manifest.hash_files(spark, str(tmp_path / "m"))).collect()} == state
    assert state == {"a": "missing", "b": "changed", "c": "added"} and manifest.manifest_digest(was).first()["files"] == 2


def test_clusters(spark):
    a = spark.createDataFrame([("1", "h", "event_log", "t1", json.dumps({"_enrich": {"payload": {"ProcessGuid": "g", "Image": "a.exe"}}})), ("2", "h", "memory_process", "t2", json.dumps({"PID": 9, "COMM": "x"})), ("3", "h", "file_entry", None, "{}")], "artifact_id string, host string, artifact_type string, timestamp_utc string, raw_data string")
    d = spark.createDataFrame([("1", "c", "r1", "high", 40, ["T1"]), ("1", "c", "r2", "low", 50, ["T1"]), ("1", "c", "r3", "low", 5, []), ("2", "c", "r1", "medium", 1, ["T2"]), ("3", "c", "r1", "high", 1, [])], "artifact_id string, case_id string, rule_id string, severity string, score int, attack array<string>")
    got = [(r["key"], r["score"], r["rule_count"], r["severity"], r["names"]) for r in cluster.clusters(d, a).collect()]
    assert got == [("guid:g", 55, 3, "high", ["a.exe"]), ("pid:9", 1, 1, "medium", ["x"])]
    assert tuple(cluster.coverage(d, a).first()) == (4, 1, 2, 1)
