"""Files read by tasks: names Spark doesn't list, sizes it doesn't hold, ranges that begin anywhere."""

import hashlib
import json
import os
import random
import sqlite3
import tarfile

import pytest
from pyspark.sql import functions as F

from tracelake.sources import containers, files, linux_text, manifest, tabular


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_listing_and_digests_of_any_name(spark, tmp_path):
    root = f"{tmp_path}/[case] 1%20"
    want = {}
    for name, data in {".dot": b"1", "_under": b"", "a/b/.c/d +é.bin": b"x" * 100_000, "a/e": b"2", "f{1}/g": b"3"}.items():
        want[put(f"{root}/{name}", data)] = (len(data), hashlib.sha256(data).hexdigest())
    os.symlink(root, f"{root}/a/loop")
    assert {r["path"]: (r["size"], r["sha256"]) for r in manifest.hash_files(spark, root).collect()} == want
    assert {r["path"]: r["size"] for r in files.listing(spark, "file:" + root).collect()} == {p: n for p, (n, _) in want.items()}
    os.makedirs(f"{tmp_path}/none")
    assert files.listing(spark, f"{tmp_path}/none").count() == 0 and manifest.hash_files(spark, f"{tmp_path}/none").count() == 0


def test_a_file_over_three_gigabytes_is_hashed(spark, tmp_path):
    """Sparse, so it takes no disk; Spark's binary reader refuses it."""
    size = (3 << 30) + 7
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    h, zero = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        h.update(zero)
    h.update(bytes(size & ((1 << 24) - 1)))
    got = manifest.hash_files(spark, str(tmp_path)).first()
    assert (got["size"], got["sha256"]) == (size, h.hexdigest())


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 20])
def test_lines_by_ranges(spark, tmp_path, step, monkeypatch):
    monkeypatch.setattr(files, "MOST_TASKS", 12)
    data = b"\n\nfirst\r\n" + "zwei ä\n".encode() + b"x" * 50 + b"\n\xff\n" + b"last without end"
    path = put(f"{tmp_path}/.log", data)
    got = files.lines(files.at(spark, [path]), step).orderBy("offset").collect()
    assert [r["value"] for r in got] == data.decode("utf-8", "replace").split("\n")
    assert all(data[r["offset"] :].split(b"\n")[0].decode("utf-8", "replace") == r["value"] for r in got)


def _value(rnd, depth=0):
    kind = rnd.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return "".join(rnd.choice('ab\\"{}[],:é\n ') for _ in range(rnd.randrange(12)))
    if kind == 1:
        return "\\" * rnd.randrange(150)
    if kind < 4:
        return rnd.choice([None, True, 3, -1.5e300])
    if kind == 4:
        return [_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice('ab{}"\\') + str(i): _value(rnd, depth + 1) for i in range(rnd.randrange(4))}


@pytest.mark.parametrize(("step", "indent"), [(3, None), (17, 1), (100, None), (1 << 20, 2)])
def test_json_objects_by_ranges(spark, tmp_path, step, indent, monkeypatch):
    """Every cut, inside strings, escapes and nested objects, gives the objects that a parser of the whole file gives."""
    monkeypatch.setattr(files, "MOST_TASKS", 12)
    rnd, paths, want = random.Random(step), [], []
    for k in range(3):
        rows = [{"k": _value(rnd) for _ in range(1)} | {"n": i} for i in range(12 if step < 10 else 200)]
        if k == 2:
            text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
        else:
            text = "﻿" * k + "\n [" + json.dumps([*rows, 5, "{", [{"not": "an element"}]], ensure_ascii=False, indent=indent)[1:]
        paths.append(put(f"{tmp_path}/{k}.json", text.encode()))
        want += [(paths[-1], r) for r in rows]
    paths += [put(f"{tmp_path}/empty.json", b""), put(f"{tmp_path}/none.json", b"[]")]
    got = files.json_objects(files.at(spark, paths), step).orderBy("path", "offset").collect()
    assert [(r["path"], json.loads(r["value"])) for r in got] == want


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"PID": i, "ImageFileName": f"p{i}.exe", "Args": 'a "b" {c' * 20} for i in range(5000)]
    path = put(f"{tmp_path}/pslist.json", json.dumps(rows).encode())
    found = files.json_objects(files.at(spark, [path]), 1 << 16)
    assert found.rdd.getNumPartitions() > 8 and found.select(F.spark_partition_id()).distinct().count() > 4
    assert found.count() == 5000
    made = tabular.ingest_memory(spark, {"pslist": "file:" + path}, "c", "h", "s")
    assert made.count() == 5000 and json.loads(made.where("description like '[pslist] p7.exe %'").first()["raw_data"])["Args"] == rows[7]["Args"]


def test_archives_by_tasks(spark, tmp_path):
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.tar.gz", "w:gz") as t:
            for name in (f"h{k}/.bash_history", f"h{k}/a/../b", f"/abs{k}"):
                t.add(put(f"{tmp_path}/src", f"{k}".encode() * 9_000_000 if name.endswith("history") else b"x"), name)
            info = tarfile.TarInfo(f"h{k}/dir")
            info.type = tarfile.DIRTYPE
            t.addfile(info)
    archives = files.listing(spark, str(tmp_path)).where("path like '%.tar.gz'")
    into = f"{tmp_path}/into"
    got = files.extract(archives, into)
    assert {(r["member"], r["state"]) for r in got.collect()} >= {(f"h{k}/.bash_history", "extracted") for k in range(3)}
    below = {r["path"].removeprefix(into + "/"): r["size"] for r in files.listing(spark, into).collect()}
    assert {f"h{k}/.bash_history": 9_000_000 for k in range(3)}.items() <= below.items() and {f"h{k}/b" for k in range(3)} <= below.keys()
    assert not [p for p in below if p.endswith(".part")]


def test_write_ahead_log_is_read(spark, tmp_path):
    """Rows that stand in the log only are found, uncommitted ones and broken databases aren't; the evidence stays as it is."""
    src, path = f"{tmp_path}/live", f"{tmp_path}/case/Chrome/History"
    db = sqlite3.connect(src, isolation_level=None)
    db.executescript("pragma journal_mode=wal; pragma wal_autocheckpoint=0; create table urls(id integer, url, title); create table visits(url integer, visit_time); create table downloads(target_path,tab_url,start_time integer,total_bytes,danger_type)")
    at = 13_354_876_800_000_001  # over 2**53
    db.execute("begin")
    db.executemany("insert into urls values(?,?,?)", [(i, f"http://x/{i}", "t" * 300) for i in range(500)])
    db.executemany("insert into visits values(?,?)", [(i, at) for i in range(500)])
    db.execute("commit")
    os.makedirs(os.path.dirname(path))
    data, log = open(src, "rb").read(), open(src + "-wal", "rb").read()
    put(path, data), put(path + "-wal", log)
    put(f"{tmp_path}/case/brave/History", data), put(f"{tmp_path}/case/brave/History-wal", log[:-100])  # the last commit is torn
    put(f"{tmp_path}/case/edge/History", b"no database"), put(f"{tmp_path}/case/x/places.sqlite", b"")
    before = {r["path"]: r["sha256"] for r in manifest.hash_files(spark, f"{tmp_path}/case").collect()}
    got = containers.ingest_browsers(spark, f"{tmp_path}/case", "c", "h", "s").collect()
    assert len(got) == 500 and {r["timestamp_utc"][-4:] for r in got} == {"001Z"}
    assert {r["path"]: r["sha256"] for r in manifest.hash_files(spark, f"{tmp_path}/case").collect()} == before
    db.close()
    assert containers.merged(b"abc", b"") == b"abc" and containers.merged(b"abc", b"z" * 64) == b"abc"
    assert containers.ingest_browsers(spark, put(f"{tmp_path}/nothing/a", b"").removesuffix("/a"), "c", "h", "s").count() == 0


def test_feeds_of_unlike_tables_in_one_pass(spark, tmp_path):
    put(f"{tmp_path}/a/one.csv", '# note\n# first_seen,"domain",comment\n2024,evil-site[.]net,other.org\n'.encode())
    put(f"{tmp_path}/two.tsv", "﻿ip\tport\tmd5_hash\textra\n9.9.9.9\t80\td41d8cd98f00b204e9800998ecf8427e\tx\r\n8.8.4.4\n".encode())
    put(f"{tmp_path}/plain.list", b"# c\n9.9.9.9\n9.9.9.9\n\n")
    put(f"{tmp_path}/none.csv", b"a,b\nzone-x.net,1\n")
    put(f"{tmp_path}/.hidden/three.txt", b"7.7.7.7\n"), put(f"{tmp_path}/.x.txt", b"7.7.7.7\n"), put(f"{tmp_path}/c.bin", b"7.7.7.7\n"), put(f"{tmp_path}/void.txt", b"")
    got = {(r["feed"], r["value"]) for r in containers.load_feeds(spark, str(tmp_path)).collect()}
    assert got >= {("one", "evil-site.net"), ("two", "9.9.9.9"), ("two", "8.8.4.4"), ("two", "d41d8cd98f00b204e9800998ecf8427e"), ("plain", "9.9.9.9")}
    assert not {v for _, v in got} & {"7.7.7.7", "other.org"} and len([1 for f, _ in got if f == "plain"]) == 1
    assert [r["feed"] for r in containers.load_feed(spark, f"{tmp_path}/two.tsv", "mine", "ip").select("feed").distinct().collect()] == ["mine"]


def test_dot_files_are_read_where_they_are(spark, tmp_path):
    root = f"{tmp_path}/case"
    put(f"{root}/[root]/home/bob/.bash_history", b"ls\nid")
    put(f"{root}/[root]/home/bob/.profile", b"export A=1\n")
    put(f"{root}/[root]/home/eve/.zsh_history", b"")
    found, _ = linux_text.ingest_collection(spark, root, "c", "h", "s")
    assert {r["description"] for r in found.where("artifact_type = 'shell_history'").collect()} == {"[bob] ls", "[bob] id"}
    assert sorted(os.listdir(tmp_path)) == ["case"]
