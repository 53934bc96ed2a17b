"""Files of any name and size, read by tasks: listings, digests, lines, whole texts, JSON objects, archive members.

Spark's own readers skip names that start with a dot or an underscore, and hold a binary file in one value of at
most 2 GB. Here a row of a listing, or a byte range of a file, is a task's work; the task opens the file itself: a
local or shared folder, or what pyarrow's file systems know by address (hdfs, s3, gs). The driver lists the top
folder only. A file that is gone when its task comes fails the task, and so the job.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tarfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and bytes read at once where a file is streamed.
RANGE, BLOCK = 32 << 20, 4 << 20
#: Partitions of a list of files or ranges at most; each then holds several.
MOST_TASKS = 10_000
FILE = "path string, size long, modified timestamp"


def place(address: str):
    """(file system or None, path): None is the local or shared folder tree."""
    plain = re.sub(r"^file:(//)?(?=/)", "", address)
    if "://" not in plain:
        return None, os.path.abspath(plain)
    from pyarrow import fs

    return fs.FileSystem.from_uri(plain)


def opened(address: str) -> io.BufferedIOBase:
    """A file for reading, with seek."""
    system, path = place(address)
    return open(path, "rb") if system is None else io.BufferedReader(system.open_input_file(path))


def _below(address: str, deep: bool) -> Iterator[tuple[str, int, datetime]]:
    """(path, size, modified) of the files in a folder, or at any depth; links to folders aren't followed."""
    system, base = place(address)
    if system is None:
        for top, dirs, names in os.walk(base):
            for name in names:
                path = os.path.join(top, name)
                if os.path.isfile(path):
                    told = os.stat(path)
                    yield path, told.st_size, datetime.fromtimestamp(told.st_mtime, timezone.utc)
            if not deep:
                dirs.clear()
        return
    from pyarrow import fs

    lead = address[: len(address) - len(base)] if address.endswith(base) else ""
    for info in system.get_file_info(fs.FileSelector(base, recursive=deep)):
        if info.type == fs.FileType.File:
            yield lead + info.path, info.size, info.mtime


def _folders(address: str) -> list[str]:
    system, base = place(address)
    if system is None:
        return [e.path for e in os.scandir(base) if e.is_dir(follow_symlinks=False)]
    from pyarrow import fs

    lead = address[: len(address) - len(base)] if address.endswith(base) else ""
    return [lead + i.path for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]


def _table(rows: Iterator[tuple], names: list[str], most: int = 2000):
    """Pandas tables of at most ``most`` rows."""
    import pandas as pd

    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of every file below a folder, whatever its name; each folder in it is walked by a task."""
    work = [(root.rstrip("/") or "/", False), *((f, True) for f in sorted(_folders(root)))]
    given = spark.createDataFrame(work, "folder string, deep boolean").repartition(min(len(work), MOST_TASKS))

    def walk(batches):
        for b in batches:
            found = (row for folder, deep in zip(b["folder"], b["deep"]) for row in _below(folder, deep))
            yield from _table(found, ["path", "size", "modified"])

    return given.mapInPandas(walk, FILE)


def at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, modified) of files that are named one by one."""
    def look(batches):
        def told(path):
            system, inside = place(path)
            if system is None:
                s = os.stat(inside)
                return path, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)
            info = system.get_file_info(inside)
            return path, info.size, info.mtime

        for b in batches:
            yield from _table(map(told, b["path"]), ["path", "size", "modified"])

    given = spark.createDataFrame([(p,) for p in paths], "path string")
    return given.repartition(max(1, min(len(paths), 200))).mapInPandas(look, FILE)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """One partition a row, up to MOST_TASKS: what a row costs isn't its own size, so adaptive merging would be wrong."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)), *keys)


def digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of listed files; a file is streamed in blocks by one task, so memory is one block's."""
    def run(batches):
        def one(path):
            h, n = hashlib.sha256(), 0
            with opened(path) as f:
                while block := f.read(BLOCK):
                    h.update(block)
                    n += len(block)
            return path, n, h.hexdigest()

        for b in batches:
            yield from _table(map(one, b["path"]), ["path", "size", "sha256"], 100)

    return dealt(files.select("path"), "path").mapInPandas(run, "path string, size long, sha256 string")


def ranges(files: DataFrame, step: int = RANGE) -> DataFrame:
    """(path, size, modified, start, end): the byte ranges of listed files; an empty file has none."""
    filled = files.where("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("start"))
    return filled.withColumn("end", F.least(F.col("start") + step, "size"))


# --- text ---------------------------------------------------------------------------------------------------------

def _lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in a range; the last may end behind it."""
    with opened(path) as f:
        f.seek(max(start - 1, 0))
        if start:
            f.readline()  # the rest of a line that begins before the range
        while (offset := f.tell()) < end and (line := f.readline()):
            yield offset, line.removesuffix(b"\n").decode("utf-8", "replace")


def lines(files: DataFrame, step: int = RANGE) -> DataFrame:
    """(path, modified, offset, value) of every line; a large file is read by many tasks."""
    def run(batches):
        for b in batches:
            found = ((p, m, o, v) for p, m, s, e in zip(b["path"], b["modified"], b["start"], b["end"]) for o, v in _lines_of(p, int(s), int(e)))
            yield from _table(found, ["path", "modified", "offset", "value"])

    return dealt(ranges(files, step), "path", "start").mapInPandas(run, "path string, modified timestamp, offset long, value string")


def texts(files: DataFrame) -> DataFrame:
    """(path, modified, value) of small files that mean something as a whole."""
    def run(batches):
        def one(path, modified):
            with opened(path) as f:
                return path, modified, f.read().decode("utf-8", "replace")

        for b in batches:
            yield from _table(map(one, b["path"], b["modified"]), ["path", "modified", "value"], 50)

    return dealt(files, "path").mapInPandas(run, "path string, modified timestamp, value string")


# --- JSON objects by byte ranges ------------------------------------------------------------------------------------

def _before(f, start: int) -> int:
    """How many backslashes stand directly before an offset."""
    n = 0
    while start > 0:
        k = min(start, 4096)
        f.seek(start - k)
        chunk = f.read(k)
        mine = k - len(chunk.rstrip(b"\\"))
        n, start = n + mine, start - k
        if mine < k:
            break
    return n


def _shape(block: bytes, before: int):
    """Offsets of brackets, what each adds to the depth, how many quotes that count stand before it, and the number of those quotes."""
    import numpy as np

    a = np.frombuffer(block, np.uint8)
    quotes = np.flatnonzero(a == ord('"'))
    if len(quotes):
        behind = a[quotes - 1] == ord("\\")
        behind[0] = before > 0 if quotes[0] == 0 else behind[0]
        counted = np.ones(len(quotes), bool)
        for i in np.flatnonzero(behind).tolist():  # only quotes behind a backslash; an odd run escapes the quote
            at = int(quotes[i])
            run = at - len(block[:at].rstrip(b"\\")) if at < 64 else len(block[at - 64 : at]) - len(block[at - 64 : at].rstrip(b"\\"))
            if run == 64:
                run = at - len(block[:at].rstrip(b"\\"))
            counted[i] = (run + (before if run == at else 0)) % 2 == 0
        quotes = quotes[counted]
    opening = (a == ord("{")) | (a == ord("["))
    at = np.flatnonzero(opening | (a == ord("}")) | (a == ord("]")))
    return at, np.where(opening[at], 1, -1), np.searchsorted(quotes, at), len(quotes)


def _top(path: str) -> int:
    """Depth at which a file's objects open: 1 in an array, 0 where objects follow one another."""
    with opened(path) as f:
        while chunk := f.read(4096):
            seen = chunk.removeprefix(b"\xef\xbb\xbf").lstrip()
            if seen:
                return 1 if seen[:1] == b"[" else 0
    return 0


def _objects_of(path: str, start: int, end: int, inside: int, depth: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of the objects that open in a range, whose begin has a known state; the last may end behind it."""
    import numpy as np

    base = _top(path)
    with opened(path) as f:
        before = _before(f, start)
        f.seek(start)
        block, behind = f.read(end - start), False
        offset, open_at, held = start, None, []
        while block:
            at, step, quotes, n = _shape(block, before)
            out = (quotes + inside) % 2 == 0
            at, step = at[out], step[out]
            level = depth + np.cumsum(step)
            kind = np.frombuffer(block, np.uint8)[at]
            edge = ((kind == ord("{")) & (level == base + 1)) | ((kind == ord("}")) & (level == base))
            piece = 0  # where the open object's part in this block begins
            for place_, what in zip(at[edge].tolist(), kind[edge].tolist()):
                if what == ord("{"):
                    if behind:
                        return
                    open_at, piece, held = offset + place_, place_, []
                elif open_at is not None:
                    held.append(block[piece : place_ + 1])
                    yield open_at, b"".join(held).decode("utf-8", "replace")
                    open_at, held = None, []
                    if behind:
                        return
            if open_at is None:
                return
            held.append(block[piece:])
            inside, depth = (inside + n) % 2, int(level[-1]) if len(level) else depth
            tail = len(block) - len(block.rstrip(b"\\"))
            before = tail + (before if tail == len(block) else 0)
            offset, behind = offset + len(block), True
            block = f.read(1 << 20)


def json_objects(files: DataFrame, step: int = RANGE) -> DataFrame:
    """(path, offset, value): the objects of files that hold an array of objects, or objects one after another.

    A range doesn't tell by itself whether it begins inside a string, nor how deep. So each range of a large file is
    first counted under both assumptions; running sums over the ranges of a file (a row each) then fix the state at
    every range's begin, and the ranges are read apart. Elements that are no objects are left out.
    """
    def count(batches):
        def one(path, size, start, end):
            with opened(path) as f:
                before = _before(f, start)
                f.seek(start)
                _, step_, quotes, n = _shape(f.read(end - start), before)
            return path, size, start, end, n % 2, int(step_[quotes % 2 == 0].sum()), int(step_[quotes % 2 == 1].sum())

        for b in batches:
            yield from _table((one(p, int(z), int(s), int(e)) for p, z, s, e in zip(b["path"], b["size"], b["start"], b["end"])), ["path", "size", "start", "end", "flips", "outer", "inner"], 50)

    def read(batches):
        for b in batches:
            found = ((p, o, v) for p, s, e, i, d in zip(b["path"], b["start"], b["end"], b["inside"], b["depth"]) for o, v in _objects_of(p, int(s), int(e), int(i), int(d)))
            yield from _table(found, ["path", "offset", "value"])

    parts = ranges(files, step).select("path", "size", "start", "end")
    zero = F.lit(0).cast("long")
    small = parts.where(F.col("size") <= step).withColumns({"inside": zero, "depth": zero})
    counted = dealt(parts.where(F.col("size") > step), "path", "start").mapInPandas(count, "path string, size long, start long, end long, flips long, outer long, inner long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("inside", F.coalesce(F.sum("flips").over(earlier), zero) % 2)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))).over(earlier), zero))
    every = small.unionByName(known.select(*small.columns))
    # as many tasks as ranges; what the windows gathered is spread again
    return every.repartition(max(1, min(parts.count(), MOST_TASKS)), "path", "start").mapInPandas(read, "path string, offset long, value string")


# --- archives ---------------------------------------------------------------------------------------------------------

def _inside(name: str) -> str | None:
    """A member's path below the target folder; None if it leads out of it."""
    clean = os.path.normpath(name)
    return None if os.path.isabs(clean) or clean.split(os.sep)[0] == ".." else clean


def extract(archives: DataFrame, into: str) -> DataFrame:
    """(archive, member, size, state): writes the regular files of listed tar archives below ``into``; state is extracted or refused.

    A task streams one archive (compressed or not), so memory is one block's. A member is written under another name and
    moved when it is whole; a task that runs again writes the same files. Members that lead out of the folder, links and
    devices are refused. The rows are computed here, once, and kept.
    """
    def put(system, base, inside, source):
        target = f"{base}/{inside}"
        part = f"{target}.part"
        if system is None:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            sink = open(part, "wb")
        else:
            system.create_dir(target.rpartition("/")[0], recursive=True)
            sink = system.open_output_stream(part)
        with sink:
            while block := source.read(BLOCK):
                sink.write(block)
        os.replace(part, target) if system is None else system.move(part, target)

    def run(batches):
        system, base = place(into)

        def members(path):
            with opened(path) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                for m in tar:
                    inside = _inside(m.name)
                    if m.isdir() and inside is not None:
                        continue
                    if inside is None or not m.isfile():
                        yield path, m.name, m.size, "refused"
                        continue
                    put(system, base, inside, tar.extractfile(m))
                    yield path, m.name, m.size, "extracted"

        for b in batches:
            yield from _table((row for p in b["path"] for row in members(p)), ["archive", "member", "size", "state"])

    done = dealt(archives.select("path"), "path").mapInPandas(run, "archive string, member string, size long, state string").cache()
    done.count()
    return done
