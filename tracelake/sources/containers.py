"""Archives, browser databases and indicator feeds."""

from __future__ import annotations

import sqlite3
import struct
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.sources import files, records

# --- fixed values ----------------------------------------------------------------------------------------------

CHROMIUM = ("chrome", "chromium", "brave", "microsoft-edge", "vivaldi", "opera", "edge")
INDICATOR_COLUMNS = ["sha256_hash", "sha1_hash", "md5_hash", "sha256", "sha1", "md5", "hash", "ioc", "indicator", "value", "domain", "hostname", "url", "ip", "ip_address", "dst_ip", "c2", "address", "first_seen_ip"]
OTHER_COLUMNS = ["imphash", "impfuzzy", "ssdeep", "tlsh", "authentihash", "file_name", "filename", "reporter", "signature", "clamav", "file_type", "mime_type", "tags", "comment", "description", "vtpercent"]
#: First word of a write-ahead log; the odd one has big-endian sums.
LOG_MAGIC = (0x377F0682, 0x377F0683)
FEED_ENDINGS = (".txt", ".csv", ".tsv", ".ioc", ".list")


def extract_tar(spark: SparkSession, archive: str, into: str) -> DataFrame:
    """(archive, member, size, state) of an archive whose regular files are written below ``into`` by a task; see ``files.extract``."""
    return files.extract(files.at(spark, [archive]), into)


# --- browsers ---------------------------------------------------------------------------------------------------

def merged(data: bytes, log: bytes) -> bytes:
    """A database with the committed pages of its write-ahead log; a log that isn't its own, or is torn, counts up to its last whole commit."""
    if len(log) < 32:
        return data
    magic, _, size, _, *salt_sum = struct.unpack(">8I", log[:32])
    salt, told = tuple(salt_sum[:2]), tuple(salt_sum[2:])
    if magic not in LOG_MAGIC:
        return data
    order = ">" if magic & 1 else "<"

    def add(state: tuple[int, int], chunk: bytes) -> tuple[int, int]:
        a, b = state
        for x, y in struct.iter_unpack(f"{order}II", chunk):
            a = (a + x + b) & 0xFFFFFFFF
            b = (b + y + a) & 0xFFFFFFFF
        return a, b

    state = add((0, 0), log[:24])
    if state != told:
        return data
    pages, pending, total = {}, {}, 0
    for at in range(32, len(log) - size - 23, 24 + size):
        number, commit, *rest = struct.unpack(">6I", log[at : at + 24])
        page = log[at + 24 : at + 24 + size]
        state = add(add(state, log[at : at + 8]), page)
        if tuple(rest[:2]) != salt or tuple(rest[2:]) != state:
            break
        pending[number] = page
        if commit:
            pages.update(pending)
            pending, total = {}, commit
    if not total:
        return data
    out = bytearray(data[: total * size].ljust(total * size, b"\0"))
    for number, page in pages.items():
        if number <= total:
            out[(number - 1) * size : number * size] = page
    return bytes(out)


def _database(path: str) -> sqlite3.Connection:
    """A database and its write-ahead log, read into memory; the evidence isn't touched."""
    def read(name: str) -> bytes:
        try:
            with files.opened(name) as f:
                return f.read()
        except FileNotFoundError:
            return b""

    data = bytearray(merged(read(path), read(path + "-wal")))
    if len(data) > 19:
        data[18] = data[19] = 1  # no log is beside it any more
    db = sqlite3.connect(":memory:")
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    if data:
        db.deserialize(bytes(data))
    return db


def _frame(found: DataFrame, table: str, columns: str) -> DataFrame:
    """path and the columns of a table, of every listed database; a database that has none of it gives no row. A task reads a database."""
    pairs = [c.split() for c in columns.split(", ")]
    wanted = ", ".join(f"CAST({name} AS {'INTEGER' if kind == 'long' else 'TEXT'})" for name, kind in pairs)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), *(pa.int64() if kind == "long" else pa.string() for _, kind in pairs)]
        names = ["path", *(name for name, _ in pairs)]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with closing(_database(path)) as db:
                        cursor = db.execute(f"SELECT {wanted} FROM {table}")
                        while rows := cursor.fetchmany(10_000):
                            cells = [[path] * len(rows), *(list(c) for c in zip(*rows))]
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)
                except sqlite3.Error:
                    continue

    return found.select("path").mapInArrow(run, f"path string, {columns}")


def _browser(df: DataFrame, kind: str, label: str, ts, text, **raw) -> DataFrame:
    stamp = F.array(F.struct(F.lit(label).alias("label"), ts.alias("value")))
    return df.select(F.lit(kind).alias("artifact_type"), stamp.alias("stamps"), text.alias("description"), F.map_from_arrays(F.array(*[F.lit(k) for k in raw]), F.array(*[v.cast("string") for v in raw.values()])).alias("raw"))


def _said(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def chromium(found: DataFrame) -> DataFrame:
    """Downloads and visits of Chromium history databases; visits meet their addresses in Spark, each in its own database."""
    d = _frame(found, "downloads", "target_path string, tab_url string, start_time long, total_bytes long, danger_type long")
    urls, visits = _frame(found, "urls", "id long, url string, title string"), _frame(found, "visits", "url long, visit_time long")
    text = F.concat(F.lit("[chrome] "), _said("target_path"), F.lit(" from "), _said("tab_url"), F.lit(" ("), _said("total_bytes"), F.lit(" bytes, danger="), _said("danger_type"), F.lit(")"))
    one = _browser(d, "browser_download", "download_start", fn.webkit_time(F.col("start_time")), text, path=F.col("target_path"), url=F.col("tab_url"), bytes=F.col("total_bytes"), danger=F.col("danger_type"))
    v = visits.withColumnRenamed("url", "id").join(urls, ["path", "id"])
    said = F.concat(F.lit("[chrome] "), _said("url"), F.lit(" - "), _said("title"))
    return one.unionByName(_browser(v, "browser_visit", "visit", fn.webkit_time(F.col("visit_time")), said, url=F.col("url"), title=F.col("title")))


def firefox(found: DataFrame) -> DataFrame:
    """Downloads and visits of Firefox places databases."""
    places, visits = _frame(found, "moz_places", "id long, url string, title string"), _frame(found, "moz_historyvisits", "place_id long, visit_date long")
    annos = _frame(found, "moz_annos", "place_id long, anno_attribute_id long, content string, dateAdded long")
    names = _frame(found, "moz_anno_attributes", "id long, name string")
    wanted = names.where("name = 'downloads/destinationFileURI'").select("path", F.col("id").alias("anno_attribute_id"))
    places = places.withColumnRenamed("id", "place_id")
    d = annos.join(wanted, ["path", "anno_attribute_id"]).join(places, ["path", "place_id"])
    text = F.concat(F.lit("[firefox] "), _said("content"), F.lit(" from "), _said("url"))
    one = _browser(d, "browser_download", "download_start", fn.unix_micros_time(F.col("dateAdded")), text, path=F.col("content"), url=F.col("url"))
    v = visits.join(places, ["path", "place_id"])
    said = F.concat(F.lit("[firefox] "), _said("url"), F.lit(" - "), _said("title"))
    return one.unionByName(_browser(v, "browser_visit", "visit", fn.unix_micros_time(F.col("visit_date")), said, url=F.col("url"), title=F.col("title")))


def databases(spark: SparkSession, root: str) -> DataFrame:
    """(path, browser): the browser databases below a folder, dealt to tasks one by one."""
    found = files.listing(spark, root)
    name, inside = F.substring_index("path", "/", -1), F.lower("path")
    kind = F.when(name == "places.sqlite", "firefox").when((name == "History") & inside.rlike("|".join(CHROMIUM)), "chromium")
    return files.dealt(found.select("path", kind.alias("browser")).where("browser is not null"), "path")


def ingest_browsers(spark: SparkSession, root: str, case_id: str, host: str, source_id: str) -> DataFrame:
    """Artifacts of every browser database below a folder; none if there is no database."""
    found = databases(spark, root)
    rows = chromium(found.where("browser = 'chromium'")).unionByName(firefox(found.where("browser = 'firefox'")))
    return records.build(rows.withColumns({"case_id": F.lit(case_id), "source_id": F.lit(source_id), "host": F.lit(host), "source": F.lit("browser"), "enrich": F.lit(None).cast("string")}))


# --- feeds -------------------------------------------------------------------------------------------------------

def feed_columns(header: list[str]) -> list[str]:
    """Columns of a feed that hold indicators, by their names."""
    low = lambda c: c.strip().lower()
    return [c for c in header if any(k in low(c) for k in INDICATOR_COLUMNS) and not any(k in low(c) for k in OTHER_COLUMNS)]


def _head(path: str) -> tuple[list[str], bool, str]:
    """(header, whether it is a comment, first plain line) of a table: the last comment before the first plain line that names an indicator column, or else that line."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    told, first = None, ""
    with files.opened(path) as f:
        for line in f:
            plain = line.decode("utf-8", "replace").strip().lstrip("\ufeff")
            if plain.startswith("#"):
                comment = plain.lstrip("# ").strip()
                told = comment if any(k in comment.lower() for k in INDICATOR_COLUMNS) else told
            elif plain:
                first = plain
                break
    return [h.strip().strip('"') for h in (told or first).split(sep)], told is not None, first


def _heads(found: DataFrame, column: str | None) -> DataFrame:
    """(path, tabular, cells, width, skip, date) of listed feeds: which cells of a row hold indicators, and the line that is the header."""
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, modified in zip(b["path"], b["modified"]):
                date, cells, width, skip = modified.strftime("%Y-%m-%d"), [], 0, None
                if path.lower().endswith((".csv", ".tsv")):
                    header, commented, first = _head(path)
                    wanted = [column] if column else feed_columns(header)
                    cells, width, skip = [header.index(w) for w in dict.fromkeys(wanted) if w in header], len(header), None if commented else first
                    rows.append((path, bool(wanted), cells, width, skip, date))
                else:
                    rows.append((path, False, cells, width, skip, date))
            yield pd.DataFrame(rows, columns=["path", "tabular", "cells", "width", "skip", "date"])

    return found.mapInPandas(run, "path string, tabular boolean, cells array<int>, width int, skip string, date string")


def _feeds(found: DataFrame, name: str | None = None, column: str | None = None) -> DataFrame:
    heads = _heads(found, column)
    width = max(1, heads.agg(F.max("width")).first()[0] or 0)
    text = files.lines(found).select("path", F.regexp_replace("value", r"\r$", "").alias("value")).join(heads, "path")
    shape = ", ".join(f"c{i} string" for i in range(width))
    # one reader a separator; a row of a narrower table has nulls at its end
    read = F.when(F.lower("path").endswith(".tsv"), F.from_csv("value", shape, {"sep": "\t"})).otherwise(F.from_csv("value", shape))
    row = F.array(*[F.col("r")[f"c{i}"] for i in range(width)])
    body = text.where("tabular").where(~F.ltrim("value").startswith("#") & ~F.trim("value").eqNullSafe(F.col("skip"))).withColumn("r", read).withColumn("row", row)
    cells = body.select("path", "date", F.explode(F.transform("cells", lambda i: F.get("row", i))).alias("raw"))
    cells = cells.unionByName(text.where("not tabular").select("path", "date", F.col("value").alias("raw")))
    got = cells.where(F.trim("raw") != "").withColumn("i", fn.classify_indicator(F.col("raw"))).where("i is not null")
    said = F.lit(name) if name else F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    one = got.select("path", "i.kind", "i.value", said.alias("feed"), "date", F.substring(F.trim("raw"), 1, 120).alias("raw"))
    return one.dropDuplicates(["path", "kind", "value"]).drop("path")


def load_feed(spark: SparkSession, path: str, name: str | None = None, column: str | None = None) -> DataFrame:
    """(kind, value, feed, date, raw) of a feed: one value a line, or a table whose header (even commented out) names indicator columns."""
    return _feeds(files.at(spark, [path]), name, column)


def load_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """All feeds below a folder in one pass, hidden files and folders left out; files are listed and read by tasks."""
    found = files.listing(spark, folder)
    inside = F.substring(F.col("path"), len(folder.rstrip("/")) + 1, 1 << 20) if "://" in folder else F.substring(F.col("path"), len(files.place(folder)[1].rstrip("/")) + 1, 1 << 20)
    wanted = ~inside.rlike(r"/\.") & F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in FEED_ENDINGS) + ")$")
    return _feeds(found.where(wanted))
