"""Column functions of the forensic vocabulary; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.model import CANONICAL, SEVERITIES

# --- fixed values -------------------------------------------------------------------------------

#: Texts that stand for "no time".
NO_TIME = ["", "null", "n/a", "-", "0", "1601-01-01 00:00:00", "1601-01-01t00:00:00", "0001-01-01 00:00:00", "0001-01-01t00:00:00", "1970-01-01 00:00:00", "1970-01-01t00:00:00"]
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: Replacements that undo defanged indicators, in order.
REFANG = [("[.]", "."), ("(.)", "."), ("[dot]", "."), (" dot ", "."), ("hxxp://", "http://"), ("hxxps://", "https://"), ("[:]", ":"), ("[://]", "://"), ("\\.", ".")]
#: Addresses that are never indicators, by prefix.
IGNORED_IP = ["127.", "0.", "255.", "10.", "192.168.", "169.254.", *[f"172.{n}." for n in range(16, 32)], "224.", "239.", "8.8.8.8", "1.1.1.1"]
#: Domains that are never indicators.
IGNORED_DOMAINS = [
    "microsoft.com", "windows.com", "windowsupdate.com", "msftconnecttest.com", "google.com", "gstatic.com", "googleapis.com", "cloudflare.com",
    "akamai.net", "akamaiedge.net", "amazonaws.com", "office.com", "office365.com", "live.com", "msn.com", "bing.com", "digicert.com",
    "verisign.com", "ubuntu.com", "canonical.com", "debian.org", "mozilla.org", "apple.com", "icloud.com", "github.com",
]
#: Endings of file names that look like domains.
FILE_ENDINGS = [
    "exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "vbe", "js", "jse", "jar", "scr", "msi", "lnk", "hta", "cpl", "ocx", "drv", "bin", "dat",
    "tmp", "log", "txt", "ini", "conf", "cfg", "yaml", "yml", "json", "xml", "csv", "md", "zip", "rar", "7z", "gz", "tar", "cab", "iso", "img",
    "apk", "doc", "docx", "xls", "xlsx", "xlsm", "xlam", "ppt", "pptx", "pdf", "rtf", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "mp3",
    "mp4", "avi", "py", "pl", "rb", "php", "go", "rs", "db", "sqlite", "elf", "sh", "wsf", "ws", "reg", "chm", "url", "pif", "ppc", "arm", "arm5",
    "arm6", "arm7", "mips", "mpsl", "m68k", "i686", "x86", "spc", "arc",
]
DOMAIN = r"^(?=.{4,253}$)([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
SKIPPED_HASH_LABELS = ["imphash", "impfuzzy", "ssdeep", "tlsh", "authentihash"]
#: Parts of a description that mark an artifact as noise.
NOISE = [
    "$logfile", "$extend", "$bitmap", "$secure", "thumbcache", "qmgr.db", "lastalive", "\\webcache\\", "\\inetcache\\", "settings.dat",
    "\\servicestate\\", "\\windows\\servicing\\", "\\softwaredistribution\\",
    "/proc/", "/sys/", "/run/", "/dev/shm/.x11", "/var/lib/dpkg/info/", "/usr/share/man/", "/usr/share/doc/", "/var/cache/apt/", "/snap/",
]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


# --- time ----------------------------------------------------------------------------------------

def canonical(ts: Column) -> Column:
    """The canonical text of a timestamp; it sorts as the time does."""
    return F.date_format(ts, CANONICAL)


def normalize_timestamp(value: Column) -> Column:
    """Canonical text of an ISO-like time: sentinels and years out of range are null, no offset means UTC, the fraction is cut to microseconds."""
    v = F.trim(value.cast("string"))
    v = F.when(~F.lower(v).isin(NO_TIME), F.trim(F.regexp_replace(v, "[Zz]$", "")))
    v = F.regexp_replace(v, r"(\.\d{6})\d+", "$1")
    shape = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"
    ts = F.when(v.rlike(shape), F.regexp_replace(v, r"([+-]\d{2})(\d{2})$", "$1:$2")).try_cast("timestamp")
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), canonical(ts))


def webkit_time(micros: Column) -> Column:
    """Microseconds since 1601; values of 0 and below are null."""
    v = micros.cast("long")
    return F.when(v > 0, canonical(F.timestamp_micros(v - F.lit(11_644_473_600_000_000))))


def unix_micros_time(micros: Column) -> Column:
    v = micros.cast("long")
    return F.when(v > 0, canonical(F.timestamp_micros(v)))


def epoch_time(seconds: Column) -> Column:
    """Seconds since 1970, with fraction; values of 0 and below and texts are null."""
    v = seconds.try_cast("double")
    ts = F.timestamp_micros(F.round(v * 1_000_000).cast("long"))
    return F.when((v > 0) & (v < 4.2e9), canonical(ts))


def local_to_utc(ts: Column, zone: Column) -> Column:
    """A canonical text read as local time of an Olson zone; unchanged where there is no zone."""
    moved = canonical(F.to_utc_timestamp(F.to_timestamp(ts, CANONICAL), zone))
    return F.when(zone.isNull() | (zone == ""), ts).otherwise(moved)


def infer_year(month_day_time: Column, seen: Column) -> Column:
    """Time of a log line without a year: the file's year, or the year before if that lies over a day after the file's time."""
    same = F.try_to_timestamp(F.concat_ws(" ", F.year(seen).cast("string"), F.regexp_replace(month_day_time, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    earlier = F.try_to_timestamp(F.concat_ws(" ", (F.year(seen) - 1).cast("string"), F.regexp_replace(month_day_time, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(same > seen + F.expr("INTERVAL 1 DAY"), earlier).otherwise(same)


# --- paths and records ------------------------------------------------------------------------------

def basename(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.substring_index(F.translate(path, "/", "\\"), "\\", -1)


def binary_leaf(path: Column) -> Column:
    """Name of a service's program: no path, quotes, arguments or extension."""
    name = F.substring_index(F.regexp_replace(F.translate(path, "/", "\\"), '^"+|"+$', ""), "\\", -1)
    first = F.regexp_extract(name, r"^\s*(\S+)", 1)
    return F.regexp_replace(F.when(first != "", first).otherwise(name), r"\.[^.]*$", "")


def is_noise(description: Column) -> Column:
    """Whether a description has a noise part, under either slash."""
    low = F.lower(F.coalesce(description, F.lit("")))
    back = F.translate(low, "/", "\\")
    return any_of([back.contains(p.replace("/", "\\")) for p in NOISE])


def dedup_key(case_id: Column, host: Column, artifact_type: Column, ts: Column, description: Column, raw_json: Column) -> Column:
    """Identity of an artifact: equal content gives an equal key on every run."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in (case_id, host, artifact_type, ts, description, raw_json)]))


def trimmed_map(m: Column) -> Column:
    """A map without empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def mz_header(hexdump: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(hexdump, F.lit(""))), r"[ \n\r\t]", "").startswith("4d5a")


def elf_header(hexdump: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(hexdump, F.lit(""))), r"[ \n\r\t]", "").startswith("7f454c46")


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical; -1 for anything else."""
    out = F.lit(-1)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


# --- indicators ---------------------------------------------------------------------------------------

def refang(value: Column) -> Column:
    """An indicator as it was before it was made unclickable."""
    v = F.trim(F.regexp_replace(value.cast("string"), "﻿", ""))
    v = F.regexp_replace(F.trim(F.regexp_replace(v, "^[\"']+|[\"']+$", "")), "[.,;:|]+$", "")
    for old, new in REFANG:
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.trim(v)


def url_host(value: Column) -> Column:
    """Host of a URL, or the value itself if it is none."""
    low = F.lower(value)
    host = F.substring_index(F.substring_index(F.substring(low, F.instr(low, "://") + 3, 1 << 30), "/", 1), ":", 1)
    return F.regexp_replace(F.when(low.contains("://"), host).otherwise(low), r"\.+$", "")


def _valid_ip(v: Column) -> Column:
    octets = F.split(v, r"\.")
    return v.rlike(IPV4) & ~starts_with_any(v, IGNORED_IP) & F.forall(octets, lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))


def classify_indicator(value: Column) -> Column:
    """struct(kind, value) of a feed entry: md5, sha1, sha256, ip or domain; null if it is none or not worth matching."""
    v = refang(value)
    low = F.lower(v)
    hash_kind = F.when(low.rlike("^[a-f0-9]+$"), F.when(F.length(low) == 32, "md5").when(F.length(low) == 40, "sha1").when(F.length(low) == 64, "sha256"))
    host = url_host(v)
    domain = host.rlike(DOMAIN) & ~F.substring_index(host, ".", -1).isin(FILE_ENDINGS) & ~host.isin(IGNORED_DOMAINS) & ~F.substring_index(host, ".", -2).isin(IGNORED_DOMAINS)
    entry = (v != "") & ~starts_with_any(v, ["#", "//", ";"])
    found = (
        F.when(hash_kind.isNotNull(), F.struct(hash_kind.alias("kind"), low.alias("value")))
        .when(v.rlike(IPV4), F.when(_valid_ip(v), F.struct(F.lit("ip").alias("kind"), v.alias("value"))))
        .when(domain, F.struct(F.lit("domain").alias("kind"), host.alias("value")))
    )
    return F.when(entry, found)


def _indicator(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"))


def labelled_hashes(blob: Column) -> Column:
    """array<struct<kind,value>> of texts like ``MD5=..,SHA256=..``; labels such as IMPHASH are no file hashes."""
    def one(part: Column) -> Column:
        label = F.lower(F.trim(F.when(part.contains("="), F.substring_index(part, "=", 1)).otherwise("")))
        v = F.lower(F.regexp_replace(F.trim(F.when(part.contains("="), F.substring(part, F.instr(part, "=") + 1, 1 << 30)).otherwise(part)), '^"+|"+$', ""))
        kind = F.when(F.length(v) == 32, "md5").when(F.length(v) == 40, "sha1").when(F.length(v) == 64, "sha256")
        return F.when(v.rlike("^[a-f0-9]+$") & kind.isNotNull() & ~label.isin(SKIPPED_HASH_LABELS), _indicator(kind, v))

    return F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(blob, F.lit("")), ","), one)))


def address_indicator(value: Column) -> Column:
    ip = F.regexp_replace(F.trim(value), r"^[\[\]]+|[\[\]]+$", "")
    return F.when(ip.rlike(IPV4) & ~starts_with_any(ip, IGNORED_IP), _indicator(F.lit("ip"), ip))


def domain_indicator(value: Column) -> Column:
    host = url_host(F.trim(value))
    return F.when(host.rlike(DOMAIN) & ~host.isin(IGNORED_DOMAINS), _indicator(F.lit("domain"), host))
