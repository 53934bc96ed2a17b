import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import assert_same
from tracelake import catalog
from tracelake.sources import yara

RULES = r'''
// a comment with { braces
rule Text : demo two { meta: severity = "high" attack = "T1027" strings: $a = "Evil\x21" nocase $b = "wide" wide condition: $a and not $b }
rule Hex { strings: $h = { 4D 5A ?? 0? [1-2] (AA | BB) } condition: $h at 0 and filesize < 1KB and uint16(0) == 0x5A4D }
rule Regex { strings: $r1 = /ab+c/i $r2 = "}{" $x = "no" fullword condition: 2 of ($r*) and #x == 1 }
rule Modules { condition: pe.is_dll }
'''


def names(data: bytes):
    done, _ = yara.compile_rules(RULES)
    return [r.name for r in done if r.match(data) is not None]


def test_rules_are_split_and_refused():
    done, refused = yara.compile_rules(RULES)
    assert [r.name for r in done] == ["Text", "Hex", "Regex"] and [r[0] for r in refused] == ["Modules"]
    assert done[0].tags == ["demo", "two"] and done[0].meta == {"severity": "high", "attack": "T1027"}


@pytest.mark.parametrize(("data", "want"), [
    (b"some EVIL! here", ["Text"]), (b"evil! w\0i\0d\0e\0", []), (b"MZ\x90\x03\x01\xaa", ["Hex"]), (b"MZ\x90\x13\x01\xaa", []), (b"xMZ\x90\x03\x01\xaa", []), (b"xABBC }{ no", ["Regex"]), (b"abc }{ nono", []), (b"", []),
])
def test_matches(data, want):
    assert names(data) == want


def test_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"evil!")
    (tmp_path / "b.bin").write_bytes(b"fine")
    (tmp_path / "c.bin").write_bytes(b"evil!" * 100)
    got = yara.scan_files(spark, str(tmp_path), RULES, "c", "h", largest=100).orderBy("path").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["rule"], r["attack"], r["matched_on"], r["state"]) for r in got] == [("a.bin", "Text", ["T1027"], "$a", "matched"), ("c.bin", None, None, None, "skipped")]
    assert len({r["artifact_id"] for r in got}) == 2 and got[1]["sha256"] is None


SLOW = r"""
rule Slow { strings: $s = /(a|aa)+$/ condition: $s }
rule Fast { strings: $f = "aab" condition: $f }
"""


def test_a_file_that_takes_too_long_is_told(spark, tmp_path):
    (tmp_path / "slow.bin").write_bytes(b"a" * 60 + b"b")
    (tmp_path / "fast.bin").write_bytes(b"xaabx")
    got = yara.scan_files(spark, str(tmp_path), SLOW, "c", "h", seconds=0.5).orderBy("path", "rule").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["rule"], r["state"]) for r in got] == [("fast.bin", "Fast", "matched"), ("slow.bin", None, "timed out")]


MANY = r"""
rule A { strings: $a = "Alpha" nocase $b = "beta" wide ascii condition: any of them }
rule B { strings: $a = "alpha" fullword $n = "never" condition: $a and not $n }
rule C { strings: $h = { 61 6C (70 | 71) ?? 62 65 } condition: #h > 1 or not $h }
rule D { strings: $r = /g[a-c]mma/ condition: $r }
rule E { strings: $x = "zz" condition: #x == 0 and filesize > 3 }
rule F { strings: $x = "qq" $y = "beta" condition: all of them or uint8(0) == 0x67 }
rule G { strings: $e = "" $y = "\x00\xff" condition: $y }
"""


@given(st.lists(st.sampled_from([b"Alpha", b"alpha", b"beta", b"b\0e\0t\0a\0", b"never", b"alpxbe", b"alqybe", b"gamma", b"gbmma", b"zz", b"qq", b" ", b"x", b"\0\xff", b"\xc9"]), max_size=7))
@settings(max_examples=120, deadline=None)
def test_scanner_finds_what_each_rule_finds(parts):
    done, refused = yara.compile_rules(MANY)
    assert not refused
    data = b"".join(parts)
    want = [(r.name, hit) for r in done if (hit := r.match(data)) is not None]
    assert [(r.name, hit) for r, hit in yara.Scanner(done).scan(data, 30)] == want


def test_query_equals_its_sql(spark, tiny):
    assert_same(catalog.QUERIES["yara_documents"](spark, tiny), catalog.ORACLE["yara_documents"], tiny)
