"""Records of files in many splits against a plain walk over the whole file, damage at every place, and odd files."""

import gzip
import random
import re

import pytest

from docatlas.sources import splits as S


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "37"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def plain_records(data, start=None, joins=False):
    """One walk over the bytes."""
    out, held, at, inside, place = [], [], 0, False, 0
    for line in data.split(b"\n")[: None if not data.endswith(b"\n") else -1]:
        sound = bool(start and re.match(start.encode(), line))
        goes_on = not sound and (inside or bool(joins and re.match(rb"[A-Za-z0-9+/=]{30,}", line) and b"," not in line))
        if not goes_on and held:
            out.append((place, b"\n".join(held)))
            held = []
        if not held:
            place = at
        if sound:
            inside = False
        held.append(line)
        i = 0
        while i < len(line):
            if inside and line[i] == 92:
                i += 1
            elif line[i] == 34:
                inside = not inside
            i += 1
        at += len(line) + 1
    if held:
        out.append((place, b"\n".join(held)))
    parted = []
    for place, r in out:
        begun, inside, i = 0, False, 0
        while i < len(r):
            if r[i] == 13 and not inside:
                parted.append((place + begun, r[begun:i]))
                begun = i + 1
            elif inside and r[i] == 92:
                i += 1
            elif r[i] == 34:
                inside = not inside
            i += 1
        parted.append((place + begun, r[begun:]))
    return [(o, r) for o, r in parted if r]


def read(spark, path, **kw):
    return sorted((r.offset, bytes(r.record)) for r in S.records(spark, str(path), **kw).collect())


@pytest.mark.parametrize("seed", range(6))
def test_splits_equal_one_walk(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    data = "".join(r.choice(['"', '""', "\\", '\\"', "\n", "\n", "\r\n", "\r", ",", "a", "é", "12,3,", "x" * 9, "A" * 31]) for _ in range(400)).encode()
    (tmp_path / "f.csv").write_bytes(data)
    assert S._lines(spark, str(tmp_path)).select("split").distinct().count() > 5
    assert read(spark, tmp_path) == plain_records(data)
    assert read(spark, tmp_path, joins=True) == plain_records(data, joins=True)
    assert read(spark, tmp_path, start="[0-9]+,[0-9]") == plain_records(data, "[0-9]+,[0-9]")


def test_splits_beyond_a_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 0)
    data = b"".join(b'%d,"a\nb %d","c"\n' % (i, i) for i in range(60))
    (tmp_path / "f.csv").write_bytes(data)
    assert read(spark, tmp_path) == plain_records(data)


def test_a_record_over_many_splits_and_files_apart(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'1,"' + b"line\n" * 100 + b'"\n2,b\n3,"open')
    (tmp_path / "b.csv").write_bytes(b"4,d\n")
    got = sorted((r.path.rsplit("/", 1)[-1], r.offset, len(r.record)) for r in S.records(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 0, 504), ("a.csv", 505, 3), ("a.csv", 509, 7), ("b.csv", 0, 3)]


def test_fields_and_rejects(spark, tmp_path, small_splits):
    body = b'h1,h2,h3\n1,"say ""so"" now",\\N\n2,"two\nlines","a\\"b\\tc"\nbroken,row\n3,,"x\\\\n"\n4,"\xff\xfe",\\n\n'
    (tmp_path / "d.csv").write_bytes(body)
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress(body))
    good, bad = S.dump(spark, str(tmp_path), ["a", "b", "c"], header=True)
    want = [("1", 'say "so" now', None), ("2", "two\nlines", 'a"b\tc'), ("3", "", "x\\n"), ("4", "��", "\\n")]
    for name in ("d.csv", "e.csv.gz"):
        assert sorted((r.a, r.b, r.c) for r in good.collect() if r.path.endswith(name)) == want
    assert sorted((bytes(r.record), r.offset, r.reason) for r in bad.collect()) == [(b"broken,row", body.index(b"broken"), "2 fields, not 3")] * 2


def test_broken_records_are_joined_or_told(spark, tmp_path, small_splits):
    lines = ['1,"open', 'still, open",x,y', "2,b,x," + "y" * 3, "A" * 40, '3,"fine",x,y', '"tail": 1}', "4,x"]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    good, bad = S.dump(spark, str(tmp_path), list("abcd"), joins=True)
    assert sorted((r.a, r.b, r.d) for r in good.collect()) == [("1", "open\nstill, open", "y"), ("2", "b", "yyy\n" + "A" * 40), ("3", "fine", "y")]
    assert sorted((bytes(r.record), r.reason) for r in bad.collect()) == [(b'"tail": 1}', "a fragment of JSON"), (b"4,x", "2 fields, not 4")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "n.csv").write_bytes(b"\n\n\r\n")
    assert read(spark, tmp_path) == []
    good, bad = S.dump(spark, str(tmp_path), ["a"])
    assert good.count() == bad.count() == 0


ROWS = [b'%d,%d,%d,%d,"code\x00\xff%d\nin two","md5:%d","g"' % (i, i, i, i, i, i) for i in range(12)]


@pytest.mark.parametrize("damage", [b'"', b"\n", b'"\n"', b"\\", b"\x00\xff,,\n", b'\n9,"'])
def test_no_sound_row_is_lost_to_damage(spark, tmp_path, small_splits, damage):
    """Damage at many places of one row, a file for each place: all other rows come out, and the damaged one or what is left of it is reported."""
    sound, at = b"\n".join(ROWS) + b"\n", sum(len(r) + 1 for r in ROWS[:5])
    for i in range(0, len(ROWS[5]) + 1, 3):
        (tmp_path / f"{i:03d}.csv").write_bytes(sound[: at + i] + damage + sound[at + i :])
    good, bad = S.codes(spark, str(tmp_path))
    found, told = {}, {}
    for r in good.collect():
        found.setdefault(r.path.rsplit("/", 1)[-1], set()).add(int(r.row_number))
    for r in bad.collect():
        told.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.offset, bytes(r.record)))
    for name, numbers in found.items():
        assert numbers >= set(range(12)) - {4, 5} and (4 in numbers or int(name[:3]) == 0)
        if 5 not in numbers:
            assert told[name]
        for offset, record in told.get(name, []):
            assert (tmp_path / name).read_bytes()[offset : offset + len(record)] == record
