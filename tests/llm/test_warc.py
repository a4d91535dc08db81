import gzip
import hashlib
import random
from base64 import b32encode

import pytest

from pagewarden.llm import warc

PAGES = "page_id long, url string, html string, payload string, reason string, _id string"


def build(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "r", "x") for i, u, h in rows], PAGES)


def expected(rows):
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in rows:
        data, first = (h or "").encode(), firsts.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(repr, out))


ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ b\nc", ""), (5, "http://a/5", "WARC/1.1\r\nWARC-Type: fake\r\n\r\n"),
    (6, "http://a/é", "é😀" * 3000), (7, "u", "line\n"), (7, "u", "line\n"), (8, "u", "line"), (None, "u", "<p>x</p>"), (9, "u", "\r\n\r\n"), (0, "u", "line\n"),
]


def test_round_trip(spark):
    got = warc.round_trip(build(spark, ROWS)).collect()
    assert all(r.reason is None for r in got)
    number = lambda s: int(s[10:-1]) if s and s[10:-1] else None
    assert sorted(repr((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to))) for r in got) == expected(ROWS)


def test_empty_table_and_least_size(spark, tmp_path):
    assert warc.round_trip(build(spark, [])).count() == 0
    warc.write(build(spark, ROWS), str(tmp_path / "w"), least=6)
    got = warc.read(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert {r.record_type for r in got if r.payload_bytes < 6} == {"response"}
    assert bytes(next(r for r in got if r.record_id == "<urn:page:6>").payload).decode() == ROWS[5][2]


RECORDS = [warc.record(i, f"http://a/{i}", f"{i} WARC/1.1\r\n".encode() * (i * 40), 1 if i % 4 == 0 else None) for i in range(1, 13)]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_keeps_all_whole_records(zipped):
    parts = [gzip.compress(r) for r in RECORDS] if zipped else RECORDS
    rng, data = random.Random(4), b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    assert [(x.offset, x.length) for x in warc.salvage(data)] == [(a, b - a) for a, b in zip(starts, starts[1:])]
    for _ in range(60):
        hit = rng.randrange(len(data))
        broken = data[:hit] + bytes([data[hit] ^ rng.randint(1, 255)]) + data[hit + 1 :]
        found = list(warc.salvage(broken))
        assert sum(x.length for x in found) == len(data) or zipped
        good = {(x.offset, x.length) for x in found if not x.reason}
        whole = {(a, b - a) for a, b in zip(starts, starts[1:]) if not a <= hit < b}
        assert whole <= good


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_after_cuts_and_junk(zipped):
    parts = [gzip.compress(r) for r in RECORDS] if zipped else RECORDS
    cut = parts[0] + parts[1][: len(parts[1]) // 2] + b"junk" + b"".join(parts[2:6]) + parts[6][: len(parts[6]) // 2]
    found = list(warc.salvage(cut))
    assert [x.fields["warc-record-id"] for x in found if not x.reason] == [f"<urn:page:{k}>" for k in (1, 3, 4, 5, 6)]
    assert [x.length for x in found if x.reason] == [len(parts[1]) // 2 + 4, len(parts[6]) // 2]
    assert list(warc.salvage(b"")) == [] and [x.reason for x in warc.salvage(b"no archive")] == ["no version line"]


def ids(found):
    return [int(x.fields["warc-record-id"][10:-1]) for x in found if not x.reason]


def test_members_of_several_records_and_mixed_archives():
    whole = gzip.compress(b"".join(RECORDS))
    found = list(warc.salvage(whole))
    assert ids(found) == list(range(1, 13)) and sum(x.length for x in found) == len(whole) and [x.inner for x in found][:2] == [0, len(RECORDS[0])]
    mixed = RECORDS[0] + gzip.compress(RECORDS[1]) + b"\0\0" + RECORDS[2] + gzip.compress(b"no record") + gzip.compress(RECORDS[3] + b"junk" + RECORDS[4])
    found = list(warc.salvage(mixed))
    assert ids(found) == [1, 2, 3, 4, 5] and [(x.length, x.inner is None) for x in found if x.reason] == [(2, True), (len(gzip.compress(b"no record")), True), (0, False)]


def test_what_a_broken_member_gives_is_searched():
    big = [warc.record(k, "http://a/", random.Random(k).randbytes(3000)) for k in range(6)]
    member, rest = gzip.compress(b"".join(big)), gzip.compress(RECORDS[0])
    found = list(warc.salvage(member[: len(member) * 3 // 4] + rest))
    assert ids(found) == [0, 1, 2, 3, 1] and len([x for x in found if x.reason]) == 1
    found = list(warc.salvage(member[:-3] + rest))
    assert ids(found) == [0, 1, 2, 3, 4, 5, 1]


def test_archives_are_packed_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    rows = [(i, f"http://a/{i}", f"{i} " * 300) for i in range(200)] + [(1000 + i, "http://b", f"{i}" * 90_000) for i in range(2)]
    warc.write(build(spark, rows).coalesce(1), str(tmp_path / "w"))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part*"))
    assert sizes[-2] > 90_000 and sizes[-3] <= 100_000 + 5 and len([s for s in sizes if s <= 100_000 + 5]) <= 4
    assert warc.read(spark, str(tmp_path / "w")).where("reason is null").count() == len(rows)


def test_gaps_are_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS[0] + b"xx" + RECORDS[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(RECORDS[2])[:40] + gzip.compress(RECORDS[3]))
    got = warc.read(spark, str(tmp_path)).orderBy("archive", "start").collect()
    assert [(r.archive.rpartition("/")[2], r.length, r.reason) for r in got if r.reason][0] == ("a.warc", 2, "no version line")
    assert sum(r.reason is not None for r in got) == 2
    assert [r.record_type for r in got if not r.reason] == ["response", "response", "revisit"]


def test_tasks_share_an_archive(spark, monkeypatch):
    """A task that holds a whole archive of full size takes more than an executor has."""
    openings = ["WARC/1.1\r\n", "WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"]
    rows = [(i, f"http://a/{i}", openings[i % 3] * (i % 11) + "x" * (i % 97)) for i in range(300)]
    pages = build(spark, rows).coalesce(1)
    number = lambda s: int(s[10:-1]) if s else None
    for size in (1 << 20, 4099, 701):
        with monkeypatch.context() as m:
            m.setattr(warc, "read", lambda s, path, info=None, read=warc.read: read(s, path, True, info))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            try:
                found = warc.round_trip(pages)
                got, tasks = found.collect(), found.rdd.getNumPartitions()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len({r.archive for r in got}) == 1 and (tasks > 10 or size > 5000)
        assert sorted(repr((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to))) for r in got) == expected(rows)
        assert all(bytes(r.payload).decode() == (rows[number(r.record_id)][2] if r.record_type == "response" else "") for r in got)
