import gzip
import random
import time

from veilframe.llm import warc
from veilframe.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, type string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows():
    same = "<p>the same é</p>" * 30
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n \x1f\u008b\x08"
    return [(5, "http://a/5", same, None), (3, "http://a/3", same, "x"), (9, None, same, "y"), (1, "http://a/é b\r\nX: y", "", None), (2, "", None, None), (7, "u", odd, None), (8, "u", "z" * 300_000, None), (8, "u", "other text of a repeated id", None), (-4, "u", "negative", None), (None, "u", same, None)]


def expected(some, least=0):
    first = {}
    for i, _, h, _ in some:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, _ in some:
        data = (h or "").encode()
        again = len(data) >= least and (h or "") in first and i != first[h or ""]
        out.append((i, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_write_and_read(spark):
    for least in (0, 20):
        path = fresh_path(spark, "warc-test")
        warc.write_archive(pages(spark, rows()), path, min_bytes=least, records_per_file=3)
        read = warc.read_archive(spark, path)
        assert read.filter("reason is not null").count() == 0
        assert sorted(map(tuple, warc.page_records(read).collect()), key=str) == expected(rows(), least)
        got = {bytes(r["payload"]) for r in read.filter("type = 'response'").collect()}
        assert got == {(r[2] or "").encode() for r in rows()}


def test_rows_that_share_an_id(spark):
    made = [(3, "u", "first", None), (4, "u", "second", None), (None, "a", "first", None), (None, "b", "second", None), (None, "c", "only here", None), (None, "d", "first", None), (9, "e", "first", None), (9, "f", "under a repeated id", None), (9, "g", "second", None)]
    path = fresh_path(spark, "warc-test")
    warc.write_archive(pages(spark, made), path)
    read = warc.read_archive(spark, path)
    assert sorted(map(tuple, warc.page_records(read).collect()), key=str) == expected(made)
    assert {bytes(r["payload"]) for r in read.filter("type = 'response'").collect()} == {r[2].encode() for r in made}


def test_empty_table(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archive(pages(spark, []), path)
    assert warc.read_archive(spark, path).collect() == []


def archive(rng, compressed):
    records = []
    for k in range(30):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400)))
        record = warc.make_record(k, f"u{k}", payload, warc.digest(payload), None) + b"\r\n\r\n"
        records.append(gzip.compress(record) if compressed else record)
    return records


def test_salvage_recovers_what_is_whole():
    rng = random.Random(6)
    for compressed in (False, True):
        for _ in range(25):
            records = archive(rng, compressed)
            assert [warc.page_id(r["record_id"]) for r in warc.salvage(b"".join(records))] == list(range(30))
            broken = set(rng.sample(range(30), 4))
            data, spans = b"", {}
            for k, record in enumerate(records):
                if k in broken:
                    at = rng.randrange(len(record))
                    kind = rng.choice(["cut", "noise", "junk"])
                    if kind == "cut":
                        record = record[: max(1, at)]
                    elif kind == "noise":
                        record = record[:at] + bytes([record[at] ^ 0x55]) + record[at + 1 :]
                    else:
                        record = b"garbage WARC/1.1\r\n\x1f\x8b\x08 garbage" + record
                        broken = broken - {k}
                spans[k] = (len(data), len(data) + len(record))
                data += record
            found = list(warc.salvage(data))
            whole = {warc.page_id(f["record_id"]) for f in found if "record_id" in f}
            assert whole >= set(range(30)) - broken
            at = 0
            for f in found:  # records and gaps cover every byte once
                assert f["offset"] == at
                at += f["length"]
            assert at == len(data)


def test_members_of_several_records():
    rng = random.Random(8)
    records = archive(rng, False)
    ids = lambda found: [warc.page_id(f["record_id"]) for f in found if "record_id" in f]
    for level in (0, 9):
        packed = gzip.compress(b"".join(records), level)
        assert ids(warc.salvage(packed)) == list(range(30))
        cut = list(warc.salvage(packed[: len(packed) * 2 // 3]))
        assert ids(cut) == list(range(len(ids(cut)))) and 15 <= len(ids(cut)) < 30
        assert cut[-1]["offset"] == 0 and cut[-1]["length"] == len(packed) * 2 // 3 and "reason" in cut[-1]
        wrong = list(warc.salvage(packed[:-8] + bytes(4) + packed[-4:]))  # another checksum
        assert ids(wrong) == list(range(30)) and "reason" in wrong[-1]
        inside = gzip.compress(b"".join([*records[:9], records[9][:-30], *records[10:]]), level)
        found = list(warc.salvage(inside + gzip.compress(records[9])))
        assert ids(found) == [*range(9), *range(10, 30), 9] and [f["offset"] for f in found if "reason" in f] == [0]


def test_files_with_gaps(spark):
    rng = random.Random(7)
    path = fresh_path(spark, "warc-test").removeprefix("file://")
    import os

    os.makedirs(path)
    plain = b"".join(archive(rng, False))
    for name, data in (("a.warc", b"junk" + plain), ("b.warc.gz", b"".join(archive(rng, True))[:-10]), ("c.warc", b""), ("d.warc", b"\x1f\x8b\x08nothing")):
        with open(f"{path}/{name}", "wb") as file:
            file.write(data)
    got = warc.read_archive(spark, f"file://{path}", payloads=False)
    assert got.filter("reason is null").count() == 59
    gaps = {(r["file"][-6:], r["offset"], r["length"]) for r in got.filter("reason is not null").collect()}
    assert ("a.warc", 0, 4) in gaps and ("d.warc", 0, 10) in gaps and len(gaps) == 3


def plain_salvage(data):
    """Ids and places of records, and gaps: every version line tried apart, the headers split at the next empty line."""
    found, at, broken = [], 0, None
    while at < len(data):
        try:
            record, end = warc.parse_record(data, at)
        except ValueError:
            broken = at if broken is None else broken
            again = warc._start.search(data, at + 1)
            at = again.start() if again else len(data)
            continue
        if broken is not None:
            found.append((None, broken, at - broken))
        broken = None
        found.append((record["record_id"], at, end - at))
        at = end
    if broken is not None:
        found.append((None, broken, len(data) - broken))
    return found


def test_what_is_remembered_of_lines_changes_nothing():
    rng = random.Random(11)
    whole = warc.make_record(1, "u", b"abc", warc.digest(b"abc"), None) + b"\r\n\r\n"
    pieces = [b"WARC/1.1\r\n", b"WARC/1.0\r\n", b"a: b\r\n", b"x: WARC/1.1\r\n", b"Content-Length: 3\r\n", b"Content-Length: 0\r\n", b"content-length: x\r\n", b"\r\n", b"abc", b"\r\n\r\n", b"WARC-Block-Digest: sha1:ABC\r\n", b"Content-Type: application/http\r\n", b"WARC-Type: response\r\n", b":\r\n", b"\r", b"\n", b"no colon\r\n", whole, whole[:-30], b"WARC-Payload-Digest: sha1:" + warc.digest(b"abc").encode() + b"\r\n"]
    for _ in range(3000):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        got = [(f.get("record_id"), f["offset"], f["length"]) for f in warc.salvage(data)]
        assert got == plain_salvage(data), data


def test_damaged_bytes_are_read_once():
    whole = warc.make_record(1, "u", b"abc", warc.digest(b"abc"), None) + b"\r\n\r\n"
    lines = [b"WARC/1.1\r\n", b"x: WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\n", b"Content-Length: 7 WARC/1.1\r\n"]
    for line in lines:
        start = time.process_time()
        found = list(warc.salvage(line * (10_000_000 // len(line)) + b"\r\n" + whole))
        assert time.process_time() - start < 30
        assert warc.page_id(found[-1]["record_id"]) == 1 and len(found) == 2


def test_files_are_rolled_by_bytes(spark):
    import glob
    import os

    made = [(k, "u", "z" * (200_000 if k % 10 == 0 else 2_000_000 if k == 5 else 300), None) for k in range(60)]
    path = fresh_path(spark, "warc-test")
    warc.write_archive(pages(spark, made), path, records_per_file=50, file_bytes=500_000)
    sizes = [os.path.getsize(f) for f in glob.glob(path.removeprefix("file://") + "/part-*")]
    assert sum(s > 500_000 for s in sizes) == 1 and len(sizes) < 20
    read = warc.read_archive(spark, path)
    assert sorted(map(tuple, warc.page_records(read).collect()), key=str) == expected(made) and read.filter("reason is not null").isEmpty()
