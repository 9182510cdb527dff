"""The archive reader on archives inside records, damaged and cut members, at every size of ranges."""

import io
import random
import zlib

import pytest

from kinetra.llm import warc


def stored(i, payload):
    """A record that is stored, not packed, so that what its payload holds shows."""
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(payload) + 4)
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def packed(i, payload):
    return warc.record("response", i, "http://x", payload, warc.digest(payload), None)


def archive(parts):
    at, out = [], b""
    for p in parts:
        at.append(len(out))
        out += p
    return out, at


def read(raw, step):
    """(offset, number or None where it is an error) in order, as tasks over ranges read it."""
    file = io.BytesIO(raw)
    cuts = [(a, min(len(raw), a + step)) for a in range(0, len(raw), step)]
    if len(cuts) == 1:
        found = list(warc.records(file, len(raw), None, None))
    else:
        plan = warc.joined([(a, b, list(warc.chains(file, len(raw), a, b))) for a, b in cuts], len(raw))
        found = [r for _, s, e in plan for r in warc.records(file, len(raw), [{"a": a, "b": b} for a, b in s], [{"at": a, "what": w} for a, w in e])]
    return sorted((at, None if error else int(head["warc-record-id"].strip("<>").rpartition(":")[2])) for at, head, _, error in found)


def noise(n, seed):
    return random.Random(seed).randbytes(n)


INNER, _ = archive([packed(900 + i, noise(40, i)) for i in range(12)])
STEPS = [37, 200, 513, 1000, 2049, 10**6]


@pytest.mark.parametrize("step", STEPS)
def test_archives_inside_records_give_none(step):
    parts = [packed(0, b"a"), stored(1, INNER), packed(2, noise(500, 2)), stored(3, noise(90, 3) + INNER), stored(4, INNER + noise(30, 4)), packed(5, b"")]
    raw, at = archive(parts)
    assert read(raw, step) == list(zip(at, range(6)))


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("hit", [0, 3, 5])
def test_a_damaged_record_is_told_and_others_are_read(step, hit):
    raw, at = archive([packed(i, noise(300, i)) for i in range(6)])
    data = bytearray(raw)
    end = at[hit + 1] if hit < 5 else len(raw)
    middle = (at[hit] + end) // 2
    data[middle : middle + 20] = bytes(20)
    assert read(bytes(data), step) == [(a, None if i == hit else i) for i, a in enumerate(at)]


@pytest.mark.parametrize("step", STEPS)
def test_two_damaged_records_lose_nothing_between(step):
    raw, at = archive([packed(i, noise(300, i)) for i in range(9)])
    data = bytearray(raw)
    for hit in (2, 6):
        data[at[hit] + 150 : at[hit] + 170] = bytes(20)
    assert read(bytes(data), step) == [(a, None if i in (2, 6) else i) for i, a in enumerate(at)]


@pytest.mark.parametrize("step", STEPS)
def test_a_damaged_record_does_not_let_its_inner_records_out(step):
    raw, at = archive([packed(0, b"a"), stored(1, INNER), packed(2, noise(500, 2)), packed(3, b"")])
    data = bytearray(raw)
    data[at[1] + 60] ^= 0xFF  # in its header, so that it does not inflate as a record
    data[at[2] - 3] ^= 0xFF  # nor by its checksum
    got = read(bytes(data), step)
    assert [r for r in got if r[1] is not None] == [(at[0], 0), (at[2], 2), (at[3], 3)]
    assert (at[1], None) in got and all(at[1] <= a < at[2] for a, n in got if n is None)


@pytest.mark.parametrize("step", STEPS)
def test_a_cut_archive_tells_its_last_record(step):
    raw, at = archive([packed(i, noise(300, i)) for i in range(4)])
    assert read(raw[:-40], step) == [*zip(at[:3], range(3)), (at[3], None)]
    assert read(b"no archive at all, only text " * 20, step) == [(0, None)]


@pytest.mark.parametrize("split", [300, 10**6])
def test_errors_are_rows(spark, tmp_path, split):
    raw, at = archive([packed(i, noise(300, i)) for i in range(5)])
    data = bytearray(raw)
    data[at[2] + 150 : at[2] + 170] = bytes(20)
    short = zlib.compressobj(4, zlib.DEFLATED, 31)
    tail = short.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 99\r\n\r\nshort") + short.flush()
    (tmp_path / "a.warc.gz").write_bytes(bytes(data) + tail)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data) + len(tail)), (str(tmp_path / "empty.warc.gz"), 0)], "path string, bytes long")
    rows = warc.read_warc(files, f"file://{tmp_path}", split).orderBy("offset").collect()
    assert [(r.offset, r.record_id, bool(r.error)) for r in rows] == [*((at[i], f"urn:page:{i}", False) if i != 2 else (at[2], None, True) for i in range(5)), (len(raw), None, True)]
    assert [bytes(r.payload) for r in rows if r.payload is not None] == [noise(300, i) for i in (0, 1, 3, 4)]
    with pytest.raises(Exception, match="damaged"):
        warc._page_digest(warc.read_warc(files, f"file://{tmp_path}", split)).collect()
    assert warc.read_warc(files.limit(0), f"file://{tmp_path}").count() == 0


def test_nulls_are_written_when_called_directly(spark, tmp_path):
    typed = spark.createDataFrame([(None, None, None, "response", None), (1, "http://a", "x", "response", None)], "page_id long, url string, html string, record_type string, refers_to long")
    folder = f"file://{tmp_path}/w"
    files = warc.write_warc(typed.coalesce(1), folder).collect()
    rows = warc.read_warc(spark.createDataFrame(files), folder).orderBy("offset").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == [("urn:page:1", b"x"), ("urn:page:None", b"")]
