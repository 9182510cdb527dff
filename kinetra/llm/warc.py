"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader cuts archives into byte ranges. A task looks for the gzip magic in its range, checks each
candidate by inflating it and decoding the record's header, and owns the records that start inside the
range; it reads on past the end to finish the last one. A payload may hold an archive itself, whose members look
like records: so a member counts only if the chain of members before it leads to it. Ranges find their chains side by side; the
chains of an archive, a few rows, are joined over the borders from its first byte on. Where a chain breaks, the place is told as a
row with ``error``, and reading goes on at the next chain that does not break. Files are opened through ``pyarrow.fs``, so any
store with such a driver does; part names carry a random token, and only files named in the manifest of
finished tasks are read, so a task that ran twice leaves no double records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups

SPLIT_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records ----------------------------------------------------------------------------------


def record(kind: str, name: int, uri: str, payload: bytes, sha1: str, refers: int | None) -> bytes:
    """One gzip member. A revisit has no payload block; its header keeps digest and length of the full payload."""
    clean = "".join(c for c in uri if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Payload-Length: {len(payload)}"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


class _Window:
    """Bytes of an open file from any place, read in steps."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.base or place + n > self.base + len(self.data):
            self.file.seek(place)
            self.base, self.data = place, self.file.read(min(max(n, _STEP), self.size - place))
        return self.data[place - self.base : place - self.base + n]


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The inflated member at ``start`` and its end, or None where there is no whole WARC record."""
    inflate, out, at = zlib.decompressobj(31), [], start
    try:
        while not inflate.eof and at < window.size:
            data = window.at(at, min(1 << 14 if at == start else 1 << 16, window.size - at))
            out.append(inflate.decompress(data))
            at += len(data)
            if len(out) == 1 and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, at - len(inflate.unused_data)) if inflate.eof and raw.startswith(b"WARC/") else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lowered) and block of an inflated record; ValueError where it is broken."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the block is shorter than its header says")
    return fields, rest[:n]


def range_records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records whose gzip member starts in [start, end)."""
    window, at = _Window(file, size), start
    while at < end:
        data = window.at(at, min(_STEP, end + len(MAGIC) - 1 - at, size - at))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        try:
            yield (at, *parse(member[0]))
        except (ValueError, KeyError):
            pass
        at = member[1]


def chains(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(head, exit, kind) of the chains of members that start in [start, end). Each goes from member to member: ``past`` the range
    (``exit`` is where it goes on), up to a ``damaged`` member, or to where it ``ended``, at something that is no member at all."""
    window, at = _Window(file, size), start
    while at < end:
        data = window.at(at, min(_STEP, end + len(MAGIC) - 1 - at, size - at))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        head, member = at, _member(window, at)
        if member is None:
            at += 1
            continue
        while member is not None:
            at = member[1]
            if at >= end:
                break
            member = _member(window, at)
        kind = "past" if at >= end else "damaged"
        yield head, at, kind if at >= size or window.at(at, len(MAGIC)) == MAGIC else "ended"


Chain = tuple[int, int, str]


def joined(ranges: list[tuple[int, int, list[Chain]]], size: int) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, str]]]]:
    """The chains that count: for each range (start, end, its chains), in order from 0, (start, stretches to read, errors).

    The first chain begins at 0, and each goes on where the one before left. Where none does, the archive is damaged: the place is an
    error, and the next chain is taken up, unless, followed over the ranges, it ends at something that is no member, as an
    archive inside a damaged record does; such a chain is an error too."""
    heads = {c[0]: c for _, _, own in ranges for c in own}

    def ends(chain: Chain) -> bool:
        while chain[2] == "past" and chain[1] < size:
            chain = heads.get(chain[1], (0, 0, "damaged"))
        return chain[2] == "ended"

    out, at, sure = [], 0, True
    for start, end, own in ranges:
        stretches: list[tuple[int, int]] = []
        errors: list[tuple[int, str]] = []
        while at < min(end, size):
            if sure:
                chain = heads.get(at)
                if chain is None:
                    errors.append((at, "no whole WARC record starts where one should"))
                    sure, at = False, at + 1
                    continue
            else:
                chain = min((c for c in own if c[0] >= at), default=None)
                if chain is None:
                    at = end
                    break
                if ends(chain):
                    errors.append((chain[0], "members after a damaged place, perhaps of an archive inside it"))
                    at = chain[1]
                    continue
                sure = True
            stretches.append(chain[:2])
            at = chain[1]
        out.append((start, stretches, errors))
    return out


def records(file, size: int, stretches: list[dict] | None, errors: list[dict] | None) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, header, block, error) of the members in these stretches, and of these damaged places. Without stretches the file is
    one range: it is read from its first byte, and its chains are looked for only where that one breaks."""
    window, broken = _Window(file, size), None
    for s in [{"a": 0, "b": size}] if stretches is None else stretches:
        at = s["a"]
        while at < s["b"]:
            member = _member(window, at)
            if member is None:
                broken = at
                break
            try:
                yield (at, *parse(member[0]), None)
            except (ValueError, KeyError) as e:
                yield at, {}, b"", f"a broken record: {e}"
            at = member[1]
    for e in errors or ():
        yield e["at"], {}, b"", e["what"]
    if broken is not None and stretches is None:
        first = [(0, broken, "damaged")] if broken else []
        (_, rest, bad), = joined([(0, size, [*first, *chains(file, size, broken, size)])], size)
        yield from records(file, size, [{"a": a, "b": b} for a, b in rest if a >= broken], [{"at": a, "what": w} for a, w in bad])
    elif broken is not None:
        yield broken, {}, b"", "no whole WARC record starts where one should"


# ---- DataFrames -------------------------------------------------------------------------------


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` plus ``sha1``, ``record_type`` and ``refers_to``: of records with equal
    payloads of ``least`` bytes or more, the smallest page_id is the response and others revisit it.

    Revisits are found on digests alone and written; pages meet that list by page_id, so that no payload moves by
    a digest that many pages have."""
    scratch = Scratch(pages.sparkSession, "types")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    names = p.where(F.octet_length("html") >= least).select("page_id", "sha1")
    groups = scratch.table(names.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    known = join_groups(names, groups, ["sha1"], "n", groups.agg(F.sum("n")).first()[0] or 0, ["page_id"])
    known = known.where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = scratch.table(known.select(F.struct("page_id", "sha1").alias("of"), "first").distinct())
    joined = p.withColumn("key", F.struct("page_id", "sha1")).join(revisits, F.col("key") == F.col("of"), "left")
    revisit = F.col("first").isNotNull()
    return joined.select("page_id", "url", "html", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"))


def write_warc(typed: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition of ``typed(page_id, url, html, record_type, refers_to, ...)``; ``(path, bytes, records)`` of the
    files of finished tasks. A null html is an empty payload, a null url an empty target, a null page_id the id None."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                cols = [batch.column(c) for c in ("page_id", "url", "html", "record_type", "refers_to")]
                for i in range(batch.num_rows):
                    page, url, html, kind, refers = (c[i].as_py() for c in cols)
                    payload = (html or "").encode()
                    data = record(kind, page, url or "", payload, digest(payload), refers)
                    out.write(data)
                    count, size = count + 1, size + len(data)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

    return typed.mapInArrow(run, "path string, bytes long, records long")


_CHAIN = "path string, start long, head long, out long, kind string, bytes long"
_PLAN = "path string, start long, bytes long, stretches array<struct<a: long, b: long>>, errors array<struct<at: long, what: string>>"


def _ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    return ranges.repartition(max(1, min(10_000, ranges.count())), "path", "start")


def plans(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path, start, bytes, stretches, errors``: what each range of the archives ``files(path, bytes)`` has to read, by chains that
    lead to it from the archive's first byte. Of an archive, the chains of all its ranges meet in one task: a few rows a range."""

    def find(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                with fs.open_input_file(path) as file:
                    found = list(chains(file, size, start, min(size, start + split_bytes)))
                out += [(path, start, *c, size) for c in found] or [(path, start, None, None, None, size)]
            if out:
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], ["path", "start", "head", "out", "kind", "bytes"])

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["head"] if r["head"] is not None else -1))
        path, size, by = rows[0]["path"], rows[0]["bytes"], {}
        for r in rows:
            by.setdefault(r["start"], []).extend([(r["head"], r["out"], r["kind"])] if r["head"] is not None else [])
        done = joined([(s, min(size, s + split_bytes), c) for s, c in by.items()], size)
        made = [{"path": path, "start": s, "bytes": size, "stretches": [{"a": a, "b": b} for a, b in x], "errors": [{"at": a, "what": w} for a, w in e]} for s, x, e in done]
        pair = lambda a, b, kind: pa.list_(pa.struct([(a, pa.int64()), (b, kind)]))
        return pa.Table.from_pylist(made, pa.schema([("path", pa.string()), ("start", pa.int64()), ("bytes", pa.int64()), ("stretches", pair("a", "b", pa.int64())), ("errors", pair("at", "what", pa.string()))]))

    return _ranges(files, split_bytes).mapInArrow(find, _CHAIN).groupBy("path").applyInArrow(join, _PLAN)


def read_warc(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``files(path, bytes)``: ``path, offset, record_id, warc_type, target_uri, payload_digest,
    refers_to_id, payload_length, payload, error``. ``payload`` is the HTTP body, null for revisits.

    Damaged places, and records whose block is shorter than their header says, are rows with ``error`` and nulls but for path and
    offset; an archive within a payload gives no records. Empty files and an empty table give no rows.
    """
    whole = files.where(F.col("bytes") <= split_bytes).select("path", F.lit(0).cast("long").alias("start"), "bytes", F.lit(None).cast("array<struct<a: long, b: long>>").alias("stretches"), F.lit(None).cast("array<struct<at: long, what: string>>").alias("errors"))
    tasks = whole.where("bytes > 0").unionByName(plans(files.where(F.col("bytes") > split_bytes), folder, split_bytes))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    tasks = tasks.repartition(max(1, min(10_000, int(n))), "path", "start")
    names = ["path", "offset", "record_id", "warc_type", "target_uri", "payload_digest", "refers_to_id", "payload_length", "payload", "error"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, stretches, errors in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "stretches", "errors"))):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, head, block, error in records(file, size, stretches, errors):
                        if error is not None:
                            rows.append((path, offset, None, None, None, None, None, None, None, error))
                            continue
                        kind = head.get("warc-type", "")
                        payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                        length = int(head["warc-payload-length"]) if "warc-payload-length" in head else len(payload or b"")
                        rows.append((path, offset, head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to", "").strip("<>") or None, length, payload, None))
                        held += len(block)
                        if held > _STEP * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return tasks.mapInArrow(run, "path string, offset long, record_id string, warc_type string, target_uri string, payload_digest string, refers_to_id string, payload_length long, payload binary, error string")


def _page_digest(records: DataFrame) -> DataFrame:
    """Contract columns; a response's digest and length come from the payload as read back."""

    def run(batches):
        for batch in batches:
            out = []
            for name, kind, said, refers, length, payload, error in zip(*(batch.column(c).to_pylist() for c in ("record_id", "warc_type", "payload_digest", "refers_to_id", "payload_length", "payload", "error"))):
                if error is not None:
                    raise ValueError(f"an archive is damaged: {error}")
                number = lambda s: None if s is None or s.endswith(":None") else int(s.rpartition(":")[2])
                sha1 = digest(payload) if kind == "response" else said.partition(":")[2]
                out.append((number(name), len(payload) if kind == "response" else length, sha1, kind, number(refers)))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html, ...)`` as archives in the shared folder and reads their records back.

    Null html is an empty payload, null url an empty target; a null page_id keeps its record (id null, and
    never a response that others refer to unless all copies are null). Repeated rows each give a record, of
    which those with the smallest page_id are responses. Other columns are ignored; an empty table gives an
    empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.folder()
    files = scratch.table(write_warc(with_types(pages, least), folder))
    return read_warc(files, folder, split_bytes)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return _page_digest(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
