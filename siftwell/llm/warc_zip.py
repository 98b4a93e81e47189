"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package holds two stored (not ZIP-compressed) members: ``archive/data.warc.gz``, one gzip
member for each record, and ``indexes/index.cdx``, a line for each record with its offset and
length in the first.  The reader parses the end record, the ZIP64 locator and end record
where present, and the central directory; it then reads ranges of the package only.

Payloads are hashed in the JVM; the smallest id for each repeated digest is found by partial
aggregation and joined back (broadcast below ``broadcast_digests`` rows, by shuffle beyond), so a
payload with millions of copies is never gathered.  A task writes packages of bounded size under
names made of its partition; a repeated task writes the same files again, first under a name of
its own and then renamed.  Reading deals out blocks of the indexes, not packages.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs), in a shared folder.

Defined results.  Null payload: empty.  Null url: no WARC-Target-URI.  Null id: always a response.
Repeated ids: each row is a record; all rows of the smallest id are responses.  Empty table: no
package, empty result.  Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_NONE16, _NONE32 = 0xFFFF, 0xFFFFFFFF


class ZipError(ValueError):
    """A package that can't be read, with the reason."""


class ZipPackage:
    """The members of a ZIP file, by ranged reads.  ``file`` needs seek, tell and read."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        self.size = file.tell()
        self.members = dict(self._directory())

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ZipError(f"{n} bytes at {at} are beyond the end")
        return got

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        tail_at = max(0, self.size - 22 - _NONE16)
        tail = self.read(tail_at, self.size - tail_at)
        at = len(tail) - 22
        while at >= 0:
            at = tail.rfind(b"PK\x05\x06", 0, at + 4)
            if at < 0:
                break
            if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at -= 1
        if at < 0:
            raise ZipError("no end of central directory")
        disk, cd_disk, _, n, size, start = struct.unpack_from("<HHHHII", tail, at + 4)
        if at + tail_at >= 20:
            mark, _, end64, _ = struct.unpack("<4sIQI", self.read(tail_at + at - 20, 20))
            if mark == b"PK\x06\x07":
                head = self.read(end64, 56)
                if head[:4] != b"PK\x06\x06":
                    raise ZipError("the ZIP64 locator points at no ZIP64 end record")
                return struct.unpack_from("<QQQ", head, 32)
        if disk not in (0, _NONE16) or cd_disk not in (0, _NONE16):
            raise ZipError("packages over several disks aren't read")
        return n, size, start

    def _directory(self) -> Iterator[tuple[str, dict]]:
        n, size, start = self._end()
        entries, at = self.read(start, size), 0
        for _ in range(n):
            if entries[at : at + 4] != b"PK\x01\x02":
                raise ZipError(f"entry at {start + at} isn't a central directory header")
            if len(entries) < at + 46:
                raise ZipError("the central directory ends within an entry")
            flags, method = struct.unpack_from("<HH", entries, at + 8)
            crc, packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIIHHH", entries, at + 16)
            offset = struct.unpack_from("<I", entries, at + 42)[0]
            name = entries[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = entries[at + 46 + name_n : at + 46 + name_n + extra_n]
            wide = iter(self._zip64(extra))
            try:
                full, packed, offset = (next(wide) if x == _NONE32 else x for x in (full, packed, offset))
            except (StopIteration, RuntimeError) as e:
                raise ZipError(f"{name} lacks its ZIP64 sizes") from e
            yield name, {"method": method, "crc": crc, "packed": packed, "size": full, "offset": offset, "encrypted": bool(flags & 1)}
            at += 46 + name_n + extra_n + note_n

    @staticmethod
    def _zip64(extra: bytes) -> list[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1 and at + 4 + n > len(extra):
                raise ZipError("a ZIP64 field ends early")
            if kind == 1:
                return list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            at += 4 + n
        return []

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        m = self.members.get(name)
        if m is None:
            raise ZipError(f"no member {name}")
        if m["method"] != 0 or m["encrypted"]:
            raise ZipError(f"{name} isn't stored")
        head = self.read(m["offset"], 30)
        if head[:4] != b"PK\x03\x04":
            raise ZipError(f"no local header for {name}")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return m["offset"] + 30 + name_n + extra_n, m["size"]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record.  A revisit keeps the HTTP head, which tells the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields: type, id, target, digest, refers_to, payload (None for a revisit), payload_bytes."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4:
        raise ValueError(f"a block of {len(rest) - 4} bytes says that it has {n}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    says = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    own = lambda k: None if (x := fields.get(k)) is None or x == "<urn:x-page:null>" else int(x.removeprefix("<urn:x-page:").removesuffix(">"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the payload differs from its digest")
    return {"type": kind, "id": own("warc-record-id"), "target": fields.get("warc-target-uri"), "digest": digest, "refers_to": own("warc-refers-to"), "payload": payload if kind == "response" else None, "payload_bytes": int(says["content-length"])}


def package(records: list[bytes]) -> bytes:
    """A ZIP package of gzipped records."""
    out, at, lines = io.BytesIO(), 0, []
    for x in records:
        lines.append(f"{at} {len(x)}\n")
        at += len(x)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, records), (INDEX, [x.encode() for x in lines])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=at > 2**31) as member:
                for x in parts:
                    member.write(x)
    return out.getvalue()


def with_revisits(pages: DataFrame, work: Workspace, *, id_col: str = "page_id", payload: str = "html", least: int = 100, broadcast_digests: int = 100_000) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to."""
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "payload_digest": F.sha2(data, 256)})
    some = rows.filter(F.col("payload_bytes") >= least).groupBy(F.unhex("payload_digest").alias("_digest"))
    firsts = some.agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and _first is not null")
    firsts = work.save(firsts.select("_digest", "_first"), "firsts")
    if firsts.limit(broadcast_digests + 1).count() <= broadcast_digests:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, (F.unhex("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least), "left")
    return rows.withColumn("refers_to", F.when(F.col(id_col) != F.col("_first"), F.col("_first"))).drop("_digest", "_first")


def write(rows: DataFrame, folder: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z", package_bytes: int = 32_000_000) -> DataFrame:
    """Writes packages into ``folder``; rows come from ``with_revisits``.  Returns path, records, bytes for each; an action writes."""
    small_batches(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        at = TaskContext.get()
        name = f"{root}/part-{at.partitionId():06d}"
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []
        n = total = 0

        def flush() -> pa.RecordBatch:
            own = f"{root}/.part-{at.partitionId():06d}-{n:04d}.{at.taskAttemptId()}"
            made = package(held)
            with fs.open_output_stream(own) as f:
                f.write(made)
            final = f"{name}-{n:04d}.zip"
            if fs.get_file_info(final).type != pa.fs.FileType.NotFound:
                fs.delete_file(final)  # of an attempt that was lost
            fs.move(own, final)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/part-{at.partitionId():06d}-{n:04d}.zip", "records": len(held), "bytes": len(made)}], schema)

        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            columns = [batch.column(x) for x in (id_col, url, payload, "payload_digest", "refers_to")]
            columns[2] = columns[2].cast(pa.binary())
            for i in range(batch.num_rows):
                page_id, target, data, digest, refers = (c[i].as_py() for c in columns)
                held.append(_gzip(record(page_id, target, data or b"", digest, refers, date)))
                total += len(held[-1])
                if total >= package_bytes:
                    yield flush()
                    held, total, n = [], 0, n + 1
        if held:
            yield flush()

    return rows.select(id_col, F.col(url).cast("string"), F.col(payload).cast("string"), "payload_digest", "refers_to").mapInArrow(task, "path string, records long, bytes long")


def read(spark: SparkSession, packages: DataFrame, *, block_records: int = 256, payloads: bool = True) -> DataFrame:
    """A row per record of the packages (a column path): record_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    small_batches(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    z = ZipPackage(f)
                    (data, n), (index, index_n) = z.stored(DATA), z.stored(INDEX)
                    lines = [tuple(map(int, x.split())) for x in z.read(index, index_n).splitlines()]
                out = []
                for i in range(0, len(lines), block_records):
                    some = lines[i : i + block_records]
                    if some[-1][0] + some[-1][1] > n:
                        raise ZipError(f"{path}: the index points beyond its member")
                    out.append({"path": path, "start": data + some[0][0], "lengths": [k for _, k in some]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    kinds = [("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kinds + [("payload", pa.binary())] * payloads)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                fs, place = pa.fs.FileSystem.from_uri(path)
                out = []
                with fs.open_input_file(place) as f:
                    f.seek(start)
                    for n in lengths:
                        x = parse(zlib.decompress(f.read(n), 31))
                        out.append({"record_id": x["id"], "url": x["target"], "record_type": x["type"], "payload_bytes": x["payload_bytes"], "payload_digest": x["digest"], "refers_to": x["refers_to"], "payload": x["payload"]})
                yield pa.RecordBatch.from_pylist(out, schema)

    # a number of tasks is named, as rows that only point at data look small enough for one
    tasks = max(packages.count(), spark.sparkContext.defaultParallelism)
    dealt = packages.select("path").repartition(tasks, "path").mapInArrow(blocks, "path string, start long, lengths array<long>").repartition(tasks, "path", "start")
    return dealt.mapInArrow(records, "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", payload: str = "html", broadcast_digests: int = 100_000, payloads: bool = False) -> DataFrame:
    """Writes packages for pages into the shared folder and reads them back."""
    work = Workspace(pages.sparkSession, "warc")
    rows = with_revisits(pages.select(id_col, url, payload), work, id_col=id_col, payload=payload, broadcast_digests=broadcast_digests)
    packages = work.save(write(rows, f"{work.root}/packages", id_col=id_col, url=url, payload=payload), "manifest")
    return read(pages.sparkSession, packages, payloads=payloads)
