"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, a gzip member for each record, and
``indexes/index.cdxj``, a line for each record with its place. The reader finds the end record from the
file's tail, follows the ZIP64 locator where there is one, parses the central directory, checks that the
members are stored, and from the index reads just the bytes of the records asked for.

Payloads that occur several times are written once, as the response of the largest page id; the others
are revisits that refer to it and carry no payload. Null payloads are empty. Pages without an id are responses unless an
equal payload has one. Repeated rows are written as often as they occur; pages that share an id keep their own payloads. Null urls become the record's id; an empty table writes no package. Files are reached
through Arrow's file systems, so the shared folder may be in any store they know.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import salted_left_join, shared_dir, stored

DATE = "2024-01-01T00:00:00Z"
PACKAGE_BYTES = 24 << 20
READ_BYTES = 8 << 20  # packed bytes that a task reads
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# ---------------------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target_uri(page_id, url: str | None) -> str:
    """The url with everything percent-encoded that may not stand in one; the record's id where there is none."""
    from urllib.parse import quote

    return quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{'' if page_id is None else page_id}"


def record_bytes(page_id, url: str | None, payload: bytes | None, digest: str, refers_to) -> bytes:
    """One WARC record: a response with the payload, or a revisit without one."""
    own = f"urn:page:{'' if page_id is None else page_id}"
    uri = target_uri(page_id, url)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    lines = [f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        kind, block = "response", f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        kind, block = "revisit", f"{http}\r\n".encode()
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), type, page_id, refers_to and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    _, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: int(n) if uri and (n := uri.strip("<>").rpartition(":")[2]) else None
    return {"headers": headers, "type": headers["warc-type"], "page_id": number(headers["warc-record-id"]), "refers_to": number(headers.get("warc-refers-to")), "payload": payload}


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


# ---------------------------------------------------------------------------- packages


class Package:
    """Gathers records; ``close`` gives the bytes of the ZIP file."""

    def __init__(self):
        self.records, self.lines, self.size = [], [], 0

    def add(self, url: str, digest: str, record: bytes) -> None:
        import json

        data = gzip_member(record)
        place = {"url": url, "digest": f"sha1:{digest}", "filename": "data.warc.gz", "offset": str(self.size), "length": str(len(data))}
        self.lines.append(f"{url} {DATE.translate({ord(c): None for c in '-:TZ'})} {json.dumps(place)}")
        self.records.append(data)
        self.size += len(data)

    def close(self) -> bytes:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open("archive/data.warc.gz", "w", force_zip64=True) as member:
                for data in self.records:
                    member.write(data)
            z.writestr("indexes/index.cdxj", "\n".join(sorted(self.lines)) + "\n")
        return out.getvalue()


class Member:
    def __init__(self, name: str, method: int, size: int, header: int):
        self.name, self.method, self.size, self.header = name, method, size, header


def central_directory(read, length: int) -> list[Member]:
    """Members of a ZIP file; ``read(offset, n)`` gives its bytes. ZIP64 end records and extra fields are followed."""
    tail_at = max(0, length - 65_557)  # an end record with the longest comment
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)  # its mark can also stand in a comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if end >= 20 and (locator := read(end - 20, 20))[:4] == _LOCATOR64:
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("damaged ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", end64, 32)
    directory, members, at = read(start, size), [], 0
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra, x = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # 64-bit values, of those fields only that are full above
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            x += 4 + n
        members.append(Member(name, method, packed, header))
        at += 46 + name_n + extra_n + comment_n
    return members


def member_start(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; its records cannot be read by range")
    local = read(member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("damaged local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n


def record_places(read, length: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record that the indexes list."""
    import json

    members = {m.name: m for m in central_directory(read, length)}
    begins = {name.rpartition("/")[2]: member_start(read, m) for name, m in members.items() if name.startswith("archive/")}
    for name, m in members.items():
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in read(member_start(read, m), m.size).decode().split("\n"):
                if not line:
                    continue
                place = json.loads(line[line.index("{") :])
                yield begins[place["filename"]] + int(place["offset"]), int(place["length"])


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def write_packages(pages: DataFrame, path: str, package_bytes: int = PACKAGE_BYTES, min_bytes: int = 0) -> DataFrame:
    """Writes the packages below ``path`` and returns their paths (stored: every package is written once).

    pages: page_id, url, html. A package holds at most about ``package_bytes`` of packed records. Names
    carry a random part, so what a lost attempt left behind is never listed.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = salted_left_join(rows, groups.select("sha1", "keeper"), "sha1", F.monotonically_increasing_id(), 8)
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def write(batches):
        import uuid

        import pyarrow as pa

        system, inner = _open(path)
        system.create_dir(inner, recursive=True)

        def close(package):
            name = f"{inner}/pages-{uuid.uuid4().hex}.zip"
            with system.open_output_stream(name) as f:
                f.write(package.close())
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name.rpartition('/')[2]}"]), pa.array([len(package.records)], pa.int64())], names=["package", "records"])

        package = Package()
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                digest = payload_digest(payload)
                package.add(target_uri(page_id, url), digest, record_bytes(page_id, url, payload, digest, refers_to))
                if package.size >= package_bytes:
                    yield close(package)
                    package = Package()
        if package.records:
            yield close(package)

    return stored(rows.mapInArrow(write, "package string, records long"), "packages")


def read_packages(packages: DataFrame, gap: int = 1 << 16) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the packages (column ``package``)."""

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for package in batch.column(0).to_pylist():
                system, inner = _open(package)
                with system.open_input_file(inner) as f:
                    read = lambda offset, n, f=f: f.read_at(n, offset)
                    found = sorted(record_places(read, f.size()))
                for i in range(0, len(found), 512):
                    part = found[i : i + 512]
                    yield pa.RecordBatch.from_arrays([pa.array([package] * len(part)), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["package", "offset", "length"])

    def records(batches):
        import pyarrow as pa

        now, f = None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            at = 0
            while at < len(wanted):  # neighbouring records in one read
                package, begin, length = wanted[at]
                to, end = at + 1, begin + length
                while to < len(wanted) and wanted[to][0] == package and 0 <= wanted[to][1] - end <= gap and wanted[to][1] + wanted[to][2] - begin <= 4 << 20:
                    end = wanted[to][1] + wanted[to][2]
                    to += 1
                if package != now:
                    system, inner = _open(package)
                    now, f = package, system.open_input_file(inner)
                block = f.read_at(end - begin, begin)
                for _, offset, n in wanted[at:to]:
                    r = parse_record(zlib.decompress(block[offset - begin : offset - begin + n], 31))
                    digest = r["headers"]["warc-payload-digest"].removeprefix("sha1:")
                    if r["type"] == "response" and payload_digest(r["payload"]) != digest:
                        raise ValueError(f"payload of page {r['page_id']} in {package} is damaged")
                    for column, value in zip(out, (r["page_id"], len(r["payload"]), digest, r["type"], r["refers_to"], r["payload"])):
                        column.append(value)
                at = to
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    # The places are small rows for much reading: Spark gets the numbers of tasks, by packages and by bytes.
    spark = packages.sparkSession
    tasks = lambda n: max(1, min(n, 100_000))
    dealt = packages.select("package").repartition(tasks(packages.count()), F.col("package"))
    where = stored(dealt.mapInArrow(places, "package string, offset long, length long"), "record-places")
    total = where.agg(F.sum("length")).first()[0] or 0
    reading = tasks(max(-(-total // READ_BYTES), spark.sparkContext.defaultParallelism))
    spread = where.repartition(reading, F.col("package"), F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("package", "offset")
    return spread.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back; revisits take their payload's size from the response."""
    rows = stored(read_packages(write_packages(pages, path, min_bytes=min_bytes)).drop("payload"), "records")
    named = rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("target"), "payload_digest").distinct()
    sizes = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("target"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    sizes = sizes.join(named, ["target", "payload_digest"], "left_semi")  # only responses that others refer to
    full = salted_left_join(rows.withColumn("target", F.col("refers_to")), sizes, ["target", "payload_digest"], F.monotonically_increasing_id(), 8)
    size = F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("payload_bytes"))
    return full.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return archive_round_trip(pages, shared_dir(spark, "warc"))
