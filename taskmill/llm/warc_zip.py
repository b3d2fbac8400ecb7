"""WARC records in ZIP packages: written, indexed, and range-read without extraction."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import dealt, new_path, open_fs, written

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
#: Bytes of records after which a package is closed, and bytes that one task reads of one.
PACKAGE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of interest and the payload of one record; ValueError if it is damaged."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].rpartition(":")[2]
    if head["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    name = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    return {"page_id": name(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": name(head.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest, "payload": payload}


# ---------------------------------------------------------------- ZIP


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError("a package is cut off")
    return got


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (method, place of the local header, stored size) from the central directory.

    Follows the ZIP64 end record and the ZIP64 extra fields where the plain ones are full.
    """
    tail = read_at(f, max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("not a ZIP file")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        where = max(0, size - 65_557) + end - 20
        mark, _, far, _ = struct.unpack("<4sIQI", read_at(f, where, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        mark, *_, count, length, at = struct.unpack("<4sQHHIIQQQQ", read_at(f, far, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
    directory, i, members = read_at(f, at, length), 0, {}
    for _ in range(count):
        mark, _, _, flags, method, _, _, _, packed, plain, names, extras, comment, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, i)
        if mark != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        i += 46
        name = directory[i : i + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, j = directory[i + names : i + names + extras], 0
        while j + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, j)
            if tag == 1:  # ZIP64: only the fields that are full above, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, j + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            j += 4 + n
        i += names + extras + comment
        members[name] = (method, header, packed)
    return members


def stored_at(f, member: tuple[int, int, int]) -> tuple[int, int]:
    """Place and size of a member's bytes in the package; it must be stored as it is."""
    method, header, size = member
    if method:
        raise ValueError("the member is compressed, not stored")
    mark, names, extras = struct.unpack("<4s22xHH", read_at(f, header, 30))
    if mark != b"PK\x03\x04":
        raise ValueError("a local header is damaged")
    return header + 30 + names + extras, size


class Package:
    """Writes one ZIP package: a stored WARC of gzip records, and an index of where they are."""

    def __init__(self, out):
        import zipfile

        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(self._info("archive/data.warc.gz"), "w", force_zip64=True)
        self.index, self.at = [], 0

    @staticmethod
    def _info(name):
        import zipfile

        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = pack.compress(raw) + pack.flush()
        self.member.write(packed)
        self.index.append((self.at, len(packed)))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(self._info("indexes/data.idx"), "w", force_zip64=True) as f:
            for lo in range(0, len(self.index), 10_000):
                f.write(b"".join(struct.pack("<QI", *x) for x in self.index[lo : lo + 10_000]))
        self.zip.close()


def _writer(folder: str, most: int):
    def write(batches):
        import uuid

        package = out = path = None
        n = 0

        def shut():
            package.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    # A new name for each attempt: only those of tasks that ended well are listed.
                    path, n = f"{folder}/{uuid.uuid4().hex}.zip", 0
                    fs, inner = open_fs(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner)
                    package = Package(out)
                package.add(record(page_id, url, payload, digest, refers_to))
                n += 1
                if package.at >= most:
                    yield shut()
                    package = None
        if package is not None:
            yield shut()

    return write


def _ranges(most: int):
    def find(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as f:
                    members = zip_members(f, f.size())
                    for name in sorted(x for x in members if x.startswith("archive/")):
                        base, _ = stored_at(f, members[name])
                        at, size = stored_at(f, members["indexes/" + name.removeprefix("archive/").partition(".")[0] + ".idx"])
                        index = list(struct.iter_unpack("<QI", read_at(f, at, size)))
                        lo = 0
                        while lo < len(index):
                            hi = lo + 1
                            while hi < len(index) and index[hi][0] + index[hi][1] - index[lo][0] <= most:
                                hi += 1
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([base + index[lo][0]]), pa.array([[n for _, n in index[lo:hi]]], pa.list_(pa.int64()))], ["path", "at", "sizes"])
                            lo = hi

    return find


_FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _reader(payloads: bool):
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["payload"] * payloads

    def read(batches):
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
        for batch in batches:
            for path, at, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as f:
                    raw = read_at(f, at, sum(sizes))
                rows, lo = [], 0
                for n in sizes:
                    rows.append(parse_record(zlib.decompress(raw[lo : lo + n], 31)))
                    lo += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)

    return read


def planned_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each page.

    Of pages with equal payloads of at least `least` bytes, those with the smallest page_id
    are responses (a repeated row too), the others revisits of it. Null ids come last: they
    are revisits if any page with an id has the payload, else responses.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256))
    size = F.octet_length("payload")
    groups = page.filter(size >= least).groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head")
    both = page.join(written(groups, "warc-groups"), "digest", "left")
    return both.select("page_id", "url", "payload", "digest", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per page into ZIP packages under folder; (path, n) of each package."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return written(planned_records(pages, least).mapInArrow(_writer(folder, package_bytes), "path string, n bigint"), "warc-packages")


def read_packages(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the packages: page_id, url, record_type, refers_to, payload_bytes and
    payload_digest, with payloads their payload too (empty for revisits).

    Directories and indexes are read first; ranges of records are then dealt out and read
    by place, without extraction. Digests of responses are checked.
    """
    found = written(paths.select("path").distinct().mapInArrow(_ranges(RANGE_BYTES), "path string, at bigint, sizes array<bigint>"), "warc-ranges")
    return dealt(found).mapInArrow(_reader(payloads), _FIELDS + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """write_packages(), then read_packages(). Null html is an empty payload; empty input gives
    no package and no rows; other columns don't matter."""
    return read_packages(write_packages(pages, None, least))
