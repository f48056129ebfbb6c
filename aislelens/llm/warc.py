"""WARC archives of Zstandard frames: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_frozen, frozen, join_salted

#: Payloads below this many bytes are never told as revisits.
LEAST_PAYLOAD = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: A task's first records, up to so many bytes, train its archives' dictionary of so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
# Magic numbers of frames and dictionaries, and the names of the record profile.
SKIPPABLE, DICTIONARY_FRAME, FRAME, DICTIONARY = range(0x184D2A50, 0x184D2A60), 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION, IDENTICAL = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")


class BadArchive(ValueError):
    """An archive, frame or record that is not whole or not valid."""


def _storage(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = uri.removeprefix("file:")
        uri = "/" + uri.lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------ records
def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out, and line ends in values are encoded."""
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = [f"{k}: {clean(v)}".encode() for k, v in headers if v is not None]
    return b"\r\n".join([VERSION, *lines, f"Content-Length: {len(block)}".encode(), b"", b""]) + block + b"\r\n\r\n"


def _split_headers(raw: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    """(first line, headers in lower case, what follows the blank line)."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive(f"{what}: headers do not end")
    first, *lines = head.split(b"\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            raise BadArchive(f"{what}: {line[:60]!r} is no header")
        key = name.decode().lower()
        if key in out and key != "warc-concurrent-to":
            raise BadArchive(f"{what}: {key} is given twice")
        out[key] = value.strip().decode("utf-8", "replace")
    return first, out, rest


def _length(headers: dict[str, str], what: str) -> int:
    text = headers.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise BadArchive(f"{what}: Content-Length is {text[:40]!r}")
    return int(text)


def parse_record(raw: bytes, what: str = "record") -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record: version, required headers, exact length and digests are checked."""
    first, headers, rest = _split_headers(raw, what)
    if first not in (b"WARC/1.0", VERSION):
        raise BadArchive(f"{what}: begins with {first[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not headers.get(name):
            raise BadArchive(f"{what}: {name} is missing")
    size = _length(headers, what)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"{what}: {size} bytes are told, {len(rest) - 4} are there")
    block = rest[:size]
    if told := headers.get("warc-block-digest"):
        kind, _, digest = told.partition(":")
        if kind.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
            raise BadArchive(f"{what}: the block is not what its digest tells")
    return headers, block


def http_payload(headers: dict[str, str], block: bytes, what: str = "record") -> tuple[bytes | None, int, str]:
    """(payload, its length, its SHA-256) of a response; a revisit has no payload and tells the other two."""
    _, http, payload = _split_headers(block, f"{what}, HTTP")
    kind, _, told = headers.get("warc-payload-digest", "").partition(":")
    if headers["warc-type"] == "revisit":
        if kind.lower() != "sha256" or not re.fullmatch("[0-9a-f]{64}", told) or not headers.get("warc-refers-to"):
            raise BadArchive(f"{what}: a revisit without digest or without what it refers to")
        if payload:
            raise BadArchive(f"{what}: a revisit with a payload")
        return None, _length(http, what), told
    digest = hashlib.sha256(payload).hexdigest()
    if "content-length" in http and _length(http, what) != len(payload) or kind.lower() == "sha256" and told.lower() != digest:
        raise BadArchive(f"{what}: the payload is not what its headers tell")
    return payload, len(payload), digest


# ------------------------------------------------------------ archives
def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A Zstandard dictionary, or none where the samples are too few for one."""
    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Frames of one task's records, in archives of about `limit` bytes; finished ones are in `done` as (name, records, bytes)."""

    def __init__(self, folder: str, name: str, limit: int = ARCHIVE_BYTES):
        self.folder, self.name, self.limit = folder, name, limit
        self.done: list[tuple[str, int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes, self.trained, self.out = 0, False, None

    def add(self, raw: bytes) -> None:
        if self.trained:
            self._frame(raw)
            return
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= SAMPLE_BYTES:
            self._train()

    def _train(self) -> None:
        self.trained, self.dictionary = True, train_dictionary(self.held)
        data = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        for raw in self.held:
            self._frame(raw)
        self.held = []

    def _frame(self, raw: bytes) -> None:
        if self.out is not None and self.size >= self.limit:
            self._close()
        if self.out is None:
            storage, root = _storage(self.folder)
            storage.create_dir(root, recursive=True)
            self.archive = f"{self.name}-{len(self.done):05d}.warc.zst"
            self.out, self.size, self.count = storage.open_output_stream(f"{root}/{self.archive}", compression=None), 0, 0
            if self.dictionary:
                packed = zstandard.ZstdCompressor(level=19).compress(self.dictionary)
                self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self._put(self.compressor.compress(raw))
        self.count += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _close(self) -> None:
        self.out.close()
        self.done.append((self.archive, self.count, self.size))
        self.out = None

    def close(self) -> None:
        if not self.trained and self.held:
            self._train()
        if self.out is not None:
            self._close()


def read_frames(stream, what: str, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame of an archive, read piece by piece.

    A skippable frame in front is the dictionary, compressed or as it is; other skippable
    frames are passed over. Anything else, a frame that does not end, or one that does not
    decode, is an error.
    """
    held, at, dictionary = b"", 0, None

    def fill(n: int) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while have < n and (more := stream.read(piece)):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        return have >= n

    while fill(1):
        if not fill(4):
            raise BadArchive(f"{what}: {len(held)} bytes are left at {at}")
        magic = int.from_bytes(held[:4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(held[4:8], "little") if fill(8) else 0
            if not fill(8 + size):
                raise BadArchive(f"{what}: the skippable frame at {at} does not end")
            content, held = held[8 : 8 + size], held[8 + size :]
            if at == 0 and magic == DICTIONARY_FRAME:
                if content[:4] == FRAME.to_bytes(4, "little"):
                    try:
                        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
                    except zstandard.ZstdError as e:
                        raise BadArchive(f"{what}: the dictionary does not decode: {e}") from e
                if content[:4] != DICTIONARY.to_bytes(4, "little"):
                    raise BadArchive(f"{what}: the leading frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(content)
            at += 8 + size
            continue
        if magic != FRAME:
            raise BadArchive(f"{what}: no frame begins at {at}")
        one, parts, used = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), [], 0
        try:
            while not one.eof:
                if not held and not fill(1):
                    raise BadArchive(f"{what}: the frame at {at} does not end")
                parts.append(one.decompress(held))
                used += len(held) - len(one.unused_data)
                held = one.unused_data
        except zstandard.ZstdError as e:
            raise BadArchive(f"{what}: the frame at {at} does not decode: {e}") from e
        yield at, b"".join(parts)
        at += used


# ------------------------------------------------------------ Spark
def record_id(page_id: int | None, row_no: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{row_no}')}>"


def _written(folder: str, date: str, limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, uuid.uuid4().hex, limit)
        for batch in batches:
            for page, row, url, html, digest, first_page, first_row in zip(*(batch.column(c) for c in ("page_id", "row_no", "url", "html", "digest", "first_page", "first_row")), strict=True):
                page, row, payload, digest, first_row = page.as_py(), row.as_py(), html.as_py(), digest.as_py(), first_row.as_py()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
                block = http + payload if first_row is None else http
                headers = [
                    ("WARC-Type", "response" if first_row is None else "revisit"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", date), ("WARC-Target-URI", url.as_py() or "about:blank"),
                    ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                    ("X-Page-Id", None if page is None else str(page)),
                ]
                if first_row is not None:
                    headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(first_page.as_py(), first_row)), ("WARC-Refers-To-Date", date)]
                out.add(record(headers, block))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in out.done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return rows


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_PAYLOAD, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to `folder` as *.warc.zst; returns its manifest (archive, records, bytes).

    A row is a record, its payload the html in UTF-8 (null: empty). Of rows with equal payloads
    of `least` bytes or more, the one of smallest page_id (null last; then of stored order) is a
    response, the others are revisits that refer to it; all others are responses. A null url is
    about:blank, a null page_id has no header; repeated rows are a record each; very long pages
    are one frame; an empty table gives no archives; other columns may have any names.

    `folder` is one that the driver and all executors reach, a path or a URI that pyarrow knows.
    Tasks write archives of their own names, and the manifest, a committed table, names those of
    tasks that ended: what a lost executor leaves is not part of it. Digests alone are grouped;
    pages move once, to be dealt evenly over archives.
    """
    bounded_batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    # Stored once, as rows are read twice and have to keep their numbers.
    rows = frozen(rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html")))
    short = rows.where(F.col("bytes") >= least).select("page_id", "row_no", "digest")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("row_no"))
    firsts = short.groupBy("digest").agg(F.min(order).alias("x"), F.count("*").alias("uses")).where("uses > 1").select("digest", F.col("x.page_id").alias("first_page"), F.col("x.row_no").alias("first_row"), "uses")
    firsts = frozen(firsts)
    revisits = join_salted(short.select("row_no", "digest"), firsts, ["digest"], "uses", ["row_no"]).where("row_no <> first_row").drop("digest")
    dealt = rows.join(revisits, "row_no", "left").select("page_id", "row_no", "url", "html", "digest", "first_page", "first_row")
    manifest = frozen(dealt.mapInArrow(_written(folder, date, limit), "archive string, records long, bytes long"))
    drop_frozen(rows)
    drop_frozen(firsts)
    return manifest


RECORD = "archive string, at long, record_type string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to_record string, payload binary"


def _read(folder: str, payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, root = _storage(folder)
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out, size, seen = [], 0, 0
                with storage.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    for at, raw in read_frames(stream, archive):
                        what = f"{archive} at {at}"
                        headers, block = parse_record(raw, what)
                        kind, seen = headers["warc-type"], seen + 1
                        payload, n, digest = http_payload(headers, block, what) if kind in ("response", "revisit") else (block, len(block), None)
                        page = headers.get("x-page-id")
                        out.append((archive, at, kind, headers["warc-record-id"], int(page) if page else None, headers.get("warc-target-uri"), headers["warc-date"], n, digest, headers.get("warc-refers-to"), payload if payloads else None))
                        size += len(raw) if payloads else 0
                        if size > 4 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, size = [], 0
                if records is not None and seen != records:
                    raise BadArchive(f"{archive}: {records} records were written, {seen} are there")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records (RECORD) of the archives that manifest (archive, records) names in `folder`.

    Each archive is read once, frame by frame, whatever its size; headers, lengths and digests
    of every record are checked, and the number of records where it is known (null: it isn't).
    A damaged archive raises BadArchive. Without `payloads` they are checked but not handed on.
    """
    return manifest.select("archive", "records").repartition("archive").mapInArrow(_read(folder, payloads), RECORD)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of all *.warc.zst files in `folder`, whoever wrote them; their numbers of records are not known."""
    storage, root = _storage(folder)
    names = [f.base_name for f in storage.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".warc.zst")]
    return spark.createDataFrame([(n, None) for n in sorted(names)], "archive string, records long")


def resolved_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) of read_archives().

    A revisit that refers to no response, or whose length or digest are not the response's, is
    an error. A response that very many revisits refer to is joined in parts.
    """
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    told = frozen(records.where("record_type in ('response', 'revisit')").select(*kept, "record_id", "refers_to_record"))
    back = told.where("record_type = 'revisit'")
    uses = back.groupBy(F.col("refers_to_record").alias("record_id")).agg(F.count("*").alias("uses"))
    first = uses.join(told.where("record_type = 'response'").select("record_id", F.lit(True).alias("found"), *(F.col(c).alias(f"r_{c}") for c in kept[:3])), "record_id", "left")
    both = join_salted(back, first.withColumnRenamed("record_id", "refers_to_record"), ["refers_to_record"], "uses", ["record_id"])
    right = F.coalesce(F.col("found") & (F.col("r_payload_bytes") == F.col("payload_bytes")) & (F.col("r_payload_digest") == F.col("payload_digest")), F.lit(False))
    refers = F.when(right, F.col("r_page_id")).otherwise(F.raise_error(F.concat(F.lit("no response is what this revisit tells: "), "record_id")).cast("long"))
    return told.where("record_type = 'response'").select(*kept, F.lit(None).cast("long").alias("refers_to")).union(both.select(*kept, refers.alias("refers_to")))
