"""WARC archives compressed with zstandard.

A file opens with a skippable frame that holds the dictionary, followed by one frame per record, so a reader can start
at any record whose place it knows. The dictionary is trained on slices of about SAMPLE pages, drawn by a hash below a
threshold that follows from the number of pages, so what reaches the driver has a bound at any size; if there is too
little to train on, the frame is empty and records are compressed without one. The reader streams a file frame by frame, and
validates the frames, the WARC headers, the lengths and the payload digests of responses.

Defined results: null html is an empty payload; empty payloads are equal to each other; all rows that carry the id of
a payload's response are responses; null ids sort below all others; an empty table gives no file and no rows. Other
columns than those named are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, small_side, tidy

#: Magic of the dictionary's frame (zstandard's skippable frames have 0x184D2A50 to 5F) and of zstandard's own frames.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Pages and characters of each (a slice from anywhere in the page) to train on; bytes of the dictionary; bytes after which another file begins; bytes that a read asks for.
SAMPLE, SLICE, DICTIONARY, FILE_BYTES, READ = 2000, 8192, 64 << 10, 256 << 20, 1 << 20
LEVEL = 3
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def safe(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool) -> bytes:
    uri = safe(url or "") or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    headers = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"), ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if is_revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{sha1}')}>"), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    return record(headers, block)


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    samples = [s for s in samples if s]
    if len(samples) < 64 or sum(map(len, samples)) < 8 * size:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


class Writer:
    """Writes a .warc.zst file."""

    def __init__(self, out, dictionary: bytes) -> None:
        self.out = out
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        self.bytes = 0
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.zstd.compress(data))


def frames(source) -> Iterator[bytes]:
    """The decoded records of a .warc.zst file, one at a time; source has read()."""
    head = source.read(8)
    if len(head) < 8:
        raise ValueError("warc.zst: no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("warc.zst: the leading frame is not that of a dictionary")
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ValueError("warc.zst: the dictionary is cut short")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = b""
    while data or (data := source.read(READ)):
        while len(data) < 8 and (more := source.read(READ)):
            data += more
        if len(data) >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data)[0] <= 0x184D2A5F:
            size = 8 + struct.unpack_from("<I", data, 4)[0]
            while len(data) < size and (more := source.read(READ)):
                data += more
            if len(data) < size:
                raise ValueError("warc.zst: a skippable frame is cut short")
            data = data[size:]
            continue
        if struct.pack("<I", FRAME_MAGIC) != data[:4]:
            raise ValueError("warc.zst: bytes between frames")
        one, out = zstd.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            if not (data := source.read(READ)):
                raise ValueError("warc.zst: a frame is cut short")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("WARC: not a record's head")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"WARC: not a header: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"WARC: no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("WARC: the record's length is not its Content-Length")
    return headers, rest[:-4]


def page(data: bytes) -> tuple[int | None, int, str, str, int | None, str]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of a record that Writer wrote, validated."""
    headers, block = parse(data)
    http, found, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, sha1, n = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    if not found or lengths != [n]:
        raise ValueError("WARC: the HTTP head doesn't have the payload's length")
    if kind == "response" and (len(payload) != n or digest(payload) != sha1):
        raise ValueError("WARC: the payload doesn't match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("WARC: a revisit has a payload or refers to nothing")
    number = lambda x: int(x) if x else None
    return number(headers["x-page-id"]), n, sha1, kind, number(headers.get("x-refers-to-page", "")), headers["warc-target-uri"]


def write(folder: str, dictionary: bytes, file_bytes: int):
    """(page_id, url, html, response_id) to files; a row per file: (name, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        names, counts, out, stream, n = [], [], None, None, 0

        def close() -> None:
            stream.close()
            name = f"{uuid.uuid4().hex}.warc.zst"
            fs.move(draft, f"{root}/{name}")
            names.append(name)
            counts.append(n)

        draft = ""
        for batch in batches:
            ids, urls, htmls, first = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                if out and out.bytes >= file_bytes:
                    close()
                    out = None
                if not out:
                    draft = f"{root}/.draft-{uuid.uuid4().hex}"
                    stream, n = fs.open_output_stream(draft, compression=None), 0
                    out = Writer(stream, dictionary)
                payload = (htmls[k].as_py() or "").encode("utf-8", "surrogatepass")
                page_id, response = ids[k].as_py(), first[k].as_py()
                out.add(page_record(page_id, urls[k].as_py(), payload, digest(payload), response, page_id != response))
                n += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "n"])

    return run


COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}


def read(folder: str, rows: int = 5000):
    """(name) to a row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)

        def batch(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) if got else [[]] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, COLUMNS.values(), strict=True)], list(COLUMNS))

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    got = []
                    for data in frames(source):
                        got.append(page(data))
                        if len(got) >= rows:
                            yield batch(got)
                            got = []
                    yield batch(got)

    return run


def drawn(own: DataFrame, rows: int, sample: int = SAMPLE) -> DataFrame:
    """(s): slices of about `sample` of the pages (page_id, html), to train the dictionary only.

    A page is drawn if its hash is low enough; rows that repeat a page share its hash and are drawn as one, so the
    number of slices is binomial with a mean of `sample` at most.
    """
    share = min(1.0, sample / max(rows, 1))
    hashed = own.select("html", F.shiftrightunsigned(F.xxhash64("page_id", "html", F.lit("train")), 11).alias("k")).where(F.col("k") < F.lit(int(share * (1 << 53))))
    start = F.pmod(F.col("k"), F.greatest(F.length("html") - SLICE + 1, F.lit(1))).cast("int") + 1
    return hashed.select("k", F.substring("html", start, F.lit(SLICE)).alias("s")).groupBy("k").agg(F.min("s").alias("s")).select("s")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages' archives to folder, which all executors share; a row per file: name, n.

    The response of a payload comes from sums combined before the shuffle. Only payloads that several pages share need
    one; their list is broadcast if it is small, so that pages stay where they are. Beyond that the join shuffles the
    pages by digest, and adaptive execution can split a digest that many share.
    """
    store = Store(pages.sparkSession, "warc")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = own.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    shared = keyed.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first_id")
    shared = store.save(shared, "shared")
    dictionary = train([r.s.encode("utf-8", "surrogatepass") for r in drawn(own, pages.count()).collect()])
    dealt = keyed.join(small_side(shared, store, "shared"), "sha1", "left").select("page_id", "url", "html", F.coalesce("first_id", "page_id").alias("response_id"))
    files = store.save(dealt.mapInArrow(tidy(write(folder, dictionary, file_bytes)), "name string, n long"), "files")
    store.drop("shared")
    return files


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of the files: page_id, payload_bytes, payload_digest, record_type, refers_to, url; a task reads some files."""
    n = files.count()
    return files.select("name").repartition(max(n, 1), "name").mapInArrow(tidy(read(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_and_read(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    folder = Store(pages.sparkSession, "archives").at("files")
    return read_archives(write_archives(pages, folder, **columns), folder)
