"""Token-id files with shuffled planes.

Documents are encoded, and a task writes the ids of its documents, in ascending order of their ids, to files of its own.
Ids stand as unsigned 32-bit integers in blocks of a fixed number of ids; a block is transposed into bit planes or byte
planes, and each plane is compressed with zstandard on its own. A file holds, little-endian:

    magic "SLPLANE1" | planes, back to back | index, compressed | footer

The index has the documents (id, ids of the document) and, for each block, the place, lengths and ids of its planes; so
a reader fetches any block by itself. The footer has the index's place, length and CRC-32. A file is written under a name
of the task attempt's own and then renamed to its final name, so an attempt that is lost or repeated leaves no half a file.

Defined results: null text is an empty document, which has its end id only; documents that repeat an id stand in order
of text; null ids come first; an empty table gives no file and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, parts, tidy

MAGIC, FOOTER = b"SLPLANE1", struct.Struct("<QQI8s")
#: Ids of a block; zstandard's level; ids after which a task begins another file; documents of a task, and bytes of their texts; pretokens that a worker remembers.
BLOCK, LEVEL, FILE_IDS, TASK_DOCS, TASK_BYTES, REMEMBERED = 1 << 16, 3, 1 << 25, 20_000, 16 << 20, 300_000
#: How the byte-level tokenizer cuts a text before it merges (fixed by its file), told by the classes of the characters
#: up to U+02AF: letters, numbers, white space. A text with any other character is encoded whole.
LETTERS, NUMBERS, SPACES = r"A-Za-zªµºÀ-ÖØ-öø-ʯ", r"0-9²³¹¼-¾", r"\t-\r \xA0"
CUT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
OTHER = re.compile(r"[^\t-\r\x20-\x7E\xA0-ʯ]")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """32 bit planes or 4 byte planes of the ids, lowest first."""
    data = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [data[:, k].tobytes() for k in range(4)]
    return [row.tobytes() for row in np.packbits(np.unpackbits(data, axis=1, bitorder="little").T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n], axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    """Writes one file; add() takes a document's ids."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = LEVEL) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[tuple[int, list[int], int]] = []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= 16 * self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, end, self.block):
            own = ids[k : min(k + self.block, end)]
            planes = [self.zstd.compress(p) for p in to_planes(own, self.bits)]
            self.blocks.append((self.at, [len(p) for p in planes], len(own)))
            self.out.write(b"".join(planes))
            self.at += sum(map(len, planes))
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(last=True)
        index = self.zstd.compress(json.dumps({"docs": self.docs, "blocks": self.blocks}).encode())
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(index), zlib.crc32(index), MAGIC))


class Reader:
    """Reads one file; source has size(), seek() and read()."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        if size < len(MAGIC) + FOOTER.size:
            raise ValueError("not a token file: too short")
        source.seek(size - FOOTER.size)
        at, length, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file: no footer")
        source.seek(at)
        index = source.read(length)
        if zlib.crc32(index) != crc:
            raise ValueError("token file: its index is damaged")
        index = json.loads(zstandard.decompress(index))
        self.docs, self.blocks = index["docs"], index["blocks"]

    def block(self, k: int) -> np.ndarray:
        at, lengths, n = self.blocks[k]
        self.source.seek(at)
        data = self.source.read(sum(lengths))
        if len(data) != sum(lengths):
            raise ValueError("token file: a block is cut short")
        ends = np.cumsum(lengths)
        planes = [zstandard.decompress(data[e - x : e]) for e, x in zip(ends, lengths, strict=True)]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in self.docs:
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.block(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


@cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; a new piece is encoded when it is looked up. Two
    generations are remembered, so frequent pieces stay."""

    def __init__(self, model, remembered: int) -> None:
        self.model, self.remembered, self.old, self.characters = model, remembered, {}, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = array("I", [t.id for t in self.model.tokenize("".join(map(self.characters.__getitem__, piece.encode("utf-8"))))]).tobytes()
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts with the tokenizer of a file, to ids as little-endian unsigned 32-bit integers.

    If the tokenizer's own first step is the byte-level cut, texts are cut that way and its model encodes each distinct
    piece once: merges never cross the cuts, so the ids are the same. Texts with a special token's string, or with
    characters that CUT doesn't know, are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.tokenizer = _encoder(path)
        first = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        byte_level = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        little_words = array("I").itemsize == 4 and sys.byteorder == "little"
        self.cuts = byte_level and self.tokenizer.normalizer is None and little_words
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.tokenizer.model, remembered)

    def encode(self, text: str) -> bytes:
        if not self.cuts or OTHER.search(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.pieces.trim()
        return b"".join(map(self.pieces.__getitem__, CUT.findall(text)))


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder; it lives as long as the worker, so pieces are remembered from task to task."""
    return Encoder(path)


def write(tokenizer: str, end_id: int, folder: str, bits: bool, file_ids: int):
    """(part, doc_id, text), sorted, to files; a row per file: (part, file, name, n_docs, n_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer).encode
        rows: list[tuple[int, int, str, int, int]] = []
        out = None

        def close() -> None:
            name = f"part-{part:06d}-{sum(r[0] == part for r in rows):04d}.slp"
            out.close()
            out.out.close()
            fs.move(draft, f"{root}/{name}")
            rows.append((part, sum(r[0] == part for r in rows), name, len(out.docs), out.total))

        part = draft = None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for p, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out and (p != part or out.total >= file_ids):
                    close()
                    out = None
                if not out:
                    part, draft = p, f"{root}/.draft-{uuid.uuid4().hex}"
                    out = Writer(fs.open_output_stream(draft, compression=None), bits)
                out.add(doc_id, np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
        if out:
            close()
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "file", "name", "n_docs", "n_ids"])

    return run


def read_back(folder: str):
    """(name, start) to a row per document of the files: (doc_id, start, n_tokens, ids_crc32, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(str(PurePosixPath(root) / name)) as source:
                    rows = []
                    for doc_id, ids in Reader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                        start += len(ids)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array([name] * len(rows), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "name"])

    return run


def write_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: bool = False,
    task_docs: int = TASK_DOCS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the documents' files to folder, which all executors share; a row per file: part, file, name, n_docs, n_ids, start (ids of the files before it).

    Tasks get ranges of the ids that hold about task_docs documents or TASK_BYTES each, whichever is less; the ranges'
    order is the order of the ids.
    """
    store = Store(docs.sparkSession, "token_files")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, size = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    tasks = max(parts(rows, task_docs, 1), parts(size or 0, TASK_BYTES, 1))
    ranged = own.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    placed = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    written = placed.mapInArrow(tidy(write(tokenizer, end_id, folder, bits, file_ids)), "part int, file int, name string, n_docs long, n_ids long")
    files = store.save(written, "files")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32, name; a task reads a file."""
    spark: SparkSession = files.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, name string"
    if not (n := files.count()):
        return spark.createDataFrame([], schema)
    return files.select("name", "start").repartition(n, "name").mapInArrow(tidy(read_back(folder)), schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: bool = False, **columns: str) -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back."""
    folder = Store(docs.sparkSession, "tokens").at("files")
    return read_files(write_files(docs, folder, tokenizer, end_id, bits=bits, **columns), folder)
