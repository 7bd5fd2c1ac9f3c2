"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: on each of two blocks of 23 bits the perfect Golay code, of covering radius 3,
and on the other 18 bits the code with one word. Each fingerprint is sent to the anchors near it, and fingerprints are
compared at each anchor. Sending to all anchors within covering radius plus threshold on one side would do; it is
enough to go half the threshold beyond the radius on both sides: two fingerprints at distance t or less have a word
between them that is t/2 (rounded up) or less from either, and the anchor nearest to that word is within reach of both.
So every link is found, and a fingerprint has about 60 anchors of 16.7 million for a threshold of 4. From DENSE distinct
fingerprints on, a third block of 15 bits has the Hamming code, of radius 1: some 150 anchors of 34 billion, so that
what is compared at an anchor stays little. The links are the same.

Only distinct fingerprints are sent. Fingerprints at one anchor are joined to a forest, not to all their pairs. An
anchor with more than CELL of them is split into cells, one for each two parts of it. Which are split is told by a table
of 2^24 bytes, by a hash of the anchor, whatever the number of fingerprints.

Defined results: null, empty and wordless texts have fingerprint zero and link like others; fewer words than a shingle
are one shingle; rows that repeat an id are each returned; null ids never name a component that has another id; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.store import Store, parts, tidy

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of an anchor that are compared in one cell; entries that a task compares; shingles whose bits are summed at once.
CELL, TASK_ENTRIES, CHUNK = 20_000, 750_000, 1 << 17
#: Distinct fingerprints for each task that writes their components.
TASK_NAMES = 500_000
#: Distinct fingerprints from which on a third block is coded; bits of the hash that tells whether an anchor is split, and of a part's number.
DENSE, SLOT_BITS, PART_BITS = 50_000_000, 24, 14
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code: its length, check bits, generator polynomial and covering radius."""

    bits: int
    check: int
    generator: int
    radius: int


#: Fixed values. The generators are x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 and x^4 + x + 1.
GOLAY, HAMMING = Code(23, 11, 0xC75, 3), Code(15, 4, 0x13, 1)
BLOCKS = {False: (GOLAY, GOLAY), True: (GOLAY, GOLAY, HAMMING)}


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of the text's shingles; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[x + 1 for x in ends[:-size]]]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (doc_id, text_hash, fp)."""
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        held: list[np.ndarray] = []
        at: list[int] = []

        def flush() -> None:
            if at:
                n = np.array([len(x) for x in held])
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                sums = np.add.reduceat(bit_counts(np.concatenate(held)), starts, axis=0, dtype=np.int64)
                out[at] = ((2 * sums > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
                held.clear()
                at.clear()

        waiting = 0
        for i, text in enumerate(batch.column(2)):
            hashes = np.array(shingle_hashes(text.as_py(), size), np.uint64)
            if len(hashes) > CHUNK:
                sums = sum(bit_counts(hashes[k : k + CHUNK]).sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), CHUNK))
                out[i] = ((2 * sums > len(hashes)) * weights).sum(dtype=np.uint64)
            elif len(hashes):
                held.append(hashes)
                at.append(i)
                waiting += len(hashes)
            if waiting > CHUNK:
                flush()
                waiting = 0
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["doc_id", "text_hash", "fp"])


@cache
def tables(code: Code, beyond: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The syndrome of each word, and for 0..beyond the patterns, by syndrome and padded by -1, that lead to the code
    words at a distance of radius + that (at 0: radius or less)."""
    syndromes = np.zeros(1, np.int16)
    for k in range(code.bits):
        v = 1 << k
        for j in range(k, code.check - 1, -1):
            if v >> j & 1:
                v ^= code.generator << (j - code.check)
        syndromes = np.concatenate([syndromes, syndromes ^ np.int16(v)])
    out = []
    for excess in range(beyond + 1):
        by: list[list[int]] = [[] for _ in range(1 << code.check)]
        for weight in range(0 if not excess else code.radius + excess, code.radius + excess + 1):
            for bits in combinations(range(code.bits), weight):
                e = sum(1 << b for b in bits)
                by[syndromes[e]].append(e)
        table = np.full((len(by), max(map(len, by))), -1, np.int32)
        for s, found in enumerate(by):
            table[s, : len(found)] = found
        out.append(table)
    return syndromes, out


def anchors(fps: np.ndarray, distance: int, dense: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The anchors in reach of each fingerprint: (anchor, index into fps). A code word is told by what isn't its check bits."""
    beyond, start, near = -(-distance // 2), 0, []
    for code in BLOCKS[dense]:
        syndromes, patterns = tables(code, beyond)
        v = ((fps >> np.uint64(start)) & np.uint64((1 << code.bits) - 1)).astype(np.int32)
        near.append([(code.bits - code.check, p >= 0, (v[:, None] ^ p) >> code.check) for p in (t[syndromes[v]] for t in patterns)])
        start += code.bits
    found, index = [], []
    for excess in product(range(beyond + 1), repeat=len(near)):
        if sum(excess) > beyond:
            continue
        anchor, keep = np.zeros((len(fps), 1), np.int64), np.ones((len(fps), 1), bool)
        for bits, fits, word in (near[k][e] for k, e in enumerate(excess)):
            anchor = (anchor[:, :, None] << bits | word[:, None, :]).reshape(len(fps), -1)
            keep = (keep[:, :, None] & fits[:, None, :]).reshape(len(fps), -1)
        found.append(anchor[keep])
        index.append(np.broadcast_to(np.arange(len(fps))[:, None], keep.shape)[keep])
    return np.concatenate(found), np.concatenate(index)


def _slot(anchor: np.ndarray) -> np.ndarray:
    """Where an anchor stands in the table of parts."""
    return ((anchor.view(np.uint64) * ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _part(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part, of n, of an anchor that is split."""
    return ((fps * ODD) >> np.uint64(33)).astype(np.int64) % n


def count_anchors(distance: int, dense: bool, floor: float):
    """Slots of the anchors that a task sends at least floor fingerprints to: (slot, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fps), 5_000):
                found = _slot(anchors(fps[k : k + 5_000], distance, dense)[0])
                own, counts = np.unique(found, return_counts=True)
                n[own] += counts.astype(np.int32)
        many = np.flatnonzero(n >= max(floor, 1))
        yield pa.RecordBatch.from_arrays([pa.array(many.astype(np.int64)), pa.array(n[many].astype(np.int64))], ["slot", "n"])

    return run


def parts_of(counted: DataFrame, cell: int) -> np.ndarray | None:
    """For each slot the logarithm of the parts that its anchors are split into; None if none is.

    counted: (slot, n), a row per task and slot at most. What is gathered is an integer a slot, 2^24 of them at most.
    """
    log = F.least(F.ceil(F.log2(F.col("n") / F.lit(cell / 2))), F.lit(PART_BITS))
    many = counted.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > cell / 2)
    rows = many.select((F.col("slot") * 16 + log).cast("int").alias("x")).toArrow()["x"].to_numpy()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[rows >> 4] = rows & 15
    return out if out.any() else None


def send(distance: int, dense: bool, tasks: int, parts: Broadcast | None):
    """Packs (cell, fp) entries for each task that compares: (task, cells, fps). parts: as parts_of() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None if parts is None else parts.value
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fps), 5_000):
                own = fps[k : k + 5_000]
                anchor, index = anchors(own, distance, dense)
                cell, fp = anchor << 2 * PART_BITS, own[index]
                if split is not None:
                    n = np.left_shift(1, split[_slot(anchor)].astype(np.int64))
                    hot = n > 1
                    n, base, many = n[hot], cell[hot], fp[hot]
                    part = _part(many, n)
                    row = np.repeat(np.arange(len(n)), n)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    low, high = np.minimum(part[row], other), np.maximum(part[row], other)
                    cell = np.concatenate([cell[~hot], base[row] | low << PART_BITS | high])
                    fp = np.concatenate([fp[~hot], many[row]])
                task = ((cell.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % tasks
                order = np.argsort(task, kind="stable")
                task, cell, fp = task[order], cell[order], fp[order]
                edges = np.flatnonzero(np.diff(task, prepend=-1))
                spans = list(zip(edges, np.append(edges[1:], len(task)), strict=True))
                packs = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (cell, fp)]
                yield pa.RecordBatch.from_arrays([pa.array(task[edges]), *packs], ["task", "cells", "fps"])

    return run


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what pairs within distance join; each fingerprint is found once and then compared with those not yet found."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= distance
            got = near.any(axis=0)
            a.append(left[got])
            b.append(some[near[:, got].argmax(axis=0)])
            front, left = np.concatenate([front, left[got]]), left[~got]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b, with each node linked to its component's smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def compare(distance: int, small: int = 24):
    """Links between the fingerprints of each cell: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = [], []
        for batch in batches:
            cells += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            fps += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        if not cells:
            return
        cell, fp = np.concatenate(cells), np.concatenate(fps)
        del cells, fps
        order = np.argsort(cell, kind="stable")
        cell, fp = cell[order], fp[order]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        sizes = np.diff(starts, append=len(cell))
        a, b = [fp[:0]], [fp[:0]]
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            x, y = forest(fp[s : s + n], distance)
            a.append(x)
            b.append(y)
        fits = np.repeat((sizes > 1) & (sizes <= small), sizes)
        cell, fp = cell[fits], fp[fits]
        at = np.arange(len(cell))
        for lag in range(1, small):
            at = at[at < len(cell) - lag]
            at = at[cell[at] == cell[at + lag]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
            a.append(fp[near])
            b.append(fp[near + lag])
        x, y = star(np.concatenate(a), np.concatenate(b))
        for k in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].view(np.int64)), pa.array(y[k : k + 100_000].view(np.int64))], ["a", "b"])

    return run


def links_of(fps: DataFrame, rows: int, distance: int, cell: int, task_entries: int, dense: bool) -> DataFrame:
    """(a, b): links that join the fingerprints (fp), distinct ones, as all pairs within distance would."""
    sc = fps.sparkSession.sparkContext
    tasks = parts(rows, 50_000, 6)
    fps = fps.repartition(tasks)
    split = None
    if rows > cell:
        split = parts_of(fps.mapInArrow(tidy(count_anchors(distance, dense, cell / 2 / tasks)), "slot long, n long"), cell)
        split = None if split is None else sc.broadcast(split)
    comparing = parts(rows * (155 if dense else 62), task_entries, 12)
    packs = fps.mapInArrow(tidy(send(distance, dense, comparing, split)), "task long, cells binary, fps binary")
    return packs.repartition(comparing, "task").mapInArrow(tidy(compare(distance)), "a long, b long")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    distance: int = DISTANCE,
    cell: int = CELL,
    task_entries: int = TASK_ENTRIES,
    dense_from: int = DENSE,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, n_links (distinct fingerprints of its component besides its own), text_hash."""
    store = Store(docs.sparkSession, "near_dedup")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    marked = store.save(own.mapInArrow(tidy(lambda b: fingerprints(b, size)), f"doc_id {kind}, text_hash long, fp long"), "marked")
    distinct = store.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    rows = distinct.count()
    links = links_of(distinct.select("fp"), rows, distance, cell, task_entries, rows >= dense_from)
    roots = components(links, store)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    named = named.join(ids, "root").select("fp", "component_id", "n_links")
    named = store.save(named.coalesce(parts(rows, TASK_NAMES, 6)), "named")
    store.drop("distinct")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", fingerprint, "component_id", "n_links", "text_hash")
