"""Toxicity by class-conditional Kneser-Ney models.

The units are the characters of a word, from its start to its end. The words of all labelled texts are counted by
class, a word once a document, and n-gram counts, continuation counts and numbers of types follow from them; nothing
of this is sampled or cut. Each class's model discounts its own counts of n-grams of ORDER characters and backs off to
one model that both classes share: Kneser-Ney over the counts of both, whose lower orders use continuation counts. The
shared model counts as SHARED more observations of each context, so a rare expression leans to a class only as far as
several documents of that class back it. The tables that score have the 64-bit hash of each n-gram as its key, so they
grow with the distinct n-grams of the labelled texts and none shares its counts with another.

A word's evidence is the difference of its log-likelihoods. A document's evidence is length-normalised: the mean over
all words, the highest mean over WINDOW consecutive words, and the second highest word; the logarithm of the number of
words stands beside them, as maxima grow with it. A logistic regression makes a probability of it. It is fitted on a
sample of labelled documents (SAMPLE at most, about; all of them on small tables) by cross-fitting: the sample is dealt
into FOLDS parts, and the documents of a part are measured by the counts of all labelled texts but that part's.

ORDER, SHARED and the features were chosen by cross-validation within the labelled documents that may be learned from.

Defined results: null, empty and wordless texts get the share of toxic documents; a document labelled both ways is
toxic; null labels are none; with a class missing among the labels all scores are 0; repeated rows and null ids are
scored like others; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, small_side, tidy

ORDER, DISCOUNT, SHARED = 7, 0.75, 40.0
WINDOW, SAMPLE, FOLDS = 8, 6_000, 4
#: Words a task holds before it gives its sums; bytes of text measured at once; words whose evidence a worker remembers.
HELD_WORDS, CHUNK, REMEMBERED = 100_000, 2_000_000, 150_000
START, END = "\x01", "\x02"
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, fold, toxic) to (word, fold, toxic, ordinary): documents with the word, summed over what a task can hold."""
    held: dict[tuple[str, int], list[int]] = {}

    def give() -> pa.RecordBatch:
        keys, sums = list(held), list(held.values())
        held.clear()
        cols = [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([s[1] for s in sums], pa.int64()),
            pa.array([s[0] for s in sums], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["word", "fold", "toxic", "ordinary"])

    for batch in batches:
        for text, fold, toxic in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for w in set(words(text.as_py())):
                held.setdefault((w, fold), [0, 0])[toxic] += 1
            if len(held) > HELD_WORDS:
                yield give()
    yield give()


def spelled(every: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters one after another, each word after ORDER - 1 starts and before an end; and which word each
    place that counts is in (-1: a start)."""
    pad = START * (ORDER - 1)
    text = "".join(f"{pad}{w}{END}" for w in every)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) for w in every), np.int64, len(every)) + ORDER
    index = np.repeat(np.arange(len(every)), lengths)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return points, np.where(at >= ORDER - 1, index, -1)


def gram_hash(points: list[np.ndarray]) -> np.ndarray:
    """Hash of strings; points: their first characters, their second ones, and so on."""
    if not points:
        return np.zeros(1, np.uint64)
    h = np.full(len(points[0]), len(points), np.uint64)
    for x in points:
        h ^= x.astype(np.uint64, copy=False)
        h *= MIX
        h ^= h >> np.uint64(31)
    return h


class Strings:
    """Where strings stand in a table, by their hashes. The keys are in order and their leading bits tell a bucket of
    about one key, so a string is found in a step or two."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(1, len(keys).bit_length())
        marks = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.append(np.searchsorted(keys, marks), len(keys)).astype(np.uint32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, or the number of keys."""
        out = np.full(len(h), len(self.keys), np.uint32)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Grams:
    """The distinct n-grams of ORDER characters, and in each the shorter ones: the last k characters of an n-gram are
    one of order k, and the k before the last one its context. So all counts follow from those of the longest."""

    def __init__(self, points: np.ndarray) -> None:
        """points: a row of ORDER code points per n-gram."""
        columns = [np.ascontiguousarray(x) for x in points.T]
        self.last, self.context, self.size, self.first = [], [], [], []
        for k in range(ORDER + 1):
            own = np.broadcast_to(gram_hash(columns[ORDER - k :] if k else []), len(points))
            keys, first, place = np.unique(own, return_index=True, return_inverse=True)
            self.last.append(place.astype(np.uint32))
            self.first.append(first.astype(np.uint32))
            del own, first, place
            if k < ORDER:
                before = np.broadcast_to(gram_hash(columns[ORDER - 1 - k : ORDER - 1] if k else []), len(points))
                contexts, place = np.unique(before, return_inverse=True)
                self.context.append(place.astype(np.uint32))
                self.size.append(len(contexts))
        self.keys, self.contexts = Strings(keys), Strings(contexts)  # of ORDER and ORDER - 1 characters

    def model(self, n0: np.ndarray, n1: np.ndarray) -> Model:
        """n0, n1: the counts of each n-gram by class; those with neither are left out of all counts."""
        alive = n0 + n1 > 0

        def distinct(k: int) -> np.ndarray:
            """An n-gram of the longest for each one of order k that is alive."""
            return self.first[k][np.bincount(self.last[k][alive], minlength=len(self.first[k])) > 0]

        def count(k: int, at: np.ndarray | slice, weights: np.ndarray | None = None) -> np.ndarray:
            """For each n-gram, how many of those `at` have its context of k characters."""
            own = self.context[k]
            return np.bincount(own[at], weights, self.size[k]).astype(np.float32)[own]

        p = np.full(len(n0), 1 / max(len(distinct(1)), 1), np.float32)
        for k in range(1, ORDER):
            longer, own = distinct(k + 1), distinct(k)
            n = np.bincount(self.last[k][longer], minlength=len(self.first[k])).astype(np.float32)[self.last[k]]
            p = backed(n, count(k - 1, longer), count(k - 1, own), p, 0.0)
        every, k = slice(None), ORDER - 1
        total = [count(k, every, n) for n in (n0, n1)]
        types = [count(k, n > 0) for n in (n0, n1)]
        shared = backed(n0 + n1, total[0] + total[1], count(k, alive), p, 0.0)
        logs = [np.log(backed(n, total[c], types[c], shared, SHARED)) for c, n in enumerate((n0, n1))]
        rest = [np.log(backed(0.0, total[c], types[c], 1.0, SHARED)) for c in (0, 1)]
        grams, contexts = np.zeros(len(self.keys.keys) + 1, np.float32), np.zeros(len(self.contexts.keys) + 1, np.float32)
        contexts[self.context[k]] = rest[0] - rest[1]
        grams[self.last[ORDER]] = np.where(alive, logs[0] - logs[1], contexts[self.context[k]])
        return Model(self.keys, grams, self.contexts, contexts)


@dataclass
class Model:
    """What each n-gram of ORDER characters adds to a word's evidence; and, as both classes back an n-gram that neither
    has off to the same probability, what any other one after a known context adds. Others add nothing."""

    grams: Strings
    of_gram: np.ndarray
    contexts: Strings
    of_context: np.ndarray

    def __getstate__(self) -> bytes:
        """What is broadcast is compressed."""
        own = {k: v for k, v in self.__dict__.items() if k != "remembered"}
        return zstandard.compress(pickle.dumps(own, protocol=5))

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ = pickle.loads(zstandard.decompress(state))

    def evidence(self, every: list[str]) -> np.ndarray:
        """Each word's toxic log-likelihood less its ordinary one."""
        parts = [self._evidence(every[k : k + 20_000]) for k in range(0, len(every), 20_000)]
        return np.concatenate([np.zeros(0), *parts])

    def _evidence(self, every: list[str]) -> np.ndarray:
        points, index = spelled(every)
        here = np.flatnonzero(index >= 0)
        at = self.grams.places(gram_hash([points[here - k] for k in range(ORDER - 1, -1, -1)]))
        out = self.of_gram[at]
        new = np.flatnonzero(at == len(self.grams.keys))
        out[new] = self.of_context[self.contexts.places(gram_hash([points[here[new] - k] for k in range(ORDER - 1, 0, -1)]))]
        return np.bincount(index[here], out, len(every))


def backed(count: np.ndarray | float, total: np.ndarray, types: np.ndarray, below: np.ndarray | float, more: float) -> np.ndarray:
    """Discounted probabilities, backed off to those below, which count as `more` observations besides."""
    own = np.maximum(np.subtract(count, DISCOUNT), 0) + (DISCOUNT * types + more) * below
    return np.where(total > 0, own / np.where(total > 0, total + more, 1), below)


class Evidence:
    """A worker's evidence of words, from task to task: each is computed once while it is remembered, in two generations."""

    def __init__(self, model: Model, remembered: int = REMEMBERED) -> None:
        self.model, self.remembered, self.new, self.old = model, remembered, {}, {}

    @classmethod
    def by(cls, model: Model) -> Evidence:
        """The one that goes with a model in this process."""
        if "remembered" not in model.__dict__:
            model.remembered = cls(model)
        return model.remembered

    def of(self, every: list[str]) -> np.ndarray:
        if len(self.new) > self.remembered:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = [w for w in every if w not in new and w not in old]
        new.update(zip(unknown, self.model.evidence(unknown).tolist(), strict=True))
        for w in every:
            if w not in new:
                new[w] = old[w]
        return np.fromiter((new[w] for w in every), np.float64, len(every))


def features(evidence: Evidence, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row per text (mean, best window, second best word, log of the words), and its number of words."""
    each = [words(t) for t in texts]
    n = np.fromiter(map(len, each), np.int64, len(each))
    codes, every = pd.factorize(np.array([w for ws in each for w in ws], dtype=object))
    llr = evidence.of(list(every))[codes] if len(codes) else np.zeros(0)
    out = np.zeros((len(each), 3))
    for i, (start, count) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
        if count:
            own = llr[start : start + count]
            sums = np.concatenate([[0.0], np.cumsum(own)])
            width = min(WINDOW, count)
            best = (sums[width:] - sums[:-width]).max() / WINDOW
            out[i] = own.mean(), best, np.partition(own, -2)[-2] if count > 1 else min(own[0], 0.0)
    return np.column_stack([out, np.log1p(n)]), n


def features_of(evidence: Evidence, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """features() of many texts, taking CHUNK bytes at once, or one text that is longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff(sizes // CHUNK, prepend=-1)).tolist()
    ends = [*starts[1:], len(texts)]
    parts = [features(evidence, texts[a:b].to_pylist()) for a, b in zip(starts, ends, strict=True)]
    parts = parts or [features(evidence, [])]
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def count_grams(labelled: DataFrame) -> DataFrame:
    """labelled (text, fold, toxic as 0 or 1; fold -1: not in the sample) to (gram, fold, toxic, ordinary): the n-grams
    of ORDER characters. A shuffle of each task's distinct words, and one of the n-grams of the distinct words of all."""
    sums = [F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")]
    found = labelled.select("text", "fold", "toxic").mapInArrow(tidy(word_counts), "word string, fold int, toxic long, ordinary long")
    padded = F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END))
    each = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    grams = found.groupBy("word", "fold").agg(*sums).select(F.explode(each).alias("gram"), "fold", "toxic", "ordinary")
    return grams.groupBy("gram", "fold").agg(*sums)


def code_points(grams: pa.StringArray) -> np.ndarray:
    """A row of ORDER code points per n-gram."""
    if not len(grams):
        return np.zeros((0, ORDER), np.uint32)
    _, offsets, data = grams.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[grams.offset, grams.offset + len(grams)]]
    text = data[first:last].to_pybytes().decode("utf-8", "surrogatepass")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)


@dataclass
class Counted:
    """Counted n-grams on the driver: which one a row is of, its fold (-1: not in the sample) and its counts."""

    grams: Grams
    at: np.ndarray
    fold: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]

    @classmethod
    def gather(cls, counted: DataFrame) -> Counted:
        """counted: (gram, fold, toxic, ordinary)."""
        kinds = {"gram": "string", "fold": "tinyint", "toxic": "float", "ordinary": "float"}
        rows = counted.select(*[F.col(c).cast(kind) for c, kind in kinds.items()]).toArrow()
        fold, *counts = (rows[c].to_numpy() for c in ("fold", "toxic", "ordinary"))
        grams = rows["gram"].combine_chunks().dictionary_encode()
        del rows
        at, points = grams.indices.to_numpy().astype(np.uint32), code_points(grams.dictionary)
        del grams
        pa.default_memory_pool().release_unused()
        return cls(Grams(points), at, fold, tuple(counts))

    def model(self, without: int | None = None) -> Model:
        """The model of all documents, or of those outside a fold."""
        mine = slice(None) if without is None else self.fold != without
        own = [np.bincount(self.at[mine], x[mine], len(self.grams.last[0])).astype(np.float32) for x in self.counts]
        return self.grams.model(*own)


def scored(docs: DataFrame, model: Model, weights: np.ndarray, prior: float) -> DataFrame:
    """docs (doc_id, text, ...) with the text replaced by score."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, prior))  # grows with the distinct n-grams
    at, names = docs.columns.index("text"), docs.columns
    schema = ", ".join("score double" if f.name == "text" else f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, prior = shared.value
        evidence = Evidence.by(model)
        for batch in batches:
            x, n = features_of(evidence, batch.column(at))
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ weights, -30, 30)))
            score = pa.array(np.where(n > 0, p, prior))
            cols = [score if c == at else batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, ["score" if c == "text" else c for c in names])

    return docs.mapInArrow(tidy(run), schema)


@dataclass
class Folds:
    """The models of the sample's parts, which share their strings."""

    models: list[Model]

    def __getstate__(self) -> bytes:
        return zstandard.compress(pickle.dumps([m.__dict__ for m in self.models], protocol=5))

    def __setstate__(self, state: bytes) -> None:
        self.models = [Model(**own) for own in pickle.loads(zstandard.decompress(state))]


def measured(sample: DataFrame, folds: Folds) -> DataFrame:
    """sample (text, fold, toxic) to (a, b, c, d, toxic, n): the features by the model of the document's part, and the words."""
    shared = sample.sparkSession.sparkContext.broadcast(folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in pc.unique(batch.column(1)).to_pylist():
                own = batch.filter(pc.equal(batch.column(1), f))
                x, n = features_of(Evidence.by(shared.value.models[f]), own.column(0))
                cols = [*[pa.array(x[:, k]) for k in range(4)], own.column(2), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "c", "d", "toxic", "n"])

    return sample.select("text", "fold", "toxic").mapInArrow(tidy(run), "a double, b double, c double, d double, toxic int, n long")


def learn(labelled: DataFrame, store: Store) -> tuple[Model, np.ndarray]:
    """labelled (text, fold, toxic), with both classes: the model of all documents, and the weights of the calibration."""
    counted = Counted.gather(store.save(count_grams(labelled), "grams"))
    store.drop("grams")
    folds = Folds([counted.model(f) for f in range(FOLDS)])
    rows = measured(labelled.where("fold >= 0"), folds).where("n > 0").toArrow().to_pandas()
    return counted.model(), fit(rows[["a", "b", "c", "d"]].to_numpy(), rows["toxic"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, learn_from: F.Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score. labels: (doc_id, toxic); learn_from: which ids' labels may be learned from."""
    store = Store(docs.sparkSession, "toxicity")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    known = store.save(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "known")
    of = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(of) < 2:
        return own.select("doc_id", F.lit(0.0).alias("score"))
    share = sample / sum(of.values())
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("calibrate")), 11) / F.lit(float(1 << 53)) < F.lit(share)
    fold = F.when(drawn, F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))).otherwise(-1).cast("int")
    labelled = own.join(small_side(known, store, "known"), "doc_id").select("text", fold.alias("fold"), "toxic")
    model, weights = learn(labelled, store)
    store.drop("known")
    return scored(own, model, weights, of[1] / sum(of.values()))
