"""Document vectors fitted on the corpus: TF-IDF over hashed words, reduced by a randomised factorisation.

Words fall into FEATURES signed buckets, so the model has one size at every size of the corpus. A random matrix is multiplied by the
documents' Gram matrix once or more (A'A, one document at a time: no term or document table is ever joined), its columns
are made orthonormal on the driver, and the small matrix that is left gives the axes by falling variance. Sums over documents are
taken on whole numbers, each document's part rounded by itself, so the fitted model and the vectors do not depend on
how the documents are dealt to tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

FEATURES = 1 << 15
WIDTH, SPARE = 64, 16
#: Multiplications by A'A; one more makes small gaps between axes matter less.
ROUNDS = 2
#: Units of one in sums of whole numbers.
UNIT = 1 << 20
#: Words whose bucket a task remembers.
KNOWN_WORDS = 200_000
#: Documents that a task sums at least, where that leaves a task for every core: each task sends a matrix of the model's size.
TASK_DOCS = 20_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _buckets(features: int):
    """(id, text) to (id, place, count): the buckets of a text's words in order, and signed counts, none of them zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            places, counts = [], []
            for text in batch.column(1):
                own = Counter(text.as_buffer().to_pybytes().translate(_WORDS).split()) if text.is_valid else {}
                if len(known) > KNOWN_WORDS:
                    known.clear()
                found: dict[int, int] = {}
                for word, n in own.items():
                    if (h := known.get(word)) is None:
                        h = known[word] = xxhash.xxh3_64_intdigest(word)
                    at = h % features
                    found[at] = found.get(at, 0) + (n if h >> 63 else -n)
                kept = sorted(k for k, n in found.items() if n)
                places.append(kept)
                counts.append([found[k] for k in kept])
            yield pa.record_batch([batch.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "place", "count"])

    return run


def _sparse(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each document's buckets and TF-IDF weights of unit length."""
    for place, count in zip(batch.column(0), batch.column(1), strict=True):
        at, n = place.values.to_numpy(), count.values.to_numpy()
        w = np.sign(n) * (1 + np.log(np.abs(n))) * idf[at]
        length = np.sqrt((w * w).sum())
        yield at, w / length if length else w


def _rows(sums: np.ndarray) -> pa.RecordBatch:
    """The rows of a matrix of whole numbers that are not zero."""
    at = np.flatnonzero(sums.any(axis=1))
    flat = pa.array(sums[at].ravel())
    return pa.record_batch([pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * sums.shape[1]), flat)], names=["place", "sums"])


def _gram_times(idf: np.ndarray, right: np.ndarray):
    """(place, count) to the task's part of A'A times a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(right.shape, np.int64)
        for batch in batches:
            for at, w in _sparse(batch, idf):
                if len(at):
                    sums[at] += np.rint(np.outer(w * UNIT, w @ right[at])).astype(np.int64)
        yield _rows(sums)

    return run


def _covered(idf: np.ndarray, basis: np.ndarray):
    """(place, count) to the task's part of the covariance of A times a basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((basis.shape[1],) * 2, np.int64)
        for batch in batches:
            for at, w in _sparse(batch, idf):
                y = w @ basis[at]
                sums += np.rint(np.outer(y * UNIT, y)).astype(np.int64)
        yield _rows(sums)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one place summed; a task holds its share of the matrix at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = part.values.to_numpy()
            sums[place] = sums[place] + values if place in sums else values
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["place", "sums"])


def _summed(words: DataFrame, n: int, task, shape: tuple[int, int], scratch: Scratch) -> np.ndarray:
    """A matrix of the model's size, summed over all n documents."""
    kind = "place int, sums array<long>"
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, n // TASK_DOCS)
    parts = words.select("place", "count").coalesce(tasks).mapInArrow(task, kind).repartition("place").mapInArrow(_added, kind)
    # written, so that its shuffle files go before the next one
    written = scratch.cut(parts, "sums")
    out = np.zeros(shape)
    for r in written.toLocalIterator():  # `shape` bounds what comes
        out[r.place] = np.array(r.sums) / UNIT
    scratch.drop(written)
    return out


class Encoder:
    """A fitted model: weights of the buckets and the axes."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, variances: np.ndarray) -> None:
        self.idf, self.axes, self.variances = idf, axes, variances

    def encode(self, words: DataFrame) -> DataFrame:
        """(id, vec) of (id, place, count): unit vectors; zeros for a text without words."""
        idf, axes = self.idf, self.axes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for at, w in _sparse(batch.select(["place", "count"]), idf):
                    v = w @ axes[at] if len(at) else np.zeros(axes.shape[1])
                    length = np.sqrt((v * v).sum())
                    out.append((v / length if length else v).astype(np.float32))
                yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "vec"])

        return words.mapInArrow(run, f"id {words.schema['id'].dataType.simpleString()}, vec array<float>")


def bucketed(docs: DataFrame, key: str, text: str, scratch: Scratch, features: int = FEATURES) -> DataFrame:
    """(id, place, count) of every document, written once."""
    kind = docs.schema[key].dataType.simpleString()
    return scratch.cut(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(_buckets(features), f"id {kind}, place array<int>, count array<long>"), "words")


def fit(words: DataFrame, width: int = WIDTH, spare: int = SPARE, rounds: int = ROUNDS, features: int = FEATURES) -> Encoder:
    """The model of all documents. Fewer independent documents than axes leave axes of no variance."""
    scratch = Scratch(words.sparkSession, "fit")
    n = words.count()
    df = np.zeros(features)
    for r in words.select(F.explode("place").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r.place] = r.n
    idf = np.log((1 + n) / (1 + df)) + 1
    right = np.random.default_rng(1).standard_normal((features, width + spare))
    for _ in range(rounds):
        right, _r = np.linalg.qr(_summed(words, n, _gram_times(idf, right), right.shape, scratch))
    inner = _summed(words, n, _covered(idf, right), (right.shape[1],) * 2, scratch)
    values, vectors = np.linalg.eigh(inner)
    return Encoder(idf, right @ vectors[:, ::-1][:, :width], values[::-1][:width])


def encode_corpus(docs: DataFrame, key: str, text: str, width: int = WIDTH, features: int = FEATURES) -> DataFrame:
    """(key, vec) of every document by a model fitted on all of them. Null and empty texts give zeros, repeated rows equal vectors."""
    scratch = Scratch(docs.sparkSession, "encoder")
    words = bucketed(docs, key, text, scratch, features)
    return fit(words, width, features=features).encode(words).withColumnRenamed("id", key)


def encode_with(docs: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], batch: int = 64, least: int = 4) -> DataFrame:
    """(key, vec) by a caller's model, in batches that are halved, down to `least`, where one does not fit into memory.

    `load` runs once in a task and returns a function from texts to vectors. A smaller batch that fails raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = load(), batch
        for record in batches:
            texts, out, at = [x or "" for x in record.column(1).to_pylist()], [], 0
            while at < len(texts):
                try:
                    out += [np.asarray(v, np.float32) for v in encode(texts[at : at + size])]
                    at += size
                except MemoryError:
                    if size // 2 < least:
                        raise
                    size //= 2
            yield pa.record_batch([record.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "vec"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, vec array<float>").withColumnRenamed("id", key)
