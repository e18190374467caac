"""Embedding whitening on a compensated covariance.

Vectors become integers x = floor(64 c) + 1000000, so the sums over all rows are exact. A second pass centres each row
on the mean and adds its outer product to the task's sums. Centring, product and addition are error-free
transformations (two_sum, two_product): each value is a pair of doubles whose unevaluated sum it is, so that a
sum over any number of rows is right to about 100 bits. Tasks send their high and low parts, which are merged the same
way in two steps. The symmetric matrix, of the size of a vector squared, is solved on the driver by LAPACK's
tridiagonal divide and conquer (`eigh`): reduction to a tridiagonal matrix, which is halved until small and put
together again through the secular equation.

The fit list is every row that remains. Whitened vectors are written once; their own covariance, centred and summed the
same way, gives `identity_error`.

Defined results: rows whose vector is null or empty, or holds a null, NaN or infinite entry, are left out. Where lengths differ,
the most frequent one is taken (of equally frequent ones the longest) and other rows are left out. A null id
is kept as it is, repeated rows are rows of their own. Components whose variance is zero, to rounding, have no whitened
value (null) and take no part in `identity_error`; an empty or single-row fit list has only such. `deviation`
is null where it does not fit into 63 bits, which needs millions of times more rows or wider vectors than usual
embeddings have. An entry of x beyond 2^62 is set to that. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries of outer products that a task handles at a time.
ENTRIES = 1 << 20
#: Matrix entries in a row of the partial sums.
BLOCK = 4096
#: Parts in which the sums of all tasks are merged before the last merge.
FAN = 64
_LIMIT = 1 << 62
_SPLIT = 134217729.0  # 2^27 + 1


def _two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _two_product(a, b):
    p = a * b
    t = _SPLIT * a
    ah = t - (t - a)
    t = _SPLIT * b
    bh = t - (t - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _add(ah, al, bh, bl):
    """The sum of two pairs."""
    s, e = _two_sum(ah, bh)
    t, f = _two_sum(al, bl)
    s, e = _two_sum(s, e + t)
    return _two_sum(s, e + f)


def _total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows, added in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        h, e = _add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = np.concatenate([h, high[2 * half :]]), np.concatenate([e, low[2 * half :]])
    return high[0], low[0]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s, e = _two_sum(x.astype(np.float64), -mean[0])
    return _two_sum(s, e - mean[1])


def _outer_products(mean: tuple[np.ndarray, np.ndarray]):
    """Vectors to a task's sums of centred outer products, the upper triangle by rows in blocks: (task, block, high, low)."""
    width = len(mean[0])
    rows, columns = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(len(rows)), np.zeros(len(rows))
        for batch in batches:
            ch, cl = _centred(_matrix(batch.column(0), width), mean)
            for at in range(0, len(rows), ENTRIES):
                i, j = rows[at : at + ENTRIES], columns[at : at + ENTRIES]
                step = max(1, ENTRIES // len(i))
                for k in range(0, len(ch), step):
                    ah, al, bh, bl = (m[k : k + step][:, x] for m, x in ((ch, i), (cl, i), (ch, j), (cl, j)))
                    p, e = _two_product(ah, bh)
                    p, e = _two_sum(p, e + (ah * bl + al * bh))
                    high[at : at + ENTRIES], low[at : at + ENTRIES] = _add(high[at : at + ENTRIES], low[at : at + ENTRIES], *_total(p, e))
        yield from _parts({b: (high[b * BLOCK : (b + 1) * BLOCK], low[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-len(rows) // BLOCK))})

    return run


def _parts(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for block, (high, low) in sums.items():
        values = pa.list_(pa.float64())
        yield pa.record_batch([pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([high], values), pa.array([low], values)], names=["task", "block", "high", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, high, low in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            part = high.values.to_numpy(), low.values.to_numpy()
            sums[block] = _add(*sums[block], *part) if block in sums else part
    yield from _parts(sums)


def covariance(vectors: DataFrame, column: str, mean: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The covariance matrix, divisor n, of an array column about a mean given as high and low parts."""
    kind = "task int, block int, high array<double>, low array<double>"
    parts = vectors.select(column).mapInArrow(_outer_products(mean), kind)
    for keys in ([F.col("block"), F.pmod("task", F.lit(FAN))], [F.col("block")]):
        parts = parts.repartition(*keys).sortWithinPartitions("block", "task").mapInArrow(_merge, kind)
    # one row for each block of the matrix
    found = sorted(parts.select("block", "high", "low").collect())
    width = len(mean[0])
    upper = np.concatenate([np.array(r.high) + np.array(r.low) for r in found]) / n
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = upper
    return out + np.triu(out, 1).T


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            # halves, so that no sum of a batch overflows
            total = [t + (int(h) << 31) + int(r) for t, h, r in zip(total, (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0), strict=True)]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["place", "part"])

    return run


def _whiten(sums: list[int], n: int, mean: tuple[np.ndarray, np.ndarray], basis: np.ndarray):
    """(id, x) to (id, deviation, w)."""
    width, top = len(sums), max(map(abs, sums), default=0)
    narrow = np.array(sums, np.int64) if top < _LIMIT else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            ch, _ = _centred(x, mean)
            most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
            far = n * x - narrow if narrow is not None and most * n < _LIMIT else n * x.astype(object) - np.array(sums, object)
            if far.dtype != object and far.size and int(abs(far).max()) ** 2 * width >= 1 << 63:
                far = far.astype(object)
            deviation = [d if d < 1 << 63 else None for d in map(int, (far * far).sum(1))]
            w = ch @ basis
            flat = pa.array(w.ravel(), from_pandas=True)  # NaN: no such component
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * basis.shape[1]), flat)
            yield pa.record_batch([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "w"])

    return run


def _split(values: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high, strict=True)])


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; of the first `most`."""
    values, vectors = np.linalg.eigh(cov)
    return values[::-1][:most], vectors[:, ::-1][:, :most]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each remaining vector and component."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    v = F.col(vec_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    limit = F.lit(float(_LIMIT))
    x = F.transform(v, lambda c: F.floor(F.least(limit, F.greatest(-limit, c.cast("double") * SCALE))).cast("long") + SHIFT)
    rows = scratch.cut(vectors.where(sound).select(F.col(id_col).alias("id"), x.alias("x")), "integers")
    id_kind = rows.schema["id"].dataType.simpleString()
    widest = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widest:
        empty = rows.select(F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return empty.select("*", *(F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")))
    width, n = widest[0].width, widest[0].n
    rows = rows.where(F.size("x") == width)
    summed = rows.select("x").mapInArrow(_sums(width), "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("s"))
    sums = [int(r.s) for r in sorted(summed.collect())]  # one for each dimension
    mean = _split([Fraction(s, n) for s in sums])
    cov = covariance(rows, "x", mean, n)
    values, basis = components(cov, most)
    trace = float(sum(map(Fraction, np.diag(cov))))
    positive = values > width * np.finfo(float).eps * max(values[0], 0.0)
    scaled = np.where(positive, basis / np.sqrt(np.where(positive, values, 1.0)), np.nan)
    done = scratch.cut(rows.mapInArrow(_whiten(sums, n, mean, scaled), f"id {id_kind}, deviation long, w array<double>"), "whitened")
    error = None
    if k := int(positive.sum()):  # falling, so these come first
        first = done.select(F.slice("w", 1, k).alias("w"))
        means = first.agg(F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(k))).alias("m")).first().m
        error = float(abs(covariance(first, "w", (np.array(means), np.zeros(k)), n) - np.eye(k)).max())
    share = F.array(*(F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values))
    return done.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("place", "whitened")).select(
        id_col, (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op13_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
