"""Line dedup by a segment-partition edit join.

Equal lines form one class. Classes are joined within EDITS edits, whatever their length: a line is split into EDITS + 1 segments of even length; a line within EDITS edits of it, and no longer than it by
more than that, holds at least one segment unchanged. Every line has keys for its own segments and, for each
shorter length it may match and each segment, for the few substrings whose place the edits left and right of
the segment allow (multi-match-aware selection). Long pieces are named by the least hash of their windows and its
place, which substrings that overlap mostly share, so lines of prose have about six keys in place of fifteen.
Candidates are verified with banded bit-parallel edit distance.

All links between different lines are found and counted; copies are not expanded. Lines of EDITS characters
or fewer have empty segments, which meet all lines near them in length: any two such lines are within EDITS edits.
Keys are sorted once, and those that one line alone has go before the join. The rest meet in an equi-join on key and
length, which adaptive execution can split where one segment is frequent; counts of characters by class, which every
edit changes by two at most, are part of its condition. Tasks drop repeated lines before the shuffle, and whole texts are never
shuffled: entries are hashes, and only lines with a candidate partner are read again for the verification (a
filter of fixed size finds them, the join after it is exact). Verified links leave a task as counts and the edges
of a forest, so they do not grow with the square of a group; the candidates of lines that are alike in all but a
few characters do, as each of them is compared.

A line is named by its MD5; segments and ends of candidate pairs by 64-bit hashes, which only ever add pairs to verify.

Lines are the pieces of the whole text between line feeds, trimmed of ASCII white space; blank ones are no
lines.

Defined results: null or empty texts have no lines. Repeated rows repeat their lines. Null ids count as
rows but are never a line's first document. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bits import collect_bits, passes
from quern.operators.components import connected_components
from quern.sources.scratch import Scratch

EDITS = 2
SPACE = " \t\n\x0b\f\r"
_SPACE = SPACE.encode()
#: Bytes of texts whose distinct lines a task holds, and characters that it counts, at a time.
TASK_BYTES = 8 << 20
PART = 1 << 20


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line; the last ones are longer by one where it does not divide."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        own = size + (k >= parts - longer)
        out.append((at, own))
        at += own
    return out


def probes(length: int, shorter: int, edits: int = EDITS) -> Iterator[tuple[int, int, int]]:
    """(segment number, start in the longer line, size): where the segments of a line of `shorter` characters may lie in one of `length`."""
    gap = length - shorter
    for k, (start, size) in enumerate(segments(shorter, edits)):
        # at most k edits lie left of segment k if it is the first unchanged one, at most edits - k right of it
        low = max(0, start - k, start + gap - (edits - k))
        high = min(length - size, start + k, start + gap + (edits - k))
        for at in range(low, high + 1):
            yield k, at, size


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel columns, of which only the band of 2 * edits + 1 rows is kept."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    # equal ends cost nothing
    start, stop = 0, len(a)
    while start < stop and a[start] == b[start]:
        start += 1
    cut = 0
    while cut < stop - start and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[start : len(a) - cut], b[start : len(b) - cut]
    m, n = len(a), len(b)
    if not m:
        return n <= edits
    # state s[k]: bit d set if, after the characters of a read so far, k edits reach the place in b that lies d - edits beyond them
    width = 2 * edits + 1
    mask = (1 << width) - 1
    state = [0] * (edits + 1)
    for k in range(edits + 1):
        for d in range(width):
            if 0 <= d - edits <= k:
                state[k] |= 1 << d
    window: dict[str, int] = {}
    for at in range(min(n, edits)):
        window[b[at]] = window.get(b[at], 0) | 1 << (at + edits)
    for i in range(m):
        # bit d of equal: a[i] == b[i + d - edits]
        fresh = i + edits
        if fresh < n:
            window[b[fresh]] = window.get(b[fresh], 0) | 1 << (2 * edits)
        equal = window.get(a[i], 0) & mask
        before, out = state, []
        for k in range(edits + 1):
            now = before[k] & equal  # a match stays on its diagonal
            if k:
                now |= before[k - 1]  # a substitution does too
                now |= before[k - 1] >> 1  # a character of a left out moves one diagonal back
                now |= (out[k - 1] << 1) & mask  # one of b put in moves one on
            out.append(now)
        state = out
        if not any(state):
            return False
        for c, bits in list(window.items()):
            bits >>= 1
            if bits:
                window[c] = bits
            else:
                del window[c]
    return bool(state[edits] >> (n - m + edits) & 1)


#: Pieces of so many characters and more are named by the least hash of their windows of WINDOW characters, shorter ones by the hash of all of it.
WIDE = ((64, 32), (32, 16))
#: Pieces of fewer characters keep the exact length of the shorter line in their key, those that are named by windows its multiple of LENGTHS.
NARROW, LENGTHS = 8, 16
#: Pieces of so many characters and more are hashed by themselves, so that the arrays of a part stay small.
LONG = 1 << 18
#: Characters of lines that are hashed at a time.
SLICE = 1 << 17
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bits of a window's hash that give way to its place: more than a part's characters need.
_PLACE = np.uint64((1 << 24) - 1)
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _tag(length: int, number: int, size: int) -> int:
    """What a piece's key holds besides the piece: it depends on the shorter line's length, the segment's number and its size alone, so both lines of a pair find the same."""
    if size < NARROW:
        return (length * 16 + number) * 3
    if size < WIDE[-1][0]:
        return (size * 16 + number) * 3 + 1
    return (length // LENGTHS * 16 + number) * 3 + 2


@lru_cache(maxsize=20_000)
def _plan(n: int, edits: int) -> np.ndarray:
    """Starts, sizes, tags and zeros of all places where a line of `n` characters may hold a segment of one no longer; its own segments are among them.
    Lines with fewer places than others repeat their first. A window's place less the zero is its place in the shorter line, in the last segment as seen from the end."""
    rows = []
    for m in range(max(1, n - edits), n + 1):
        starts = [start for start, _ in segments(m, edits)]
        rows += [(at, size, _tag(m, k, size), n if k == edits else at - starts[k]) for k, at, size in probes(n, m, edits)]
    rows = list(dict.fromkeys(rows))
    return np.array(rows + rows[:1] * (_width(edits) - len(rows)), np.int64).T


@lru_cache(maxsize=8)
def _width(edits: int) -> int:
    n = 8 * (edits + 1) ** 2
    return sum(1 for m in range(n - edits, n + 1) for _ in probes(n, m, edits))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BACK):
        own = np.full(n, base, np.uint64)
        own[0] = 1
        out.append(np.cumprod(own, out=own))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _ONE
    x ^= x >> np.uint64(29)
    x *= _TWO
    x ^= x >> np.uint64(32)
    return x


def _alone(text: str, at: int, size: int) -> int:
    return xxhash.xxh3_64_intdigest(text[at : at + size].encode("utf-8", "surrogateescape"))


def _slice_keys(texts: list[str], sizes: np.ndarray, edits: int) -> np.ndarray:
    """(line, place) to 64-bit key; places that a line has not are repeats of its first."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    table = np.stack([_plan(n, edits) for n in kinds.tolist()])
    at, size, tag, zero = (table[kind, i] for i in range(4))
    out = np.zeros(at.shape, np.uint64)
    single = size >= LONG
    if not single.all():
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        powers, back = (x[: n + 1] for x in _powers(max(SLICE, 1 << n.bit_length()) + 1))
        codes += np.uint64(1)
        codes *= _TWO
        sums = np.zeros(n + 1, np.uint64)
        np.right_shift(codes, np.uint64(32), out=sums[1:])
        codes ^= sums[1:]
        codes *= powers[:n]
        np.cumsum(codes, out=sums[1:])
        place = at + (np.cumsum(sizes) - sizes)[:, None]
        whole = size < WIDE[-1][0]
        low = place[whole]
        out[whole] = (sums[low + size[whole]] - sums[low]) * back[low]
        most, spots = LONG, np.arange(n + 1, dtype=np.uint64)
        for least, window in WIDE:
            own = (size >= least) & (size < most)
            most = least
            if own.any():
                hashes = np.empty(n - window + 2, np.uint64)
                np.subtract(sums[window:], sums[:-window], out=hashes[:-1])
                hashes[:-1] *= back[: n - window + 1]
                hashes[-1] = 0
                # the low bits hold the window's place, so that the least hash tells where it is
                hashes &= ~_PLACE
                hashes |= spots[: len(hashes)]
                ends = np.stack([place[own], place[own] + size[own] - window + 1], axis=1)
                least_one = np.minimum.reduceat(hashes, ends.ravel())[::2]
                seen = (least_one & _PLACE).astype(np.int64) - (place - at + zero)[own]
                out[own] = (least_one & ~_PLACE) + seen.astype(np.uint64)
    for i, j in zip(*np.nonzero(single), strict=True):
        out[i, j] = _alone(texts[i], int(at[i, j]), int(size[i, j]))
    return _mixed(out ^ _mixed(tag.astype(np.uint64)))


def keys_of(lines: list[bytes], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each line has, and the 64-bit keys. Of two lines within `edits` edits the shorter has a key, that of an unchanged segment, which the longer has too."""
    counts, keys, at = [], [], 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) <= SLICE):
            size += len(lines[stop])
            stop += 1
        texts = [x.decode("utf-8", "surrogateescape") for x in lines[at:stop]]
        own = _slice_keys(texts, np.fromiter(map(len, texts), np.int64, len(texts)), edits)
        own.sort(axis=1)
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = own[:, 1:] != own[:, :-1]
        counts.append(fresh.sum(axis=1))
        keys.append(own[fresh])
        at = stop
    return (np.concatenate(counts), np.concatenate(keys)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def bags_of(lines: list[bytes]) -> np.ndarray:
    """For each line sixteen counts of characters by the low bits of their code points, each modulo eight as a ring of four bits, on which one step changes one bit."""
    counts = np.zeros((len(lines), 16), np.int64)
    at = 0
    while at < len(lines):
        # so many lines at a time as hold PART characters, or one longer line in parts
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) <= PART):
            size += len(lines[stop])
            stop += 1
        texts = [x.decode("utf-8", "surrogateescape") for x in lines[at:stop]]
        sizes = [len(x) for x in texts]
        whole = "".join(texts)
        owner = np.repeat(np.arange(stop - at) * 16, sizes) if stop - at > 1 else 0
        for low in range(0, len(whole), 2 * PART):
            codes = np.frombuffer(whole[low : low + 2 * PART].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & 15
            counts[at:stop] += np.bincount(owner + codes, minlength=16 * (stop - at)).reshape(-1, 16)
        at = stop
    return (_RING[counts & 7] << _PLACES).sum(axis=1, dtype=np.uint64)


_PLACES = np.arange(0, 64, 4, dtype=np.uint64)
_RING = np.array([0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000], np.uint64)


def bags_near(a: str, b: str, edits: int) -> str:
    """SQL: an edit takes away at most one character and puts in at most one, so bags differ by 2 * edits at most."""
    return f"bit_count({a} ^ {b}) <= {2 * edits}"


def _split(text: bytes) -> Iterator[bytes]:
    for piece in text.split(b"\n"):
        line = piece.strip(_SPACE)
        if line:
            yield line


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _distinct_lines(column: pa.Array) -> Iterator[list[bytes]]:
    """The distinct lines of about TASK_BYTES of texts at a time."""
    held: dict[bytes, None] = {}
    size = 0
    for text in _texts(column):
        held.update(dict.fromkeys(_split(text)))
        size += len(text)
        if size >= TASK_BYTES:
            yield list(held)
            held, size = {}, 0
    if held:
        yield list(held)


def _ids(lines: list[bytes]) -> list[bytes]:
    return [hashlib.md5(x, usedforsecurity=False).digest() for x in lines]


def _halves(ids: list[bytes]) -> np.ndarray:
    """The first 64 bits of each id."""
    return np.frombuffer(b"".join(ids), "<i8")[::2] if ids else np.zeros(0, "<i8")


def _members(edits: int):
    """(doc_id, text) to (doc_id, line_id, n_chars, n_rows), a row for each distinct line of a text; the first row of a line among about TASK_BYTES
    of texts has its half, bag and keys too."""
    names = ["doc_id", "line_id", "n_chars", "n_rows", "half", "bag", "keys"]

    def made(docs: pa.Array, rows: list[int], lines: list[bytes], counts: list[int]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(x, len(number)) for x in lines), np.int64, len(lines))
        distinct = list(number)
        first = np.zeros(len(lines), bool)
        first[np.unique(own, return_index=True)[1]] = True  # numbers rise with the rows, so the first rows lie in the order of `distinct`
        ids = _ids(distinct)
        chars = np.fromiter((len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in distinct), np.int64, len(distinct))
        sizes, keys = keys_of(distinct, edits)
        ends = np.zeros(len(lines) + 1, np.int32)
        ends[1:][first] = sizes
        held = pa.array(np.where(first, own, 0), mask=~first)
        return pa.record_batch(
            [
                docs.take(pa.array(rows, pa.int64())),
                pa.array(ids, pa.binary()).take(pa.array(own)),
                pa.array(chars[own]),
                pa.array(counts, pa.int64()),
                pa.array(_halves(ids)).take(held),
                pa.array(bags_of(distinct).view(np.int64)).take(held),
                pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.view(np.int64))),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            rows, lines, counts, size = [], [], [], 0
            for row, text in enumerate(_texts(batch.column(1))):
                found = Counter(_split(text))
                rows += [row] * len(found)
                lines += found.keys()
                counts += found.values()
                size += len(text)
                if size >= TASK_BYTES:
                    yield made(docs, rows, lines, counts)
                    rows, lines, counts, size = [], [], [], 0
            if rows:
                yield made(docs, rows, lines, counts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (half, bag, key) sorted by key and half, each different row once whose key, without the bits of the length, another line has too."""
    held, known = None, False  # the last row, and whether the row before it has its key
    for batch in batches:
        own = np.stack([batch.column(i).to_numpy() for i in range(3)])
        if held is not None:
            own = np.concatenate([held, own], axis=1)
        if not own.shape[1]:
            continue
        fresh = np.ones(own.shape[1], bool)
        fresh[1:] = (own[:, 1:] != own[:, :-1]).any(axis=0)
        own = own[:, fresh]
        before = np.zeros(own.shape[1], bool)
        before[0] = known
        before[1:] = own[2, 1:] >> 4 == own[2, :-1] >> 4
        good = before.copy()
        good[:-1] |= before[1:]
        held, known = own[:, -1:], bool(before[-1])
        yield pa.record_batch([pa.array(x[:-1][good[:-1]]) for x in own], names=["half", "bag", "key"])
    if known:
        yield pa.record_batch([pa.array(x) for x in held], names=["half", "bag", "key"])


def _wanted(bits: np.ndarray):
    """(half, line_id, line) of the lines that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _distinct_lines(batch.column(0)):
                ids = _ids(lines)
                halves = _halves(ids)
                good = np.flatnonzero(passes(bits, halves.view(np.uint64)))
                for low in range(0, len(good), 5_000):
                    at = good[low : low + 5_000]
                    yield pa.record_batch(
                        [pa.array(halves[at]), pa.array([ids[i] for i in at], pa.binary()), pa.array([lines[i].decode("utf-8", "replace") for i in at], pa.string())],
                        names=["half", "line_id", "line"],
                    )

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(a, b, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _summed(edits: int):
    """Verified pairs as (a, b, n): the edges (a, b) of a forest over those of a batch, and how many links of the batch each line has (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _verify(edits)(batches):
            degree: Counter = Counter()
            parent: dict[bytes, bytes] = {}

            def root(x: bytes) -> bytes:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = parent[up] if up in parent else up
                    x = up
                return x

            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                degree[x] += 1
                degree[y] += 1
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            edges = [(x, root(x), None) for x in parent if root(x) != x]
            rows = edges + [(x, None, n) for x, n in degree.items()]
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line) of every line that is not blank."""
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    return pieces.select("doc_id", F.btrim("line", F.lit(SPACE)).alias("line")).where("line <> ''")


def line_members(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_id, n_chars, n_rows): which document holds which line class, and how often; rows that share an id have rows each.
    Some row of each line has half, bag and keys, what candidate_pairs() joins by."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, line_id binary, n_chars long, n_rows long, half long, bag long, keys array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_members(edits), schema)


def candidate_pairs(docs: DataFrame, members: DataFrame, scratch: Scratch, edits: int = EDITS, text_col: str = "text") -> DataFrame:
    """(x, y, left, right): ids and lines of the pairs that share a key and have bags that near; `members` as line_members() gives them."""
    # the last four bits of a key give way to those of the line's length
    entries = members.where("half is not null").select("half", "bag", "n_chars", F.explode("keys").alias("key")).select("half", "bag", F.expr("(key & -16L) | (n_chars & 15)").alias("key"))
    # keys that one line alone has, nearly all of them in prose, go before the join; a line that many tasks hold stays once
    shared = entries.repartition(F.shiftright("key", 4)).sortWithinPartitions("key", "half").mapInArrow(_shared, "half long, bag long, key long")
    shared = scratch.cut(shared, "shared")
    own = shared.select(F.col("half").alias("hx"), F.col("bag").alias("bag_x"), F.shiftright("key", 4).alias("key"), F.expr("key & 15").alias("length"))
    # a line meets those that are as long or up to `edits` shorter, so what is compared under a key has near lengths
    other = shared.select(F.col("half").alias("hy"), F.col("bag").alias("bag_y"), F.shiftright("key", 4).alias("other"), F.explode(F.expr(f"transform(sequence(0, {edits}), i -> (key - i) & 15)")).alias("shorter"))
    # the bags stand in the join's condition: pairs that differ in more than the edits allow are never made
    meet = (F.col("key") == F.col("other")) & (F.col("length") == F.col("shorter")) & (F.col("hx") != F.col("hy")) & F.expr(bags_near("bag_x", "bag_y", edits))
    met = own.join(other, meet).select(F.least("hx", "hy").alias("hx"), F.greatest("hx", "hy").alias("hy")).distinct()
    met = scratch.cut(met, "candidates")
    scratch.drop(shared)
    ends = met.select(F.col("hx").alias("end")).union(met.select("hy")).distinct()
    texts = docs.select(F.col(text_col).alias("text"))
    found = texts.mapInArrow(_wanted(collect_bits(ends, "end")), "half long, line_id binary, line string").join(ends, F.col("half") == F.col("end"), "left_semi")
    lines = scratch.cut(found.groupBy("half", "line_id").agg(F.first("line").alias("line")), "lines", compression="zstd")
    side = lambda h, i, t: lines.select(F.col("half").alias(h), F.col("line_id").alias(i), F.col("line").alias(t))
    return met.join(side("hx", "x", "left"), "hx").join(side("hy", "y", "right"), "hy").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "left", "right")


def similar_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(line classes, links): classes has line_id, line, n_rows, doc_id (the first document that holds it); links has every pair x < y."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    classes = lines_of(docs, id_col, text_col).groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("doc_id"))
    classes = classes.select(F.unhex(F.md5("line")).alias("line_id"), "line", "n_rows", "doc_id")
    members = scratch.cut(line_members(docs, edits, id_col, text_col), "members")
    return classes, candidate_pairs(docs, members, scratch, edits, text_col).mapInArrow(_verify(edits), "x binary, y binary")


def op7_segment_edit_join(docs: DataFrame) -> DataFrame:
    """One row per document id and distinct line of it: doc_id, line_id, n_rows (copies in this document), then of the
    line first_doc_id, line_rows (copies in all), n_chars, n_links (other lines within EDITS edits) and component_doc_id
    and component_rows of its group."""
    scratch = Scratch(docs.sparkSession, "lines")
    members = scratch.cut(line_members(docs), "members")
    summed = scratch.cut(candidate_pairs(docs, members, scratch).mapInArrow(_summed(EDITS), "a binary, b binary, n long"), "links")
    groups = connected_components(summed.where("b is not null"), "a", "b", scratch)
    degree = summed.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    named = scratch.cut(groups.join(degree, F.col("node") == F.col("a")).select("node", "component", "n_links"), "groups")
    own = members.groupBy("line_id").agg(F.min("doc_id").alias("first_doc_id"), F.sum("n_rows").alias("line_rows"), F.max("n_chars").alias("n_chars"))
    classes = scratch.cut(own, "classes")
    linked = classes.join(named, F.col("line_id") == F.col("node"))
    sums = linked.groupBy(F.col("component").alias("c")).agg(F.min("first_doc_id").alias("component_doc_id"), F.sum("line_rows").alias("component_rows"))
    named = named.join(sums, F.col("component") == F.col("c"))
    found = classes.join(named, F.col("line_id") == F.col("node"), "left").select(
        "line_id",
        "first_doc_id",
        "line_rows",
        "n_chars",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_doc_id", "first_doc_id").alias("component_doc_id"),
        F.coalesce("component_rows", "line_rows").cast("long").alias("component_rows"),
    )
    found = scratch.cut(found, "found")  # read back, so that the join on a frequent line can be split
    scratch.drop(classes)
    out = members.groupBy("doc_id", "line_id").agg(F.sum("n_rows").alias("n_rows")).join(found, "line_id")
    return out.select(F.lower(F.hex("line_id")).alias("line_id"), "doc_id", "n_rows", *found.columns[1:])
