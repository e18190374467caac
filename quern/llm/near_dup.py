"""MinHash near-dedup with a multi-index Hamming join.

A document is the set of its distinct shingles, of SHINGLE words where nothing else is asked for. Texts with equal sets form one class, so copies cost
one row. Each class has a signature of POSITIONS minima, BITS bits each. Two signatures within DISTANCE
positions of each other have, by the pigeonhole principle, one of CHUNKS chunks with at most ERRORS errors;
all ways to leave ERRORS positions of a chunk out are enumerated as keys, so every such pair meets under at
least one key. At similarity 0.8 a pair lies beyond DISTANCE with a chance of about 1 in 7000. Links are
confirmed on the full sets.

A key shared by many classes is never expanded into pairs. Classes are dealt into batches by a hash of their number;
a batch sends one row for each of its distinct keys, that of the class with most copies, so a hot key sends a
row a batch. Sorted by key, the first row of each key is its centre for all members, of whichever batch (the others
of a batch learn it from an equi-join on key and local centre, of at most a batch of rows a value). Members are tested
against one of their centres; confirmed
members are connected through it. Only members left outside the component of a centre are then tested against
that component and against each other, set against set, in blocks of bounded bytes that emit one link per
member and component; what is skipped lies in one component already, so it could not change one.

Shingles are compared by 48 bits of a 64-bit hash. Words are runs of anything but ASCII white space, after
A-Z are lower-cased.

A class is known by 128 bits of its set's hashes and numbered when it is first written. A row is known by its id and a
hash of its text, so rows that share an id but not a text are told apart.

Defined results: a null, empty or blank text has no shingles, its own component and is kept. Rows that share
a doc_id get their own verdicts, by the text of each; two equal rows are both kept or both not. Null ids are
never the smallest, but link what they are similar to; a group of null ids alone has a null component and is kept.
Ids may be of any type that can be ordered. An empty table gives an empty result. Extra columns are not read, or pass through
`drop_near_copies` whatever their names; it keeps exactly one row of each group, equal rows with one id included,
and every text without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.sources.scratch import Scratch

SHINGLE = 2
POSITIONS, BITS, CHUNKS, ERRORS = 48, 16, 7, 2
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bytes of sets that one side of a block holds.
BLOCK_BYTES = 2 << 20
SIMILAR = 80  # percent
#: Classes whose keys a task combines at a time; its memory follows them, at about 10 KB a class.
TASK_CLASSES = 8_000

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values: the finaliser of splitmix64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_MULTIPLY, _ADD = _numbers(POSITIONS, 1) | U(1), _numbers(POSITIONS, 2)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    # in this order: lower-casing a slice of large strings reads from the wrong place in some Arrow versions
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, U)
    real = np.array([w != "" for w in words], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = codes[a:b]
        h = hashes[own[real[own]]] if len(own) else np.zeros(0, U)
        if not len(h):
            yield np.zeros(0, U)
            continue
        out = h[: max(1, len(h) - size + 1)].copy()
        for k in range(1, min(size, len(h))):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
        yield np.unique(mixed(out + U(len(h) if len(h) < size else size)))


def signature(items: np.ndarray) -> np.ndarray:
    """The low bits of the minima of POSITIONS hash functions."""
    low = np.full(POSITIONS, ~U(0))
    for at in range(0, len(items), 4096):
        low = np.minimum(low, (items[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return (low & U((1 << BITS) - 1)).astype("<u2")


def _packed(items: np.ndarray) -> bytes:
    return np.ascontiguousarray(items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _chunks() -> list[range]:
    bounds = [round(POSITIONS * k / CHUNKS) for k in range(CHUNKS + 1)]
    return [range(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its keys: every chunk without every choice of ERRORS of its positions."""
    place = np.arange(POSITIONS, dtype=U) << U(20)
    terms = mixed(signatures.astype(U) + place)
    out, number = [], 0
    for chunk in _chunks():
        total = terms[:, chunk.start : chunk.stop].sum(axis=1, dtype=U)
        for left_out in combinations(chunk, ERRORS):
            number += 1
            out.append(mixed(total - terms[:, list(left_out)].sum(axis=1, dtype=U) + U(number * 0x1000193)))
    return np.stack(out, axis=1)


def _signed(size: int):
    """(doc_id, th, text) to (doc_id, th, n_shingles, cid, tag, sig); cid and tag are two hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n_shingles", "cid", "tag", "sig"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, cid, tag, sig = [], [], [], []
                for items in shingle_sets(batch.column(2), size):
                    some = len(items) > 0
                    n.append(len(items))
                    with np.errstate(over="ignore"):
                        cid.append(int(mixed(items).sum(dtype=U).astype(np.int64)) if some else None)
                        tag.append(int(mixed(items ^ _TAG).sum(dtype=U).astype(np.int64)) if some else None)
                    sig.append(signature(items).tobytes() if some else None)
                made = [pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(tag, pa.int64()), pa.array(sig, pa.binary())]
                yield pa.record_batch([batch.column(0), batch.column(1), *made], names=names)

    return run


_TAG = U(0xA0761D6478BD642F)
_BEST, _MEMBER = "key long, cid long, copies long", "key long, cid long, centre long"


def _keyed(best: bool):
    """Of a batch of classes, by key: the class with most copies (best), or the others with that one as their centre."""

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
        keys = index_keys(sig)
        width = keys.shape[1]
        keys, cid = keys.reshape(-1), np.repeat(table.column("cid").to_numpy(), width)
        copies = np.repeat(table.column("copies").to_numpy(), width)
        order = np.lexsort((cid, -copies, keys))
        keys, cid, copies = keys[order], cid[order], copies[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        if best:
            return pa.table({"key": pa.array(keys[first].view(np.int64)), "cid": pa.array(cid[first]), "copies": pa.array(copies[first])})
        centre = cid[first][np.cumsum(first) - 1]
        other = ~first & (cid != centre)
        return pa.table({"key": pa.array(keys[other].view(np.int64)), "cid": pa.array(cid[other]), "centre": pa.array(centre[other])})

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = [_packed(x) for x in shingle_sets(batch.column(1), size)]
                yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["cid", "items"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (x, y, items_x, items_y) the pairs that are similar on their full sets."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        good = []
        for k in range(batch.num_rows):
            a, b = _unpacked(left[k].as_buffer().to_pybytes()), _unpacked(right[k].as_buffer().to_pybytes())
            small, large = sorted((len(a), len(b)))
            same = 0
            if 100 * small >= SIMILAR * large:
                both = np.sort(np.concatenate([a, b]))
                same = int((both[1:] == both[:-1]).sum())
            good.append(100 * same >= SIMILAR * (len(a) + len(b) - same))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a block of outside classes (x, cx, items) and one of candidates (y, cy, items): per x and other component one link, if there is any."""
    links: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        y, cy = right.column("cid").to_numpy(), right.column("comp").to_numpy()
        sets = [_unpacked(v.as_buffer().to_pybytes()) for v in right.column("items").combine_chunks()] if right.num_rows else []
        sizes = np.array([len(v) for v in sets])
        items = np.concatenate(sets)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], np.repeat(np.arange(len(sets)), sizes)[order]
        for x, cx, raw in zip(left.column("cid").to_pylist(), left.column("comp").to_pylist(), left.column("items").to_pylist(), strict=True):
            own = _unpacked(raw)
            low, high = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            same = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero((100 * same >= SIMILAR * (len(own) + sizes - same)) & (cy != cx))
            _, first = np.unique(cy[good], return_index=True)
            links += [(x, int(v)) for v in y[good[first]]]
    return pa.table({"x": pa.array([min(p) for p in links], pa.int64()), "y": pa.array([max(p) for p in links], pa.int64())})


class _Linker:
    """Confirmed links and components over classes, in rounds."""

    def __init__(self, sets: DataFrame, scratch: Scratch) -> None:
        self.sets, self.scratch = sets, scratch
        self.links = self.components = self.tested = None

    def test(self, pairs: DataFrame) -> None:
        """Confirms pairs (x < y) and brings the components up to date."""
        self.tested = self.scratch.cut(pairs.select("x", "y").distinct(), "pairs")
        self.add(self.confirmed(self.tested))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("cid").alias("x"), F.col("items").alias("a"))
        right = self.sets.select(F.col("cid").alias("y"), F.col("items").alias("b"))
        both = pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b")
        return both.mapInArrow(_confirm, "x long, y long")

    def add(self, links: DataFrame) -> None:
        good = self.scratch.cut(links, "links")
        self.links = good if self.links is None else self.links.union(good)
        self.components = self.scratch.cut(connected_components(self.links, "x", "y", self.scratch), "components")

    def labelled(self, df: DataFrame, column: str, label: str) -> DataFrame:
        names = self.components.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        return df.join(names, F.col(column) == F.col("__n"), "left").withColumn(label, F.coalesce("__c", column)).drop("__n", "__c")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def link_classes(classes: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> DataFrame | None:
    """(node, component) over the classes that have a link; classes has (cid, doc_id, th, copies, sig), docs (doc_id, th, text) of every class's row."""
    batches = max(1, -(-classes.count() // TASK_CLASSES))
    dealt = classes.select("cid", "sig", "copies", F.pmod(F.xxhash64("cid"), F.lit(batches)).alias("batch")).groupBy("batch")
    first_of_key = F.first("cid").over(Window.partitionBy("key").orderBy(F.desc("copies"), "cid"))
    met = dealt.applyInArrow(_keyed(True), _BEST).withColumn("centre", first_of_key)
    met = scratch.cut(met.where("cid <> centre").select("key", "cid", "centre"), "met")
    # a member's centre is that of its key over all batches, so members of different batches fall into one group
    local = dealt.applyInArrow(_keyed(False), _MEMBER)
    top = met.select(F.col("key").alias("k"), F.col("cid").alias("c"), F.col("centre").alias("top"))
    local = local.join(top, (F.col("key") == F.col("k")) & (F.col("centre") == F.col("c")), "left").select("cid", F.coalesce("top", "centre").alias("centre"))
    stars = local.union(met.select("cid", "centre")).groupBy("cid", "centre").agg(F.count(F.lit(1)).alias("shared"))
    stars = scratch.cut(stars, "stars")
    scratch.drop(met)
    if stars.isEmpty():
        return None
    involved = stars.select("cid").union(stars.select("centre")).distinct()
    reps = classes.join(involved, "cid").select("cid", F.col("doc_id").alias("rep"), F.col("th").alias("rep_th"))
    texts = docs.join(reps, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "text")
    # equal rows give a class's set more than once
    sets = texts.mapInArrow(_with_sets(shingle), "cid long, items binary").groupBy("cid").agg(F.first("items").alias("items"))
    sets = scratch.cut(sets, "sets")
    linker = _Linker(sets, scratch)
    # each member against the centre it shares most keys with
    first = stars.groupBy("cid").agg(F.max(F.struct("shared", "centre")).alias("b")).select("cid", F.col("b.centre").alias("centre"))
    linker.test(first.select(*_pair("cid", "centre")))
    # then those outside any centre's component against that component
    named = linker.labelled(linker.labelled(stars.select("cid", "centre"), "cid", "c1"), "centre", "c2")
    linker.add(_outside_links(named.where("c1 <> c2").select("cid", F.col("c1").alias("comp"), F.col("c2").alias("g")).distinct(), linker, scratch))
    return linker.components


def _outside_links(outside: DataFrame, linker: _Linker, scratch: Scratch) -> DataFrame:
    """Links between classes outside a component and its members, and among those outside it; outside has (cid, comp, g), g the component."""
    outside = scratch.cut(outside, "outside")
    groups = outside.select("g").distinct()
    inside = linker.labelled(linker.sets.select("cid"), "cid", "comp").join(groups, F.col("comp") == F.col("g")).select("cid", "comp", "g")
    sides = scratch.cut(outside.union(inside).withColumn("out", F.lit(False)).union(outside.withColumn("out", F.lit(True))), "sides")
    sized = sides.join(linker.sets.select("cid", F.octet_length("items").alias("bytes")), "cid")
    per = sized.groupBy("g").agg(
        F.ceil(F.sum(F.when(F.col("out"), F.col("bytes")).otherwise(0)) / BLOCK_BYTES).cast("int").alias("nx"),
        F.ceil(F.sum(F.when(~F.col("out"), F.col("bytes")).otherwise(0)) / BLOCK_BYTES).cast("int").alias("ny"),
        F.count_if(~F.col("out")).alias("n"),
        F.max(F.when(F.col("out"), F.col("cid"))).alias("only"),
    )
    per = scratch.cut(per, "blocks")
    # one outside class and a component of one class, which is its own name: a pair, unless it is among those tested
    lone = per.where("n = 2").select(*_pair("only", "g")).distinct().join(linker.tested, ["x", "y"], "left_anti")
    per = per.where("n > 2")
    full = sides.join(per, "g").join(linker.sets.select("cid", "items"), "cid")
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # aliases: the two sides of a cogroup may not share columns
    own = [F.col(c).alias(c) for c in ("g", "cid", "comp", "items")]
    x = full.where("out").select(*own, mine("nx").alias("ix"), every("ny").alias("iy"))
    y = full.where("not out").select(*own, every("nx").alias("ix"), mine("ny").alias("iy"))
    keys = ["g", "ix", "iy"]
    blocks = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_block_links, "x long, y long")
    return blocks.union(linker.confirmed(lone))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, cid, tag) and classes (cid, tag, node, component, doc_id, th); doc_id and th of a class are its smallest row's."""
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    signed = scratch.cut(own.mapInArrow(_signed(shingle), f"doc_id {kind}, th long, n_shingles long, cid long, tag long, sig binary"), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = signed.where("cid is not null").groupBy("cid", "tag").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    # numbers are given once, as the table is written
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("node"), "cid", "tag", "row.doc_id", "row.th", "copies", "sig"), "classes")
    found = link_classes(classes.select(F.col("node").alias("cid"), "doc_id", "th", "copies", "sig"), own, scratch, shingle)
    named = classes.select("cid", "tag", "node", "doc_id", "th")
    if found is None:
        return signed.drop("sig"), named.withColumn("component", F.col("node"))
    found = found.withColumnRenamed("node", "linked")
    named = named.join(found, F.col("node") == F.col("linked"), "left").withColumn("component", F.coalesce("component", "node")).drop("linked")
    return signed.drop("sig"), scratch.cut(named, "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document; shingle is the number of words in one."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed, classes = _grouped(docs, id_col, text_col, shingle, scratch)
    # read back, so that the join on a large component can be split
    low = scratch.cut(classes.groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("component_id")), "names")
    named = classes.join(low, F.col("component") == F.col("c")).select(F.col("cid").alias("k"), F.col("tag").alias("t"), "component_id")
    out = signed.join(named, (F.col("cid") == F.col("k")) & (F.col("tag") == F.col("t")), "left")
    out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_multi_index_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, that with the smallest id, with the columns it came with."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed, classes = _grouped(docs, id_col, text_col, shingle, scratch)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "node")
    first = scratch.cut(classes.groupBy(F.col("component").alias("c")).agg(F.min(row).alias("first")), "first")
    named = classes.join(first, F.col("component") == F.col("c")).select(F.col("cid").alias("k"), F.col("tag").alias("t"), "node", "first")
    judged = signed.join(named, (F.col("cid") == F.col("k")) & (F.col("tag") == F.col("t"))).withColumn(
        "stays", (F.col("node") == F.col("first.node")) & (F.col("th") == F.col("first.th")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    )
    # rows of one id and text share a verdict: gone, or one of them stays
    rows = judged.groupBy("doc_id", "th").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    rows = scratch.cut(rows.select(F.col("doc_id").alias("i"), F.col("th").alias("h"), "stays"), "rows")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"))
    same = (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i"))
    kept = whole.join(rows, same, "left_anti").select("row.*")
    again = rows.where("stays")
    if again.isEmpty():
        return kept
    one = whole.join(again, same, "left_semi").groupBy("doc_id", "th").agg(F.first("row").alias("row"))
    return kept.union(one.select("row.*"))
