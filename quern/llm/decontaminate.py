"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of `window` words (a shorter item is one window). A document
contains a window in full or not at all, so of a window's words, ordered by rarity over all documents, the
prefix that must be joined is its rarest word. A document word that is some window's prefix token probes
the index: the token's place in the window gives the one start that can match (positional bound), a window
that would not fit between the ends of the text is passed over (length bound), and the words at that
start are compared exactly. Hits are the words inside matched windows.

Windows, their words, the words' counts over all documents and the prefix tokens are tables; nothing that grows with
the benchmark or the documents reaches the driver. The documents stream twice through tasks that hold two
filters of fixed size: one for (prefix token, place, length), one for whole windows. What passes both is joined
with the window table on the window's words themselves, so the join is exact whatever the filters let through;
a benchmark of any size takes the same path. Documents of one text are joined once.

Words are runs of ASCII letters and digits and any non-ASCII characters, after A-Z are lower-cased.

Defined results: a null or empty text has no words and no hits; an item without words is never found; items
with a null id are left out; items of equal text are all found; repeated documents are judged each. Extra
columns of either table are not read, or pass through `drop_contaminated` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bits import BITS, collect_bits
from quern.sources.scratch import Scratch

WINDOW = 10
#: Distinct words that a task counts, or remembers the filter's answer for, at a time.
TASK_WORDS = 200_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                found = windows_of(words_of(text.as_buffer().to_pybytes()), window)
                if found:
                    joined = pa.array([b" ".join(w).decode("utf-8", "replace") for w in found], pa.string())
                    yield pa.record_batch([pa.array([item.as_py()] * len(found), batch.schema.field(0).type), joined], names=["item", "win"])

    return run


def _hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


def _seed(place: int, size: int) -> int:
    """Of a prefix token's hash; 0 stands for a word alone, 1 for a window."""
    return (size << 16) + place + 2


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, seed) to its hash."""
    for batch in batches:
        hashes = [_hash(w.encode(), s) for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.record_batch([pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["h"])


def _filter(words: DataFrame, bits: int) -> bytes:
    return collect_bits(words.mapInArrow(_hashed, "h long"), "h", bits).tobytes()


def _may(table: bytes, word: bytes, seed: int) -> int:
    h = _hash(word, seed) & (len(table) * 8 - 1)
    return table[h >> 3] >> (h & 7) & 1


def _counts(table: bytes):
    """How often a task's texts hold each word that the filter lets through."""

    def made(found: dict[bytes, int]) -> pa.RecordBatch:
        some = [(w.decode("utf-8", "replace"), n) for w, n in found.items() if _may(table, w, 0)]
        return pa.record_batch([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    found.update(words_of(text.as_buffer().to_pybytes()))
                    if len(found) > TASK_WORDS:
                        yield made(found)
                        found.clear()
        yield made(found)

    return run


_PLACE = pa.struct([("start", pa.int32()), ("win", pa.string())])


def _probe(tokens: bytes, windows: bytes, kinds: list[tuple[int, int]]):
    """(kept columns, text) to (kept columns, n_words, places): where windows of the benchmark may start, and their words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            sizes, places = [], []
            for text in batch.column(batch.num_columns - 1):
                words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                found, n = {}, len(words)
                for i, w in enumerate(words):
                    own = known.get(w)
                    if own is None:
                        if len(known) >= TASK_WORDS:
                            known.clear()
                        own = known[w] = tuple((p, s) for p, s in kinds if _may(tokens, w, _seed(p, s))) if _may(tokens, w, 0) else ()
                    for place, size in own:
                        start = i - place
                        if start >= 0 and start + size <= n and (start, size) not in found:
                            win = b" ".join(words[start : start + size])
                            found[start, size] = win if _may(windows, win, 1) else None
                sizes.append(n)
                places.append([{"start": a, "win": win.decode("utf-8", "replace")} for (a, _), win in found.items() if win is not None])
            names = [*batch.schema.names[:-1], "n_words", "places"]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(places, pa.list_(_PLACE))], names=names)

    return run


def _text_id(text_col: str) -> Column:
    return F.md5(F.col(text_col))


def _marked(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, keep: list[Column], window: int, bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (kept columns, text_id, n_words) and hits (text_id, spans, item_ids) of the texts that have any."""
    kind = items.schema[item_col].dataType.simpleString()
    full = items.select(F.col(item_col).alias("item"), F.encode(item_text_col, "UTF-8").alias("t")).where("item is not null and t is not null")
    held = scratch.cut(full.mapInArrow(_windows(window), f"item {kind}, win string").distinct(), "windows")
    # the prefix of each window: its rarest word over all documents
    words = held.select("win").distinct().select("win", F.posexplode(F.split("win", " ")).alias("place", "word"))
    vocabulary = _filter(words.select("word", F.lit(0)).distinct(), bits)
    counted = docs.select(F.encode(text_col, "UTF-8").alias("t")).mapInArrow(_counts(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rated = words.join(counted, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("p"), F.count(F.lit(1)).alias("size"))
    prefixes = scratch.cut(rated.select("win", F.col("p.word").alias("word"), F.col("p.place").alias("place"), F.col("size").cast("int").alias("size")), "prefixes")
    # at most window * (window + 1) / 2 rows
    kinds = sorted(tuple(r) for r in prefixes.select("place", "size").distinct().collect())
    seeds = F.explode(F.array(F.lit(0), F.shiftleft("size", 16) + F.col("place") + 2))
    tokens = _filter(prefixes.select("word", seeds.alias("seed")).distinct(), bits)
    windows = _filter(prefixes.select("win", F.lit(1)), bits)
    wanted = docs.select(*keep, _text_id(text_col).alias("text_id"), F.encode(text_col, "UTF-8").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    marks = wanted.mapInArrow(_probe(tokens, windows, kinds), f"{schema}, n_words long, places array<struct<start: int, win: string>>")
    marks = scratch.cut(marks, "marks", compression="zstd")
    places = marks.where("size(places) > 0").select("text_id", F.explode("places").alias("p")).select("text_id", "p.start", "p.win").distinct()
    met = places.join(held, "win").select("text_id", "item", "start", (F.col("start") + F.size(F.split("win", " "))).alias("stop"))
    hits = met.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    ids = hits.schema["item_ids"].dataType.simpleString()
    hits = scratch.cut(hits.mapInArrow(_with_merged, f"text_id string, spans array<struct<start: int, stop: int>>, item_ids {ids}"), "hits")
    return marks.drop("places"), hits


def _merged(spans: list[dict]) -> list[dict]:
    """Sorted spans, those that touch as one."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def _with_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = pa.array([_merged(v) for v in batch.column(1).to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        yield pa.record_batch([batch.column(0), spans, batch.column(2)], names=batch.schema.names)


def mark_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    bits: int = BITS,
) -> DataFrame:
    """Per document: the columns in `keep` (under those names), n_words, spans (merged word ranges that are hit) and item_ids."""
    marks, hits = _marked(docs, items, text_col, item_col, item_text_col, [F.col(c) for c in keep], window, bits, Scratch(docs.sparkSession, "leaks"))
    hits = hits.withColumnRenamed("text_id", "hit_id")
    none = lambda c: F.coalesce(c, F.expr(f"cast(array() as {hits.schema[c].dataType.simpleString()})")).alias(c)
    return marks.join(hits, F.col("text_id") == F.col("hit_id"), "left").select(*keep, "n_words", none("spans"), none("item_ids"))


def op10_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of mark_passages: counts, and a hash over the ids of the items found."""
    found = mark_passages(docs, items)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    _, hits = _marked(docs, items, text_col, "item_id", "text", [], WINDOW, BITS, Scratch(docs.sparkSession, "leaks"))
    whole = docs.select(F.struct("*").alias("row"), _text_id(text_col).alias("text_id"))
    return whole.join(hits.select(F.col("text_id").alias("hit_id")), F.col("text_id") == F.col("hit_id"), "left_anti").select("row.*")


def brute_force(words: list[bytes], items: dict[object, list[bytes]], window: int = WINDOW) -> tuple[set[int], set]:
    """Positions hit and items found, by comparing every window with every place (for tests)."""
    hit, found = set(), set()
    for item, own in items.items():
        for win in windows_of(own, window):
            for start in range(len(words) - len(win) + 1):
                if tuple(words[start : start + len(win)]) == win:
                    hit.update(range(start, start + len(win)))
                    found.add(item)
    return hit, found


def sha256_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
