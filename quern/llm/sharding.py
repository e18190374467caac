"""Sharding by sampled splitters, with built-in functions only.

Records are ordered by (hash of the text, hash of the id), so equal texts lie together. A sample is drawn in
proportion to record size; its weighted quantiles give `shards * PER_SHARD` ranges. Exact range totals then
settle the rest: ranges are laid end to end and each goes to the shard its middle falls in. Where ranges would hold more than
RANGE_BYTES each, all are cut into as many parts by the text's hash, so that no task sorts more; a range that
turned out overfull is subdivided by a hash of the id and of the row's number, which it gets when the keys are written.
Slots number a shard's records without gaps, in key order.

Sizes follow the law `bytes`: shards differ by about one range. Of the two wishes, equal sizes and equal texts together, sizes
win: equal texts lie in one range, and so mostly in one shard, until they outweigh OVERFULL ranges; then they are spread, whether their
ids differ, repeat or are null.

What reaches the driver is the splitters, `shards * PER_SHARD` of them at any input size, and the sizes of overfull
ranges; the sample holds about SAMPLE rows. Passes after the first read a table of (id, size, checksum, hashes, row number).

Defined results: a null text has no bytes, size 1 and the checksum of no bytes. Repeated rows get a slot
each. A null id sorts by its hash. An empty table gives an empty result. Extra columns are not read, or pass
through `assign_shards` whatever their names. Reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

SHARDS = 16
#: Ranges per shard, a square: two searches of 15 steps each find a record's range.
PER_SHARD = 256
SAMPLE = 1 << 16
#: A range of more than so many times the mean is cut into that many pieces.
OVERFULL = 2
#: Bytes of records that a task sorts.
RANGE_BYTES = 256 << 20


def _splitters(keys: DataFrame, total: int, cells: int) -> list[tuple[int, int]]:
    """The smallest sampled key of each of `cells` ranges of equal sampled weight, but for the first."""
    rate = SAMPLE / max(total, 1)
    # a record longer than one sampling step is always drawn and weighs its own steps
    chance = F.pmod(F.xxhash64("k2", F.lit(9)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(chance < F.col("size") * rate).select("k1", "k2", F.greatest(F.lit(1.0), F.col("size") * rate).alias("weight"))
    order = Window.orderBy("k1", "k2")
    upto = drawn.withColumn("upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    weight = F.sum("weight").over(Window.orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = upto.withColumn("cell", F.floor((F.col("upto") - F.col("weight")) / weight * cells).cast("int"))
    low = placed.groupBy("cell").agg(F.min(F.struct("k1", "k2")).alias("low")).orderBy("cell")
    return [(r.low.k1, r.low.k2) for r in low.collect()][1:]


def _key(k1: int, k2: int) -> str:
    return f"named_struct('k1', {_long(k1)}, 'k2', {_long(k2)})"


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def _range_of(splitters: list[tuple[int, int]]) -> str:
    """SQL for the number of splitters at or below (k1, k2): first among every 64th, then between two of those."""
    if not splitters:
        return "0"
    step = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    below = "(x -> x.k1 < k1 or (x.k1 = k1 and x.k2 <= k2))"
    heads = "array(" + ", ".join(_key(*g[0]) for g in groups) + ")"
    fields = "array(" + ", ".join("array(" + ", ".join(_key(*s) for s in g) + ")" for g in groups) + ")"
    found = f"size(filter({heads}, {below[1:-1]}))"
    inner = f"(g - 1) * {step} + size(filter({fields}[g - 1], {below[1:-1]}))"
    return f"transform(array({found}), g -> if(g = 0, 0, {inner}))[0]"


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, per_shard: int = PER_SHARD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per document; `keep` puts the document's own row first, as a struct named `row`."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = [
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"),
        F.monotonically_increasing_id().alias("rid"),
    ]
    rows = scratch.cut(docs.select(*([F.struct("*").alias("row")] if keep else []), *wanted), "keys", compression="zstd" if keep else "snappy")
    keys = rows.drop("row")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cells = shards * per_shard
    parts = max(1, -(-total // (cells * RANGE_BYTES)))
    mean = max(1.0, total / (cells * parts))
    search = F.expr(_range_of(_splitters(keys, total, cells))).cast("long") * parts + F.pmod("k1", F.lit(parts))
    placed = keys.withColumn("range", search)
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * mean)
    pieces = {r["range"]: int(-(-r["bytes"] // mean)) for r in sums.collect()}  # few: those with a heavy text
    split = F.expr("element_at(map(" + ", ".join(f"{k}L, {v}" for k, v in pieces.items()) + "), range)") if pieces else F.lit(None).cast("int")
    piece = F.coalesce(F.pmod(F.xxhash64("k2", "rid"), split).cast("int"), F.lit(0))
    placed = placed.withColumn("piece", piece)
    # ranges and pieces: a row for each RANGE_BYTES of input, a few thousand at least
    laid = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("range", "piece")
    middle = F.sum("bytes").over(order) - F.col("bytes") / 2
    laid = laid.withColumn("shard", F.least(F.floor(middle / max(total, 1) * shards), F.lit(shards - 1)).cast("int"))
    laid = laid.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "piece")) - F.col("n"))
    table = scratch.cut(laid.select("range", "piece", "shard", "before"), "ranges")
    numbered = rows.withColumn("range", search).withColumn("piece", piece).join(table, ["range", "piece"]).withColumn(
        "slot", F.col("before") + F.row_number().over(Window.partitionBy("range", "piece").orderBy("k1", "k2", "rid")) - 1
    )
    return numbered.select(*(["row"] if keep else []), "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op9_sampled_splitters(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
