"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Rates r of the documents minimise sum(r log r - r) subject to sum(r * size) = target for every source and
0 <= r <= 3. The dual is convex, with one unknown per source: r = min(3, exp(lambda * size / scale)).
Newton steps on the dual run as aggregates per source, all sources at once, kept inside a bracket. Only
(source, size) decides a rate, so the documents are first summed into that histogram, which holds each
step's whole input at a fraction of its size.

Rates become copies on the histogram: cumulative rounding along the sizes, then greedy passes that spend
what a source is short of, or over, on its largest size that fits, until no move comes nearer. Inside a cell of equal sizes the
documents with the lowest hash of their id get the odd copy, up to a cut; rows of equal hash are told apart by the
number they get when they are first written. Counts by bucket, hash and part of the table find the cut, so no cell
is sorted as one, and texts are shuffled once, by cell, to meet their decision. Steps that do not converge raise.

Words are runs of anything but ASCII white space. Sources are ordered by code point, null last, and weigh
5, 2, 1, repeating.

Defined results: a null or empty text has size 0 and takes 0. A source without words has target 0. Repeated
rows are documents of their own. An empty table gives an empty result. Extra columns are not read, or pass
through `mixed_documents` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton steps and rounding passes that are enough by far; more raise an error.
STEPS = 60
ROUNDING_PASSES = 60
#: A source counts as met when it is off by less than this share of its target.
NEAR = 1e-9
#: Documents in one ranking bucket.
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, capped at MOST times the source, the excess reshared by weight.

    Sources are few next to documents, one row each; with price p = words per unit of weight, a source takes
    min(3 * size, p * weight). Sorted by the price at which each is capped, p follows from running sums.
    """
    # nulls last, code points in binary order
    place = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    base = sizes.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    base = base.withColumn("price", F.col("cap") / F.col("weight"))
    every = Window.orderBy("price", F.col("source").isNull(), "source")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    summed = base.withColumns(
        {
            "total": F.sum("source_size").over(whole),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # the price if all that come before are capped; the first source for which it stays below its own cap sets it
    fair = summed.withColumn("fair", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("fair") <= F.col("price"), F.struct("price", "fair"))).over(whole)["fair"]
    return fair.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def balance(hist: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, target, scale, lam): the dual's solution per source; hist has (source, size, n) with size > 0."""
    stats = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least"), F.sum(F.col("size") * F.col("n")).alias("all_words"))
    state = stats.join(targets.withColumnRenamed("source", "s"), _same("source", "s")).select(
        "source",
        "target",
        "scale",
        "all_words",
        F.lit(0.0).alias("lam"),
        F.lit(-1e6).alias("low"),
        # at this value even the shortest document has reached the cap
        (F.log(F.lit(float(MOST))) * F.col("scale") / F.col("least")).alias("high"),
    )
    state = scratch.cut(state, "dual")
    for _ in range(STEPS):
        joined = hist.join(state.withColumnRenamed("source", "s"), _same("source", "s"))
        power = F.col("lam") * F.col("size") / F.col("scale")
        free = power < F.log(F.lit(float(MOST)))
        rate = F.when(free, F.exp(power)).otherwise(F.lit(float(MOST)))
        got = joined.groupBy("source", "target", "scale", "all_words", "lam", "low", "high").agg(
            F.sum(rate * F.col("size") * F.col("n")).alias("got"),
            F.sum(F.when(free, rate * F.col("size") * F.col("size") * F.col("n") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        met = (F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(0.01), NEAR * F.col("target"))) | (F.col("target") >= MOST * F.col("all_words"))
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
        # a step out of the bracket, or from a flat place, gives way to a bisection that doubles outwards while the bracket is open below
        middle = F.when(low <= -1e6, F.least(F.lit(-1.0), 2 * F.col("lam"))).otherwise((low + high) / 2)
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        capped = F.col("target") >= MOST * F.col("all_words")
        nxt = got.select(
            "source", "target", "scale", "all_words", F.when(capped, F.col("high")).when(met, F.col("lam")).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), met.alias("met")
        )
        nxt = scratch.cut(nxt, "dual")
        scratch.drop(state)
        open_ = nxt.where("not met").limit(1).count()
        state = nxt.drop("met")
        state._scratch_path = nxt._scratch_path  # noqa: SLF001
        if not open_:
            return state
    raise RuntimeError(f"rates did not converge in {STEPS} steps")


def round_copies(hist: DataFrame, dual: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, size, n, copies): whole copies of each cell's documents together, between 0 and MOST * n."""
    rate = F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(5.0), F.col("lam") * F.col("size") / F.col("scale"))))
    cells = hist.join(dual.withColumnRenamed("source", "s"), _same("source", "s")).select("source", "size", "n", "target", (rate * F.col("n")).alias("wish"))
    along = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("wish").over(along)
    cells = cells.select("source", "size", "n", "target", (F.floor(upto + 0.5) - F.floor(upto - F.col("wish") + 0.5)).alias("copies"))
    limit = MOST * F.col("n")
    cells = scratch.cut(cells.withColumn("copies", F.least(limit, F.greatest(F.lit(0), F.col("copies"))).cast("long")), "copies")
    for _ in range(ROUNDING_PASSES):
        short = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        short = scratch.cut(short.withColumnRenamed("source", "s"), "short")
        room = F.when(F.col("short") > 0, limit - F.col("copies")).otherwise(F.col("copies"))
        could = (
            cells.join(short, _same("source", "s"))
            .where((room > 0) & (F.col("size") <= F.abs("short") * 2))
            # the move that leaves the least, of such the one on the largest size
            .select("source", "size", "short", F.least(room, F.greatest(F.lit(1), F.floor(F.abs("short") / F.col("size")))).alias("moves"))
            .withColumn("left", F.abs(F.abs("short") - F.col("moves") * F.col("size")))
            .where(F.col("left") < F.abs("short"))
        )
        best = could.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("left", (-F.col("size")).alias("neg"), (F.signum("short") * F.col("moves")).cast("long").alias("change"))).alias("b"))
        best = scratch.cut(best.select("s", (-F.col("b.neg")).alias("at"), F.col("b.change").alias("change")), "moves")
        if not best.limit(1).count():
            return cells.select("source", "size", "n", "copies")
        moved = cells.join(best, _same("source", "s") & (F.col("size") == F.col("at")), "left").select(
            "source", "size", "n", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")
        )
        moved = scratch.cut(moved, "copies")
        scratch.drop(cells)
        cells = moved
    raise RuntimeError(f"copies did not settle in {ROUNDING_PASSES} passes")


def copy_table(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per (source, size) of a (doc_id, source, size, rid) table: source_size, target, each, cut_bucket, cut_h, cut_rid and buckets.

    A document takes `each` copies, and one more if its (bucket, hash, rid) lies at or below the cell's cut.
    """
    hist = scratch.cut(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = scratch.cut(source_targets(per_source), "targets")
    some = hist.where("size > 0")
    copies = round_copies(some, balance(some, targets, scratch), scratch)
    rows = hist.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, rows // BUCKET_ROWS)
    cells = hist.select(F.col("source").alias("s0"), F.col("size").alias("z0"), F.col("n").alias("n0"))
    cells = cells.join(copies.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "copies"), _same("s0", "s1") & (F.col("z0") == F.col("z1")), "left")
    cells = cells.join(targets.select(F.col("source").alias("s2"), "source_size", "target"), _same("s0", "s2"))
    each = F.floor(F.coalesce("copies", F.lit(0)) / F.col("n0"))
    cells = cells.select("s0", "z0", "source_size", "target", each.alias("each"), (F.coalesce("copies", F.lit(0)) - each * F.col("n0")).alias("extra"))
    cells = scratch.cut(cells, "cells")
    # where the odd copies of a cell end: the bucket, the hash in it, the part of the table and the row in that
    odd = cells.where("extra > 0").select("s0", "z0", F.col("extra").alias("need"))
    at = sizes.select("source", "size", "rid", _hash("doc_id").alias("h")).withColumns({"bucket": F.pmod("h", F.lit(buckets)), "part": F.shiftright("rid", 33)})
    cuts = odd
    for level in ("bucket", "h", "part"):
        inside = at.join(cuts, _same("source", "s0") & (F.col("size") == F.col("z0")) & _within(level))
        counts = inside.groupBy("s0", "z0", *_KEPT[level], "need", level).agg(F.count(F.lit(1)).alias("here"))
        upto = F.sum("here").over(Window.partitionBy("s0", "z0").orderBy(level))
        last = counts.withColumn("upto", upto).where("upto >= need and upto - here < need")
        last = last.select("s0", "z0", *_KEPT[level], F.col(level).alias(f"cut_{level}"), (F.col("need") - F.col("upto") + F.col("here")).alias("need"))
        cuts = scratch.cut(last, f"cut-{level}")
    inside = at.join(cuts, _same("source", "s0") & (F.col("size") == F.col("z0")) & _within("rid"))
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("s0", "z0").orderBy("rid")))
    cuts = ranked.where("rank = need").select(F.col("s0").alias("s3"), F.col("z0").alias("z3"), "cut_bucket", "cut_h", F.col("rid").alias("cut_rid"))
    found = cells.join(cuts, _same("s0", "s3") & (F.col("z0") == F.col("z3")), "left")
    return scratch.cut(found.select("s0", "z0", "source_size", "target", "each", "cut_bucket", "cut_h", "cut_rid", F.lit(buckets).alias("buckets")), "table")


#: Of the levels that lead to a cut, those above each.
_KEPT = {"bucket": [], "h": ["cut_bucket"], "part": ["cut_bucket", "cut_h"], "rid": ["cut_bucket", "cut_h", "cut_part"]}


def _within(level: str) -> Column:
    """Rows that the levels above have not told apart from the cut."""
    found = F.lit(True)
    for name in _KEPT[level]:
        found = found & (F.col(name[len("cut_") :]) == F.col(name))
    return found


def _hash(column: str) -> Column:
    return F.xxhash64(column, F.lit(3))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies), one row per document; `keep` adds the document's own row as a struct named `row`."""
    scratch = Scratch(docs.sparkSession, "mix")
    wanted = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("rid")]
    rows = scratch.cut(docs.select(*([F.struct("*").alias("row")] if keep else []), *wanted), "rows", compression="zstd" if keep else "snappy")
    table = copy_table(rows.select("doc_id", "source", "size", "rid"), scratch)
    full = rows.withColumn("h", _hash("doc_id")).join(table, _same("source", "s0") & (F.col("size") == F.col("z0")))
    bucket = F.pmod("h", "buckets")
    tied = (F.col("h") == F.col("cut_h")) & (F.col("rid") <= F.col("cut_rid"))
    more = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & ((F.col("h") < F.col("cut_h")) | tied))
    copies = F.col("each") + F.when(more, 1).otherwise(0)
    return full.select(*(["row"] if keep else []), "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def op3_entropy_balance(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they came with."""
    repeated = mix(docs, keep=True).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("row.*")
