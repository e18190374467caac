"""Anchors of quotes in their sources: clauses, ordered coverage and the best clause as columns. Only the sequence ratio runs in Python, on the clauses of rows that need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import verify as V
from quern.sources.scratch import Scratch

# Tokens of a clause at least, tokens up to which a whole text counts as a clause, tokens of an anchor at least.
CLAUSE_TOKENS, WHOLE_TOKENS, ANCHOR_TOKENS = 3, 80, 3


def tokens(x) -> Column:
    """Lower-case runs of ASCII letters and digits; none for a null."""
    return F.filter(F.split(T.match_text(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(""))), " "), lambda w: w != "")


def clauses(x) -> Column:
    """The clauses of a text in order, each once: cut behind .?!;: and at dashes between blanks, of CLAUSE_TOKENS tokens at least; a text of up to WHOLE_TOKENS tokens is one as well."""
    flat = T.collapse(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit("")))
    parts = F.filter(F.transform(F.split(flat, r"(?<=[.?!;:])\s+|\s+[–—]\s+", -1), lambda p: T.strip(p)), lambda p: F.size(tokens(p)) >= CLAUSE_TOKENS)
    whole = F.when((flat != "") & (F.size(tokens(flat)) <= WHOLE_TOKENS), F.array(flat)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parts, whole))


def ordered_coverage(needle: Column, hay: Column) -> Column:
    """The share of the needle's tokens that the hay holds in their order, each the first behind the last, up to the first that is not there; 0 where one is empty."""
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("n"), F.lit(True).alias("on"))

    def step(a: Column, token: Column) -> Column:
        place = F.array_position(F.slice(hay, a["at"] + 1, F.size(hay)), token).cast("int")
        hit = a["on"] & (place > 0)
        return F.when(hit, F.struct((a["at"] + place).alias("at"), (a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["at"].alias("at"), a["n"].alias("n"), F.lit(False).alias("on")))

    return F.when((F.size(needle) > 0) & (F.size(hay) > 0), F.aggregate(needle, start, step, lambda a: a["n"]) / F.size(needle)).otherwise(F.lit(0.0))


def _share(some: Column, have: Column) -> Column:
    """The share of an array of different tokens that another holds; 0 for none."""
    return F.when(F.size(some) > 0, F.size(F.array_intersect(some, have)) / F.size(some)).otherwise(F.lit(0.0))


def _sequence(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda p, q: SequenceMatcher(None, p, q).ratio()).astype("float64")

    return ratio(a, b)


def resolve_anchors(rows: DataFrame, source: str, anchor: str, proposition: str, out: str = "resolved") -> DataFrame:
    """Adds the anchor where the source holds it, else the source's closest clause if it is close enough, else ''.

    Nulls count as empty; an empty source resolves to ''. Of equally close clauses the first wins. Repeated rows are resolved each.
    """
    scratch = Scratch(rows.sparkSession, "anchors")
    flat = lambda c: T.collapse(F.coalesce(F.col(c), F.lit("")))
    own = scratch.cut(rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"), flat(source).alias("s"), flat(anchor).alias("a"), flat(proposition).alias("p")), "rows")
    wanted = F.when(T.match_text("a") != "", T.match_text("a")).otherwise(T.match_text("p"))
    held = (F.col("s") != "") & (T.match_text("a") != "") & F.contains(T.match_text("s"), T.match_text("a"))
    asked = own.where((F.col("s") != "") & ~held).select("rid", wanted.alias("wanted"), F.array_distinct(tokens("p")).alias("extra"), "s")
    asked = asked.where(F.size(tokens("wanted")) >= ANCHOR_TOKENS)
    each = asked.select("rid", "wanted", "extra", F.posexplode(clauses("s")).alias("at", "clause"))
    have, need = tokens("clause"), tokens("wanted")
    covered = F.greatest(ordered_coverage(need, have), _share(F.array_distinct(need), have))
    scored = each.select("rid", "at", "clause", covered.alias("covered"), _share(F.col("extra"), have).alias("support"), _sequence(F.col("wanted"), T.match_text("clause")).alias("sequence"))
    total = V.SEQUENCE_WEIGHT * F.col("sequence") + V.COVERAGE_WEIGHT * F.col("covered") + V.SUPPORT_WEIGHT * F.col("support")
    best = scored.groupBy("rid").agg(F.max(F.struct(total.alias("total"), (-F.col("at")).alias("first"), "clause", "covered", "sequence")).alias("b"))
    near = (F.col("b.total") > 0) & ((F.col("b.sequence") >= V.SEQUENCE) | ((F.col("b.covered") >= V.COVERAGE) & (F.col("b.sequence") >= V.LEAST_SEQUENCE)))
    joined = own.join(best.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    return joined.select("row.*", F.when(held, F.col("a")).when(F.coalesce(near, F.lit(False)), F.col("b.clause")).otherwise("").alias(out))
