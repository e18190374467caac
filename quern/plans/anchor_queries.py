"""Clauses and ordered coverage of conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import anchors as A
from quern.plans.registry import query

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split({}, ' '), lambda w: w <> '')"


@query(
    "turn_clauses",
    f"""WITH f AS (SELECT conv_id, turn, {FLAT} AS flat FROM conversations), p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(flat, '([.?!;:])\\s+', '\\1' || chr(1), 'g'), '\\s+[–—]\\s+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len({TOKENS.format(NORM.format('x'))}) >= 3) AS parts,
        CASE WHEN flat <> '' AND len({TOKENS.format(NORM.format('flat'))}) <= 80 THEN [flat] ELSE [] END AS whole FROM f),
      every AS (SELECT conv_id, turn, list_concat(parts, whole) AS c FROM p)
    SELECT conv_id, turn, md5(array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|')) AS clauses_md5, len(list_filter(c, lambda x, i: list_position(c, x) = i)) AS n FROM every""",
)
def turn_clauses(t):
    """X17"""
    found = t("conversations").select("conv_id", "turn", A.clauses("text").alias("c"))
    return found.select("conv_id", "turn", F.md5(F.array_join("c", "|")).alias("clauses_md5"), F.size("c").cast("long").alias("n"))


@query(
    "turn_coverage",
    f"""WITH w AS (SELECT conv_id, turn, {TOKENS.format(NORM.format("coalesce(text, '')"))} AS have FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(have) = 0 THEN 0.0::DOUBLE ELSE round(least(len(have), turn % 7 + 2)::DOUBLE / (len(have) + 1), 6) END AS cut_off, CASE WHEN len(have) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS every_other FROM w""",
)
def turn_coverage(t):
    """Of a turn's own tokens with one put in that it lacks, those before it are covered; every second token is covered in full."""
    have = t("conversations").select("conv_id", "turn", A.tokens("text").alias("have"))
    keep = (F.col("turn") % 7 + 2).cast("int")
    put = F.concat(F.slice("have", F.lit(1), keep), F.array(F.lit("no such token")), F.slice("have", keep + 1, F.greatest(F.size("have"), F.lit(1))))
    some = F.filter("have", lambda w, i: i % 2 == 0)
    return have.select("conv_id", "turn", F.round(A.ordered_coverage(put, F.col("have")), 6).alias("cut_off"), A.ordered_coverage(some, F.col("have")).alias("every_other"))
