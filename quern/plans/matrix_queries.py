"""A matrix of vectors that is built in portions and read back by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.assemble import numbered
from quern.plans.registry import query
from quern.sources import matrix as M
from quern.sources.scratch import Scratch

#: Portions of the build: the first call stops after one step, as a killed run would.
STEPS = 4


@query(
    "matrix_by_position",
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents",
)
def matrix_by_position(t):
    """A build that stops and goes on, and the whole matrix read back."""
    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "matrix")
    rows = scratch.cut(numbered(docs, ["doc_id"], "position", scratch).select("position", F.col("doc_id").alias("key"), "text"), "rows")
    n = rows.count()
    step_rows = max(1, -(-n // STEPS))

    def encode(part):
        blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
        return part.select("position", "key", F.array(F.length("text").cast("double"), blanks.cast("double")).alias("vec"))

    path = scratch.path("vectors")
    M.build_matrix(rows, encode, path, step_rows, most_steps=1)
    M.build_matrix(rows, encode, path, step_rows)
    found = M.read_matrix(spark, path)
    return found.select("position", F.col("key").alias("doc_id"), F.get("vec", F.lit(0)).alias("chars"), F.get("vec", F.lit(1)).alias("blanks"))
