"""A matrix of vectors on disk, built in steps that a killed run goes on from.

Rows are numbered from 0 and cut into steps of `step_rows` positions. A step's vectors are written first, then read back and
checked (every position once, all of one width, none null), and only then its line of the manifest is written. A later
run of the same build skips the steps of the manifest and writes the others anew, so what a killed run left half-written never
counts. A matrix is read back by position, whole or in part: a step is a folder, and other folders are not opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "step bigint, least bigint, most bigint, n_rows bigint, width int"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(step, least, most, n_rows, width) of the finished steps; empty where nothing is finished."""
    if not _there(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*")


def build_matrix(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, step_rows: int = 1_000_000, most_steps: int | None = None) -> int:
    """Writes the vectors of (position, key, text) rows below `path`; returns the number of steps done by this call.

    `encode` takes rows and returns (position, key, vec). Positions must run from 0 without gaps or repeats; a step that does not
    meet the checks raises and leaves its manifest line out. Steps run one after another, each over as many tasks as its rows
    need; their number is the rows divided by `step_rows`. `most_steps` stops early, for builds in portions.
    """
    spark = rows.sparkSession
    stepped = rows.withColumn("step", F.floor(F.col("position") / step_rows).cast("long"))
    asked = stepped.groupBy("step").agg(F.min("position").alias("least"), F.max("position").alias("most"), F.count(F.lit(1)).alias("n_rows"))
    waiting = sorted(asked.join(manifest(spark, path).select("step", "n_rows"), ["step", "n_rows"], "left_anti").select("step", "least", "most", "n_rows").collect())
    widths = {r.width for r in manifest(spark, path).select("width").distinct().limit(2).collect()}
    done = 0
    for step, least, most, n in waiting[:most_steps]:
        if (least, most) != (step * step_rows, step * step_rows + n - 1):
            raise ValueError(f"positions of step {step} have gaps or repeat")
        place = f"{path}/data/step={step}"
        encode(stepped.where(F.col("step") == step).drop("step")).select("position", "key", "vec").write.mode("overwrite").parquet(place)
        found = spark.read.parquet(place).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("places"), F.min("position").alias("least"), F.max("position").alias("most"), F.min(F.coalesce(F.size("vec"), F.lit(-1))).alias("low"), F.max(F.coalesce(F.size("vec"), F.lit(-1))).alias("high"),
            F.count_if(F.exists("vec", lambda x: x.isNull() | F.isnan(x))).alias("holes"),
        ).first()
        widths |= {found.low, found.high}
        if (found.n, found.places, found.least, found.most, found.holes) != (n, n, least, most, 0) or len(widths) != 1 or found.low < 0:
            raise ValueError(f"step {step} wrote {found.n} of {n} rows, widths {sorted(widths)}, {found.holes} with holes")
        spark.createDataFrame([(step, least, most, n, found.low)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/step-{step}")
        done += 1
    return done


def read_matrix(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(position, key, vec) of the finished rows from `first` to `last`, that one included; steps outside are not read."""
    steps = manifest(spark, path).where(F.col("most") >= first)
    steps = steps.where(F.col("least") <= last) if last is not None else steps
    places = [f"{path}/data/step={r.step}" for r in steps.select("step").collect()]
    if not places:
        raise ValueError(f"no finished rows from {first} to {last}")
    found = spark.read.parquet(*places).where(F.col("position") >= first)
    return found.where(F.col("position") <= last) if last is not None else found
