import pytest
from pyspark.sql import functions as F

from quern.sources import matrix as M


def rows(spark, n=100):
    return spark.range(n).select(F.col("id").alias("position"), (F.col("id") * 3).alias("key"), F.col("id").cast("string").alias("text"))


def vectors(part):
    return part.select("position", "key", F.array(F.col("position").cast("float"), F.lit(1.0).cast("float")).alias("vec"))


def test_a_killed_build_goes_on(spark, tmp_path):
    path, asked = str(tmp_path / "m"), []

    def failing(part):
        asked.append(part.agg(F.min("position")).first()[0])
        if len(asked) == 3:
            return vectors(part).select("position", "key", F.when(F.col("position") == 55, F.raise_error(F.lit("killed")).cast("array<float>")).otherwise(F.col("vec")).alias("vec"))
        return vectors(part)

    with pytest.raises(Exception, match="killed"):
        M.build_matrix(rows(spark), failing, path, 20)
    assert M.manifest(spark, path).count() == 2 and M.read_matrix(spark, path).count() == 40
    assert M.build_matrix(rows(spark), failing, path, 20) == 3
    assert asked == [0, 20, 40, 40, 60, 80]
    assert M.build_matrix(rows(spark), failing, path, 20) == 0
    got = M.read_matrix(spark, path, 38, 41).orderBy("position").collect()
    assert [(r.position, r.key, list(r.vec)) for r in got] == [(i, 3 * i, [float(i), 1.0]) for i in range(38, 42)]
    assert M.read_matrix(spark, path).count() == 100
    # more rows: the last step is not whole any more only if it grew
    assert M.build_matrix(rows(spark, 130), vectors, path, 20) == 2
    assert M.read_matrix(spark, path).count() == 130


def test_checks(spark, tmp_path):
    one = rows(spark, 10)
    wrong = {
        "widths": lambda p: vectors(p).withColumn("vec", F.slice("vec", 1, (F.col("position") % 2 + 1).cast("int"))),
        "9 of 10": lambda p: vectors(p.where("position <> 4")),
        "holes": lambda p: vectors(p).withColumn("vec", F.array(F.lit(None).cast("float"), F.lit(1.0).cast("float"))),
        "widths ": lambda p: vectors(p).withColumn("vec", F.lit(None).cast("array<float>")),
    }
    for i, (said, encode) in enumerate(wrong.items()):
        with pytest.raises(ValueError, match=said.strip()):
            M.build_matrix(one, encode, str(tmp_path / f"w{i}"), 10)
        assert M.manifest(spark, str(tmp_path / f"w{i}")).count() == 0
    with pytest.raises(ValueError, match="gaps"):
        M.build_matrix(one.where("position <> 4"), vectors, str(tmp_path / "gap"), 10)
    assert M.build_matrix(one.limit(0), vectors, str(tmp_path / "none"), 10) == 0
    with pytest.raises(ValueError, match="no finished rows"):
        M.read_matrix(spark, str(tmp_path / "none"))
