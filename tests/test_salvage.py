import json
import random

from pyspark.sql import functions as F

from quern.functions import repair as R
from quern.operators import salvage as S

PIECES = ['{"a":1}', '{"source_id":"S1","v":[1,{"z":"}"}]}', '{"source_id": "S2","v":{"x":', '"items":[', '{"items": [', "]", "}", "{", '"', "\\", "text ", ",", '{"k":"\\"]"}', "[[{}]]", "```json\n", "```", '{"a":1,"a":2}', "null", "ü", '{"source_id":"S1","v":2}']


def texts():
    made = random.Random(9)
    out = ["".join(made.choice(PIECES) for _ in range(made.randrange(1, 9))) for _ in range(250)]
    return [None, "", "{", "}", '{"a":1} x', *out]


def test_same_as_the_decoder(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, t string, items string, partial int")
    got = {r.id: r for r in S.array_objects(df, "t", "items").select("id", "found", S.first_object(F.col("t")).alias("first"), S.marked_objects(F.col("t")).alias("marked")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        first = R.first_object(t)
        assert (json.loads(r.first) if r.first else None) == first, t
        assert {m.id: json.loads(m.object) for m in r.marked or []} == R.by_marker(t), t
        items, partial = R.array_items(t, "items")
        assert ([json.loads(x) for x in r.found["items"]], r.found["partial"]) == (items, partial), t


def test_only_one_value_parses(spark):
    rows = ["{}", " 7 ", '"x"', "null", "[1,2]", "{} x", "{},{}", "1] [2", "1} {", "", "x", '{"a":1}}', "1,2", "]["]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.ok for r in df.select(R.parsed(F.col("t")).isNotNull().alias("ok")).collect()] == [True] * 5 + [False] * 9
