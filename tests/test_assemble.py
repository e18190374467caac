"""Merged scenarios, alignment, heading spans, statute rules and structured answers on hand-made rows."""

import pytest
from pyspark.errors import PySparkException

from quern.operators import assemble as A


def test_scenarios_merge_whatever_their_case(spark):
    rows = [
        (3, "Rent  due", ["act b", "Act A"]), (1, " rent due ", ["Act A", "act a", " Code"]), (2, "theft", ["Act C"]), (4, "", ["Act A"]), (5, "none", []),
        (6, None, ["x"]), (7, "null list", None), (8, "blank", [" ", None]), (2, "theft", ["Act C"]),
    ]
    df = spark.createDataFrame(rows, "o long, t string, s array<string>").repartition(3)
    got = [tuple(r) for r in A.merged_scenarios(df, "o", "t", "s").orderBy("scenario_id").collect()]
    assert got == [("scenario_000000", "rent due", ["Act A", "Code", "act b"], 2), ("scenario_000001", "theft", ["Act C"], 2)]
    assert A.merged_scenarios(df.limit(0), "o", "t", "s").count() == 0


def test_alignment_checks_counts_and_dimensions(spark):
    records = spark.createDataFrame([(i * 10,) for i in range(50)], "r long").repartition(4)
    vectors = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(50)], "v long, e array<double>").repartition(3)
    got = sorted((x.place, x.r, x.v) for x in A.aligned(records, "r", vectors, "v", "e", 2).collect())
    assert got == [(i, i * 10, i) for i in range(50)]
    with pytest.raises(ValueError, match="50 records but 49 vectors"):
        A.aligned(records, "r", vectors.where("v > 0"), "v", "e")
    with pytest.raises(ValueError, match="1 vectors have not 2"):
        A.aligned(records, "r", vectors.where("v > 0").union(spark.createDataFrame([(0, None)], "v long, e array<double>")), "v", "e", 2)


def test_headings_stand_once_and_in_order(spark):
    good = "x 1. Right\n1. Right to\n  life é😀\n 12[2. [Free speech\nend"
    rows = [(1, good), (2, "2. Free speech\n1. Right to life"), (3, "1. Right to life\n1. Right to life\n2. Free speech"), (4, None), (5, "")]
    got = sorted(map(tuple, A.heading_spans(spark.createDataFrame(rows, "k long, t string"), "k", "t", [("1", "Right to life"), ("2", "Free speech")]).collect()), key=str)
    first, second = good.index("1. Right to"), good.index(" 12[2.")
    assert got == [(1, "1", first, second, None), (1, "2", second, len(good), None), (2, None, None, None, "order"), (3, None, None, None, "1: found 2"), (4, None, None, None, "1: found 0"), (5, None, None, None, "1: found 0")]


def test_rules_come_from_verified_sources_first(spark):
    schema = "s string, o long, verified boolean, source_type string, legal_score int, title string, source_id string, propositions array<struct<proposition:string,scope_limit:string>>"
    rows = [
        ("a", 1, False, "supreme_court", 3, "T1", "S1", [("Research only", None)]), ("a", 2, True, "supreme_court", 0, "T2", "S2", [("Rule  one", " x "), ("", None), ("RULE one!", None)]),
        ("a", 3, True, "act", 3, "T3", "S3", [("An act", None)]), ("b", 1, False, "supreme_court", 1, "T4", "S4", [("p%d" % i, None) for i in range(8)]),
        ("b", 2, False, "supreme_court", 0, "T5", "S5", [("low", None)]), ("c", 1, True, "supreme_court", None, "T6", "S6", None),
    ]
    got = sorted((r.s, r.rule_id, r.proposition, r.scope_limit, r.source_id, r.verified) for r in A.completion_rules(spark.createDataFrame(rows, schema), "s", "o").collect())
    assert got == [("a", "R1", "Rule one", "x", "S2", True)] + [("b", f"R{i + 1}", f"p{i}", "", "S4", False) for i in range(6)]


def test_preliminary_sources_need_score_and_text(spark):
    rows = [("a", 1, "0", "t"), ("a", 2, "x", "t"), ("a", 3, "2", "  "), ("a", 4, None, "t")] + [("a", i, "1", "t") for i in range(5, 11)]
    got = A.preliminary_sources(spark.createDataFrame(rows, "s string, o long, legal_score string, t string"), "s", "o", "t").collect()
    assert sorted((r.o, r.place) for r in got) == [(5, 1), (6, 2), (7, 3), (8, 4)]


def test_answers_are_repaired_once(spark):
    rows = [(1, '{"a": 1, "b": ["x"]}'), (2, '{"a": 1, "b": ["x"]'), (3, '{"a": 1}'), (4, "[1]"), (5, None), (8, "{\"a\": 1}, 2"), (6, '{"a": 1, "b": "x"}'), (7, '{"a": null, "b": []}')]
    df = spark.createDataFrame(rows, "k int, answer string")
    mend = lambda bad: bad.selectExpr("k", "concat(answer, '}') AS answer")
    got = {r.k: (r.repaired, r.problem) for r in A.required_answers(df, "answer", {"a": "", "b": "ARRAY"}, mend).collect()}
    assert got[1] == got[7] == (False, None) and got[2] == (True, None)
    assert {k: got[k] for k in (3, 4, 5, 6, 8)} == dict.fromkeys((3, 4, 5, 6, 8), (True, "no JSON"))
    kept = {r.k: r.problem for r in A.required_answers(df, "answer", {"a": "", "b": "ARRAY"}, lambda bad: bad).collect()}
    assert kept == {1: None, 2: "no JSON", 3: "missing: b", 4: "no object", 5: "no JSON", 6: "type: b", 7: None, 8: "no JSON"}
    with pytest.raises(PySparkException, match="failed twice"):
        A.required_answers(df, "answer", {"a": ""}, lambda bad: bad, strict=True).collect()
