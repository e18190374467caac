"""Salvage of answers that are planted around columns of documents; the SQL states what was planted."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import repair as R
from quern.operators import salvage as S
from quern.plans.registry import query


def _answers(t, forms: list[str]):
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return t("documents").selectExpr("doc_id", f"CASE doc_id % {len(forms)} {cases} END AS answer")


def _planted(values: list[str]) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


FENCED = [
    ("'```json\\n{\"a\":' || doc_id || '}\\n```'", "'{\"a\":' || doc_id || '}'"),
    ("'```\\n' || lang || '\\n```  '", "lang"),
    ("'  {\"a\":' || doc_id || '} '", "'{\"a\":' || doc_id || '}'"),
    ("'```JSON ' || source || ' ```'", "source"),
    ("lang || ' ```' || source", "lang || ' ```' || source"),
]


@query("answers_unfenced", f"SELECT doc_id, {_planted([v for _, v in FENCED])} AS body FROM documents")
def answers_unfenced(t):
    """K01"""
    return _answers(t, [f for f, _ in FENCED]).select("doc_id", R.strip_fences(F.col("answer")).alias("body"))


FIRST = [
    ("'Sure: {\"a\":' || doc_id || ',\"s\":\"br{ace } \\\\\" q\"} and {\"a\":1}'", "doc_id"),
    ("'see {not json} then {\"a\":' || doc_id || '}'", "doc_id"),
    ("'no object, ' || source", "NULL"),
    ("'{\"x\":{\"a\":' || doc_id || '}'", "doc_id"),
    ("'{\"b\":[1,{\"a\":7}],\"a\":' || doc_id || '}'", "doc_id"),
    ("'a } b { c \" {\"a\":' || doc_id || '}'", "doc_id"),
]


@query("answers_first_object", f"SELECT doc_id, {_planted([v for _, v in FIRST])}::BIGINT AS a FROM documents")
def answers_first_object(t):
    """K02"""
    found = _answers(t, [f for f, _ in FIRST]).withColumn("object", S.first_object(F.col("answer")))
    return found.select("doc_id", F.get_json_object("object", "$.a").cast("long").alias("a"))


OUTER = [
    ("source || ' {\"a\":{\"b\":' || doc_id || '}} tail'", "'{\"a\":{\"b\":' || doc_id || '}}'"),
    ("'x {\"a\":1} y {\"b\":' || doc_id || '}'", "NULL"),
    ("'{\"a\":' || doc_id", "NULL"),
    ("lang", "NULL"),
]


@query("answers_outer_object", f"SELECT doc_id, {_planted([v for _, v in OUTER])} AS object FROM documents")
def answers_outer_object(t):
    """K03"""
    return _answers(t, [f for f, _ in OUTER]).select("doc_id", R.outer_object(F.col("answer")).alias("object"))


ARRAYS = [
    ("'{\"items\":[{\"k\":' || doc_id || '},{\"k\":2,\"s\":\"]}\"},{\"k\":'", "doc_id || ',2'", "true"),
    ("'```json\\n{\"items\":[{\"k\":' || doc_id || '},3,{\"k\":5}]}\\n```'", "doc_id || ',5'", "false"),
    ("'text {\"items\": [{\"k\":' || doc_id || '}]} text'", "doc_id::VARCHAR", "false"),
    ("'{\"items\":[{\"k\":1},{\"k\":oops},{\"k\":' || doc_id || '}], \"more\":'", "'1,' || doc_id", "false"),
    ("'{\"other\":[{\"k\":' || doc_id || '}'", "''", "true"),
    ("'{\"items\":[[{\"k\":0}],{\"k\":{\"z\":[1]}},{\"k\":' || doc_id || '}'", "'{\"z\":[1]},' || doc_id", "true"),
]


@query("answers_array", f"SELECT doc_id, {_planted([v for _, v, _ in ARRAYS])} AS ks, {_planted([p for *_, p in ARRAYS])} AS partial FROM documents")
def answers_array(t):
    """K04"""
    found = S.array_objects(_answers(t, [f for f, *_ in ARRAYS]), "answer", "items")
    keys = F.transform("found.items", lambda o: F.get_json_object(o, "$.k"))
    return found.select("doc_id", F.array_join(keys, ",").alias("ks"), F.col("found.partial").alias("partial"))


MARKED = [
    ("'[{\"source_id\":\"S1\",\"v\":' || doc_id || '}, {\"source_id\": \"S2\",\"v\":2},{\"source_id\":\"S1\",\"v\":9}]'", "'S1=' || doc_id || ',S2=2'"),
    ("'x {\"source_id\":\"S3\",\"v\":' || doc_id || '} {\"source_id\":\"S4\",\"v\":'", "'S3=' || doc_id"),
    ("'{\"source_id\":\"S5\",\"v\":bad} {\"source_id\":\"S6\",\"v\":' || doc_id || '}'", "'S6=' || doc_id"),
    ("lang || source", "''"),
]


@query("answers_by_marker", f"SELECT doc_id, {_planted([v for _, v in MARKED])} AS found FROM documents")
def answers_by_marker(t):
    """K05"""
    found = _answers(t, [f for f, _ in MARKED]).withColumn("m", S.marked_objects(F.col("answer")))
    pairs = F.transform("m", lambda m: F.concat_ws("=", m["id"], F.get_json_object(m["object"], "$.v")))
    return found.select("doc_id", F.array_join(pairs, ",").alias("found"))
