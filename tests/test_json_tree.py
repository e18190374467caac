import json
import random

from quern.functions import text as T  # noqa: F401
from quern.operators import json_tree as J


def walk(node, path=()):
    yield path, node
    items = node.items() if isinstance(node, dict) else ((str(i), v) for i, v in enumerate(node)) if isinstance(node, list) else ()
    for k, v in items:
        yield from walk(v, (*path, k))


def grown(made, depth):
    if depth == 0 or made.random() < 0.3:
        return made.choice(["text", "", " a/b~ ", 7, -2.5, 1e300, True, None, [], {}])
    if made.random() < 0.5:
        return [grown(made, depth - 1) for _ in range(made.randrange(4))]
    keys = ["Sections", "sections", "heading", "paragraphs", "a/b", "~", "", "0", "Ünï", "k"]
    return {k: grown(made, depth - 1) for k in made.sample(keys, made.randrange(5))}


KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def test_nodes_of_random_trees(spark):
    made = random.Random(5)
    trees = {i: grown(made, 7) for i in range(60)}
    df = spark.createDataFrame([(i, json.dumps(t), "x", "y") for i, t in trees.items()], "k long, j string, pointer string, kind string")
    got = sorted((r.k, tuple(r.path), r.kind, r.parent_kind) for r in J.tree_nodes(df, "k", "j").collect())
    wanted = []
    for i, t in trees.items():
        kinds = {p: KINDS.get(type(v), "number") for p, v in walk(t)}
        wanted += [(i, p, k, kinds[p[:-1]] if p else None) for p, k in kinds.items()]
    assert got == sorted(wanted, key=lambda x: (x[0], x[1]))


def test_odd_texts(spark):
    deep = "[" * 25 + "]" * 25
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"a":1,"a":2}'), (8, "{} x"), (9, "1] [2"), (10, "1} {"), (11, "1,2"), (5, " 7 "), (6, deep), (None, "{}"), (7, "[1]"), (7, "[1]")]
    df = spark.createDataFrame(rows, "k long, j string")
    got = [(r.k, r.pointer, r.kind) for r in J.tree_nodes(df, "k", "j").collect()]
    assert {k for k, _, kind in got if kind == "bad_json"} == {2, 3, 4, 8, 9, 10, 11}
    assert 1 not in {k for k, *_ in got} and (5, "", "number") in got and (None, "", "object") in got
    assert sum(k == 6 for k, *_ in got) == 25 and got.count((7, "/0", "number")) == 2
    assert J.tree_nodes(df.limit(0), "k", "j").collect() == []


def test_totals_and_sources(spark):
    act = {"Sections": {"1": {"heading": "H", "paragraphs": {"0": "P", "1": [" Q "]}}, "2": "loose"}, "Parts": [{"SECTIONS": {"3": {"paragraphs": []}}}, {"sections": 5}]}
    df = spark.createDataFrame([(1, json.dumps(act)), (2, "{}"), (3, "broken")], "k long, j string")
    nodes = J.tree_nodes(df, "k", "j")
    got = {r.k: tuple(r)[1:] for r in J.hierarchy_totals(nodes, "k").collect()}
    assert got == {1: (2, 2, 1, 2, 1, False, False), 2: (0, 0, 0, 0, 0, False, True), 3: (0, 0, 0, 0, 0, True, True)}
    records = spark.createDataFrame([(1, "/Sections/1", "H P Q"), (1, "/Sections/2", "x"), (1, "/Sections/9", "x"), (3, "", "x"), (1, None, "x"), (2, "", None)], "k long, p string, t string")
    checks = {(r.k, r.p): tuple(r)[2:] for r in J.source_checks(records, nodes, "k", "p", "t").collect()}
    assert checks == {(1, "/Sections/1"): (True, 3, 3), (1, "/Sections/2"): (True, 0, 0), (1, "/Sections/9"): (False, 0, 0), (3, ""): (False, 0, 0), (1, None): (False, 0, 0), (2, ""): (True, 0, 0)}
