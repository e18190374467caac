import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunk as K
from quern.operators import corpus as C
from quern.operators import retrieval as R
from quern.operators.components import connected_components
from quern.sources import readers
from quern.streaming import incremental as I


def _groups(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(parent)}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == _groups(edges)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == _groups(edges[:-1])


@pytest.mark.parametrize("layout", [K.RETRIEVAL, K.RETRIEVAL_V1, K.SCENARIO])
def test_chunk_edges(spark, layout):
    window, overlap, base = layout
    texts = {n: [f"w{i}" for i in range(n)] for n in (0, 19, 20, 180, 181, 220, 221, 319, 320, 321, 590, 591)}
    got = {}
    for r in K.chunk(spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "k int, t string"), "k", "t", layout).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r)
    for n, words in texts.items():
        want, at = [], 0
        while n:
            want.append(" ".join(words[at : at + window]))
            if at + window >= n:
                break
            at += window - overlap
        rows = got.get(n, [])
        assert [r.text for r in rows] == want
        assert [r.chunk_index for r in rows] == list(range(base, base + len(want)))
        assert all(r.chunk_count == len(want) for r in rows)


def test_first_of_equal_texts_stays(spark):
    t = "x" * 120
    df = spark.createDataFrame([(1, t, "b", "en"), (2, t + " ", "a", "en"), (3, "short", "a", "en"), (4, None, "a", "en")], "doc_id long, text string, source string, lang string")
    assert [r.doc_id for r in C.build_corpus(df).collect()] == [2]


def test_unique_and_enforced(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        C.assert_unique(df, "k").count()
    with pytest.raises(Exception, match="no match"):
        C.enforced_join(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, 3)], "k int, v int"), "k").collect()


def test_exclusions_merge(spark):
    a = spark.createDataFrame([(1, "x", "x; y"), (2, "x", "x")], "k int, primary_reason string, all_reasons string")
    b = spark.createDataFrame([(1, "z", "z; x"), (3, "z", "z")], "k int, primary_reason string, all_reasons string")
    assert sorted(map(tuple, C.merge_exclusions(a, b, "k").collect())) == [(1, "x", "x; y; z"), (2, "x", "x"), (3, "z", "z")]


def test_top_k_ties_and_blocks(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)], "row_id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "query_id long, vec array<double>")
    got = {}
    for r in R.top_k(queries, corpus, 2, block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    assert got == {0: [0, 1], 1: [3, 4], 2: [0, 1]}
    assert R.top_k(queries.limit(0), corpus, 2).count() == 0


def test_quota(spark):
    rows = [(i, i, "supreme_court", 1.0 - i / 100) for i in range(10)] + [(20 + i, 20 + i, "other", 0.5 - i / 100) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id int, document int, kind string, s double")
    got = R.quotas(df, "document", "kind", {"supreme_court": 6}, 5, [F.desc("s")], 8).collect()
    assert [r.row_id for r in got] == [0, 1, 2, 3, 4, 5, 20, 21]


def test_match_hints(spark):
    acts = spark.createDataFrame([("limitation act 1963",), ("indian contract act 1872",)], "act_key string")
    hints = spark.createDataFrame([(1, "The Limitation Act, 1963, section 5"), (2, "Indian Contracts Act 1872"), (3, "Indian Contract Act 1950"), (4, "Sale of goods")], "id int, hint string")
    got = {r.id: r.act_key for r in R.match_hints(hints, acts, "id", "hint").collect()}
    assert got[1] == "limitation act 1963" and 3 not in got and 4 not in got


def test_csv_and_jsonl(spark, tmp_path):
    csv = tmp_path / "s.csv"
    csv.write_text("﻿id,tokens,ratio\na,12,1.5\nb,x,\n", encoding="utf-8")
    rows = {r.id: r for r in readers.read_stats_csv(spark, str(csv), "id", {"tokens": "bigint", "ratio": "double"}).collect()}
    assert (rows["a"].tokens, rows["b"].tokens, rows["b"].ratio) == (12, 0, 0.0)
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    good, bad = readers.read_jsonl_lenient(spark, str(lines), "a int")
    assert sorted(r.a for r in good.collect() if r.a is not None) == [1, 2] and bad.first().bad_lines == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl_strict(spark, str(lines), "a int").collect()
    schema, first = readers.inspect(spark, str(csv))
    assert first.count() == 2 and "tokens" in schema
    assert {r.suffix: r.files for r in readers.folder_inventory(spark, str(tmp_path)).collect()} == {"csv": 1, "jsonl": 1}


def test_incremental_takes_new_files_only(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").write.parquet(source)
    keep = lambda df: df.where("text <> 'b'")
    I.incremental(spark, source, "id int, text string", sink, check, keep)
    spark.createDataFrame([(3, "c")], "id int, text string").write.mode("append").parquet(source)
    I.incremental(spark, source, "id int, text string", sink, check, keep)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 3]


def test_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "question"), ("b", "question"), ("b", "answer"), ("c", "done"), ("c", "question")], "user string, kind string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user string, kind string").parquet(source)
    q = I.session_states(stream, "user", "kind").writeStream.format("memory").queryName("sessions").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    # a query with processing-time timeouts goes on with empty batches: wait for the rows, not for its end
    until = time.time() + 60
    while spark.table("sessions").count() < 3 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert {r.session: r.state for r in spark.table("sessions").collect()} == {"a": "waiting_clarification", "b": "running", "c": "completed"}


def test_versioned_table(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for version in (1, 1, 2):
        assert readers.versioned(spark, str(tmp_path / "t"), version, build).count() == 3
    assert len(calls) == 2


def test_copies_cluster_by_one_edge_each(spark):
    from quern.operators import corpus as C

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words), f"t{i}") for i in range(9)] + [(20 + i, " ".join([*words, f"end{i}"]), "t") for i in range(2)] + [(40, "alone in the world of all words", "t"), (41, "", "t"), (42, "", "t"), (43, None, "t")]
    prints = C.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, title string"))
    edges = C.cluster_edges(prints).collect()
    assert sum(e.classification == "exact_duplicate" for e in edges) == 8
    sort = lambda df: sorted(map(tuple, df.collect()))
    assert sort(C.duplicate_clusters(C.cluster_edges(prints))) == sort(C.duplicate_clusters(C.near_duplicate_pairs(prints)))
    assert C.duplicate_clusters(C.cluster_edges(prints.limit(0))).count() == 0


def test_title_pairs_in_blocks_and_lists(spark, monkeypatch):
    from quern.operators import retrieval as R

    monkeypatch.setattr(R, "SET_BLOCK", 2)
    monkeypatch.setattr(R, "KEY_LIST", 3)
    words = [["a"], ["a", "b"], ["a", "b", "c"], ["d"], [""], ["b", "d"]]
    rows = [(k, "p" if k % 3 else None if k % 2 else "q", k % 2, words[k * k % 7 % 6]) for k in range(60)] + [(3, "q", 1, ["d"])]
    got = R.jaccard_pairs(spark.createDataFrame(rows, "k long, g string, h int, w array<string>"), "k", ["g", "h"], "w").collect()
    wanted = [(a, b, len({*w} & {*v}) / len({*w} | {*v})) for a, g, h, w in rows for b, o, p, v in rows if g is not None and (g, h) == (o, p) and a < b]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_nearest_rows_hold_few_products_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quern.operators import retrieval as R

    made = np.random.default_rng(2)
    vectors, queries = made.integers(-3, 4, (10_000, 4)).astype(np.float32), made.integers(-3, 4, (1024, 4)).astype(np.float64)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 40_001, 4, dtype=np.int32)), pa.array(vectors.ravel()))
    batch = pa.record_batch([pa.array(np.arange(10_000)), flat], names=["i", "v"])
    tracemalloc.start()
    got = list(R._nearest(list(range(1024)), queries, 5)(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # all products of a batch take 82 MB
    sims = queries @ vectors.T.astype(np.float64)
    for q in (0, 500, 1023):
        assert got[q].column(1).to_pylist() == np.lexsort((np.arange(10_000), -sims[q]))[:5].tolist()


def test_corpus_build_takes_one_row_of_a_text_and_cleans_it_once(spark):
    text = lambda c: c * 60 + "  " + c * 60
    rows = [(1, "a", "en", text("x")), (1, "b", "en", text("y")), (0, "b", "de", text("y") + " \n"), (0, "b", "de", text("y")), (None, "a", "en", text("z")), (7, None, "en", text("z")), (None, None, None, text("w")), (3, "a", "en", "short"), (4, "a", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    kept = sorted((str(r.doc_id), str(r.source), r.text[0]) for r in C.build_corpus(df).collect())
    assert kept == [("0", "b", "y"), ("1", "a", "x"), ("None", "None", "w"), ("None", "a", "z")]
    sizes = C.built_sizes(df)
    assert sorted((str(r.doc_id), str(r.source), str(r.lang), r.characters) for r in sizes.collect()) == [("0", "b", "de", 121), ("1", "a", "en", 121), ("None", "None", "None", 121), ("None", "a", "en", 121)]
    assert sizes._jdf.queryExecution().optimizedPlan().toString().count("{4,}") == 1
    assert C.build_corpus(df.limit(0)).collect() == []


def test_strip_takes_white_space_alone(spark):
    around = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"{c}a{c}b{c} \n") for c in around], "c string, s string")
    got = df.select("c", T.strip("s").alias("t"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("r")).collect()
    assert all(r.t == r.r for r in got) and sum(r.t == f"a{r.c}b" for r in got) == len(T.WHITE) == 25


def test_blanks_before_line_ends(spark):
    import re

    made = random.Random(2)
    texts = ["".join(made.choice(" \t\nx \r") for _ in range(60)) for _ in range(300)] + ["x" + " " * 100_000 + "y"]
    plain = lambda t: re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", t.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ")))).strip()
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.clean_corpus_text("s").alias("t")).collect()
    assert all(r.t == plain(r.s) for r in got)
