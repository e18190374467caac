import hashlib
import random

import numpy as np
import pyarrow as pa

from quern.functions import sketch as S
from quern.functions.hashes import AT_ONCE, ONE_BLOCK, md5_head
from quern.operators import corpus as C
from quern.operators import sketch_join as J
from quern.sources.scratch import setting


def head(x: bytes) -> int:
    return int.from_bytes(hashlib.md5(x).digest()[:8], "big")


def test_md5_of_every_size():
    made = random.Random(1)
    raw = made.randbytes(3000)
    parts = [(made.randrange(2800), n % (2 * ONE_BLOCK)) for n in range(AT_ONCE + 200)] + [(3000, 0), (2999, 1), (2945, 55)]
    starts, sizes = (np.array(x) for x in zip(*parts, strict=True))
    assert md5_head(raw, starts, sizes).tolist() == [head(raw[a : a + n]) for a, n in parts]
    assert len(md5_head(b"", starts[:0], sizes[:0])) == 0


def test_sketches_against_plain_python(monkeypatch):
    monkeypatch.setattr(J, "SLICE_BYTES", 300)
    monkeypatch.setattr(J, "LANE_WORDS", 50)
    texts = [None, "", "one", "one two", "a b c d e", "a b c d e f a b c d e f", "été " * 90 + "x", "w" * 70 + " v", "p " * 149 + "q", ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "w"])
    got = [r for b in J.sketches(5, 7)(iter([batch])) for r in b.to_pylist()]
    for r, text in zip(got, texts, strict=True):
        w = text.split(" ") if text else []
        hashes = sorted({head(" ".join(w[i : i + 5]).encode()) >> 4 for i in range(max(1, len(w) - 4))})[:7] if w else []
        ones = [sum(head(x.encode()) >> 4 + b & 1 for x in w) for b in range(60)]
        bits = sum(1 << b for b in range(60) if 2 * ones[b] >= len(w)) if w else 0
        assert (r["words"], r["signature"], r["simhash"]) == (len(w), hashes, bits)


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Without repeated ids the sketch step has no exchange at all."""
    plans = []
    cut = C.Scratch.cut
    monkeypatch.setattr(C.Scratch, "cut", lambda self, df, name="cut", **a: (plans.append((name, df._jdf.queryExecution().sparkPlan().toString())), cut(self, df, name, **a))[1])
    rows = [(i, f"some words of text {i}", "t") for i in range(20)]
    assert C.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, title string")).count() == 20
    plan = dict(plans)["fingerprints"]
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    plans.clear()
    again = [*rows, (3, "other words", "t"), (None, "no id", "t"), (None, "no id", "t")]
    assert C.fingerprints(spark.createDataFrame(again, "doc_id long, text string, title string")).count() == 23
    assert "BroadcastHashJoin" in dict(plans)["votes"] and "BroadcastHashJoin" in dict(plans)["fingerprints"]


def test_large_blocks_are_cut_into_cells(spark, monkeypatch):
    """The pairs of one block spread over tasks, and each is listed once."""
    rows = [(i, f"one text and its copies {i % 3 if i % 2 else ''}", f"title {i % 4}") for i in range(40)] + [(50, None, None), (51, "", ""), (52, "", "")]
    prints = C.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, title string")).withColumn("block", S.F.when(S.F.col("words") > 0, S.F.lit(1)))
    columns = ["id_a", "id_b", "classification", "shingle", "sim", "length", "title", "confidence"]
    whole = sorted(tuple(r) for r in C.near_duplicate_pairs(prints).select(columns).collect())
    assert len(whole) == len({r[:2] for r in whole}) == 40 * 39 // 2
    monkeypatch.setattr(C, "CELL_ROWS", 7)
    cut = C.near_duplicate_pairs(prints)
    assert sorted(tuple(r) for r in cut.select(columns).collect()) == whole
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.shuffle.partitions", 8), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "20k"):
        tasks = C.near_duplicate_pairs(prints).groupBy(S.F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < len(whole) // 2
