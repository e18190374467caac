from collections import Counter, defaultdict

import corpus_pipeline as C
from quern.llm import decontaminate, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size int, row string, copies int, kept boolean"


def sentence(seed, n=60):
    words = "the of and to in that is it for was on with as at by from this have or one had not but what all were when we there can".split()
    return " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + ("" if i % 3 else f" term{seed}x{i % 40}") for i in range(n))


def rows():
    item = " ".join(f"bench{i}" for i in range(14))
    made = [(i, sentence(i), "en", ("a", "b", None)[i % 3]) for i in range(40)]
    made += [(100 + i, sentence(i) + " end", "en", "a") for i in range(10)]  # near copies
    made += [(200, sentence(99) + " " + item, "en", "b"), (201, None, "en", "a"), (202, "", None, None), (203, "$$$ ### |||", "en", "a"), (None, sentence(77), "en", "a"), (None, sentence(78), None, "c"), (5, sentence(5), "en", "a"), (5, sentence(55), "en", "a")]
    return [(i, t, lang, s, 1, "own", "own", 2, "own", 3, None) for i, t, lang, s in made], item


def run(spark, folder, data, items):
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    return C.run(spark, str(folder))


def test_a_run_over_odd_rows(spark, tmp_path):
    data, item = rows()
    out = run(spark, tmp_path, data, [("i1", item, 1), ("i2", None, 1), (None, "x", 1)])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "row", "copies", "kept", "shard", "slot", "shard_bytes"]
    got = out.collect()
    docs = spark.createDataFrame(data, SCHEMA)
    good = {r.text for r in quality_rules.keep_good(docs).collect()}
    clean = {r.text for r in decontaminate.drop_contaminated(docs, spark.createDataFrame([("i1", item)], "item_id string, text string")).collect()}
    texts = Counter(r.text for r in got)
    assert got and set(texts) <= good & clean and max(texts.values()) <= 3
    for i in range(10):  # of a text and its near copy at most one stays
        assert not (texts[sentence(i)] and texts[sentence(i) + " end"])
    assert {r.row for r in got} == {"own"} and {r.copies for r in got} == {3} and {r.doc_id for r in got} <= {d[0] for d in data}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard_bytes == len(r.text.encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], []).collect() == []
