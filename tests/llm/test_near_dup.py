import random
import re

import numpy as np
import pyarrow as pa

from quern.llm import near_dup as N

SCHEMA = "doc_id long, text string, kept string, n_shingles int"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    found = {}
    own = [(i, sets(t)) for i, t in rows]
    for i, _ in own:
        found[i] = i

    def root(a):
        while found[a] != a:
            a = found[a]
        return a

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                found[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in own}


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 8, 40, 200)))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "  \n ", "one", "ONE", "one two", "One\tTwo", "two one", "x " * 3000, "x " * 3000 + "y"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    for i, (n, component) in brute(rows).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i), i
    left = N.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_hot_group_with_members_outside_the_centre(spark, monkeypatch):
    """A chain in which no member is similar to all others, in small tasks, ranges and blocks."""
    monkeypatch.setattr(N, "TASK_CLASSES", 7)
    monkeypatch.setattr(N, "BLOCK_BYTES", 3000)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows, now = [], list(base)
    for i in range(60):
        now = list(now)
        now[rng.randrange(len(now))] = f"new{i}"
        rows.append((i, " ".join(now)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_empty_repeated_and_null_ids(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B C"), (3, None), (3, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("3", "3", True), ("None", "1", False)]


def components(spark, rows, kind="long"):
    return {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()}


def test_a_middle_text_links_two_that_are_not_similar(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words[55:])), (2, " ".join(words)), (3, " ".join(words[:-55]))]
    assert {c for c, _ in components(spark, rows).values()} == {1}
    rng = random.Random(11)
    rows = []
    for k in range(60):
        own = [f"t{k}x{i}" for i in range(rng.randrange(60, 400))]
        a, b = (rng.randrange(0, len(own) // 4) for _ in "ab")
        rows += [" ".join(own), " ".join(own[a:]), " ".join(own[: len(own) - b])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_null_ids_link_others_and_strings_are_ids(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words[55:])), (None, " ".join(words)), (3, " ".join(words[:-55]))]
    assert {c for c, _ in components(spark, rows).values()} == {1}
    rows = [("b", " ".join(words[55:])), ("a", " ".join(words)), (None, "x"), (None, "X"), ("c", "y y")]
    assert components(spark, rows, "string") == {("b", 244): ("a", False), ("a", 299): ("a", True), (None, 1): (None, True), ("c", 1): ("c", True)}


def test_rows_are_dropped_and_not_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    kept = lambda rows: sorted(map(tuple, N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, th int")).collect()), key=str)
    assert kept([(5, one, 1), (3, two, 2), (5, two, 3)]) == [(3, two, 2), (5, one, 1)]
    assert kept([(5, one, 1), (5, one, 1), (5, one.upper(), 1), (None, one, 1), (None, "", 2), (None, "", 2)]) in ([(5, one, 1), (None, "", 2), (None, "", 2)], [(5, one.upper(), 1), (None, "", 2), (None, "", 2)])
    # of groups without any id one row stays too
    assert len(kept([(None, one, 1), (None, one + " end", 2), (None, one, 1)])) == 1


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, N.POSITIONS).astype("<u2")
        b = a.copy()
        at = rng.choice(N.POSITIONS, N.DISTANCE, replace=False)
        b[at] += 1
        keys = N.index_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_sets_of_a_slice():
    texts = pa.array(["é a", "A É b", None, "", "x"])
    assert [len(s) for s in N.shingle_sets(texts.slice(1))] == [2, 0, 0, 1]


def _linked(spark, monkeypatch, texts, keys, copies, batch):
    """The component of each class that has a link; keys gives the keys that a class shares with others, and batches hold `batch` classes."""
    from pyspark import cloudpickle

    width = max(map(len, keys))
    table = np.array([[*k, *(1000 + 100 * i + j for j in range(width - len(k)))] for i, k in enumerate(keys)], np.uint64)
    monkeypatch.setattr(N, "TASK_CLASSES", batch)
    monkeypatch.setattr(N, "index_keys", lambda signatures: table[signatures[:, 0]])
    rows = [(10 + i, i, 20 + i, n, bytearray(np.full(N.POSITIONS, i, "<u2").tobytes())) for i, n in enumerate(copies)]
    classes = spark.createDataFrame(rows, "cid long, doc_id long, th long, copies long, sig binary")
    docs = spark.createDataFrame([(i, 20 + i, t) for i, t in enumerate(texts)], "doc_id long, th long, text string")
    # by value: the workers are to see what was set here
    cloudpickle.register_pickle_by_value(N)
    try:
        found = N.link_classes(classes, docs, N.Scratch(spark, "test"))
        return {r.node - 10: r.component - 10 for r in found.collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(N)


def _text(letter, *changed):
    return " ".join([f"{letter}{i}" for i in range(100 - len(changed))] + list(changed))


def test_members_of_one_key_meet_across_batches(spark, monkeypatch):
    """Two near copies share one key; the best class of the key in either batch is a stranger."""
    texts = [_text("p"), _text("w"), _text("q"), _text("w", "new")]
    got = _linked(spark, monkeypatch, texts, [[7]] * 4, [9, 1, 8, 1], 2)
    assert got == {1: 1, 3: 1}


def test_a_lone_pair_that_was_not_the_first_choice(spark, monkeypatch):
    """x shares more keys with a stranger than with its near copy, the only other class of its second centre."""
    texts = [_text("p"), _text("w"), _text("w", "new")]
    got = _linked(spark, monkeypatch, texts, [[1, 2], [1, 2, 3], [3]], [9, 1, 5], 100)
    assert got == {1: 1, 2: 1}


def test_the_pipeline_compares_five_words(spark):
    """A text with five scattered words changed is a near copy by two words, and none by five."""
    import corpus_pipeline

    changed = [f"new{i}" if i % 20 == 10 else w for i, w in enumerate(f"w{i}" for i in range(100))]
    rows = [(1, _text("w")), (2, " ".join(changed)), (3, _text("w", "end")), (4, "W0 " + _text("w")[3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in N.op8_multi_index_minhash(df).where("kept").collect()} == {1}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 2}
