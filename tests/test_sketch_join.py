import hashlib
import random
from itertools import combinations

from quern.functions import sketch as S
from quern.operators import corpus as C
from quern.operators import sketch_join as J

SCHEMA = "doc_id long, text string, title string, h string, n int"


def corpus():
    made = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["naïve", "ÜBER", "x_y"]
    rows = []
    for family in range(14):
        base = [made.choice(words) for _ in range(made.choice([4, 12, 60, 300]))]
        for member in range(made.choice([1, 2, 6])):
            own = list(base)
            for _ in range(made.choice([0, 0, 1, 2, len(base) // 40])):
                own[made.randrange(len(own))] = made.choice(words)
            rows.append((family * 10 + member, " ".join(own) + (" " + " ".join(words[:120]) if family > 9 else "")))
    rows += [(500, None), (501, ""), (502, " "), (503, "—"), (504, rows[3][1].upper()), (505, rows[3][1].replace(" ", "  ")), (506, "one"), (507, "One")]
    return rows


def test_every_pair_is_found(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "t", "h", 1) for i, t in rows], SCHEMA)
    got = {(r.id_a, r.id_b): (r.classification, round(r.shingle, 6), round(r.sim, 6), round(r.length, 6)) for r in J.sketch_pairs(df).collect()}
    prints = C.fingerprints(df.selectExpr("doc_id", "coalesce(text, '') AS text", "title")).withColumn("block", S.F.lit(1))
    every = {(r.id_a, r.id_b): r for r in C.near_duplicate_pairs(prints).collect()}
    text = {p.doc_id: p.exact_hash for p in prints.collect()}
    first = {h: min(i for i, x in text.items() if x == h) for h in text.values()}
    wanted = {(first[h], i): ("exact_duplicate", 1.0, 1.0, 1.0) for i, h in text.items() if first[h] != i}
    for a, b in combinations(sorted(first.values()), 2):
        r = every[a, b]
        if r.classification != "likely_distinct":
            wanted[a, b] = (r.classification, round(r.shingle, 6), round(r.sim, 6), round(r.length, 6))
    assert got == wanted and len({c for c, *_ in got.values()}) == 3


def test_only_rare_hashes_probe(spark):
    """A passage that all texts hold makes no candidates where it is less than the least overlap."""
    common = " ".join(f"c{i}" for i in range(40))
    df = spark.createDataFrame([(i, " ".join(f"d{i}x{k}" for k in range(90)) + " " + common, "t", "h", 1) for i in range(60)], SCHEMA)
    scratch = J.Scratch(spark, "test")
    _, sketches = J.distinct_texts(df, scratch)
    assert J.candidates(sketches, scratch).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.sketch_pairs(df).collect() == [] and J.sketch_clusters(df).collect() == []
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (1, text), (1, text), (2, text + " b"), (3, text), (3, "other words here")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.id_a, r.id_b, r.classification) for r in J.sketch_pairs(df).collect())
    assert (1, 2, "probable_near_duplicate") in got or (1, 2, "review") in got
    assert ((1, 3, "exact_duplicate") in got) == (hashlib.sha256(text.encode()).hexdigest() < hashlib.sha256(b"other words here").hexdigest())
    assert {r.component for r in J.sketch_clusters(df).collect()} <= {1}


def chains():
    """Groups that are linked through middle texts alone, a group all alike, and strangers that share their passage."""
    made = random.Random(11)
    rows = []
    for family in range(6):
        base = [f"f{family}x{made.randrange(5000)}" for _ in range(300)]
        for _ in range(12):
            rows.append((len(rows), " ".join(base)))
            base = [w for k, w in enumerate(base) if k != 7] if family % 2 else [*base[4:], *(f"n{made.randrange(9999)}" for _ in range(4))]
    same = [f"g{k}" for k in range(400)]
    rows += [(100 + k, " ".join([*same, *(f"t{k}x{j}" for j in range(k % 3 + 1))])) for k in range(60)]
    rows += [(200 + k, " ".join([*same[:60], *(f"o{k}x{j}" for j in range(60))])) for k in range(12)]
    return rows


def test_clusters_are_those_of_all_probable_pairs(spark):
    rows = chains() + [(i + 1000, t) for i, t in corpus()]
    df = spark.createDataFrame([(i, t, "t", "h", 1) for i, t in rows], SCHEMA)
    part = {}
    pairs = [(r.id_a, r.id_b) for r in J.sketch_pairs(df).where("classification in ('exact_duplicate', 'probable_near_duplicate')").collect()]
    for a, b in pairs:
        x, y = part.setdefault(a, {a}), part.setdefault(b, {b})
        if x is not y:
            x |= y
            part.update(dict.fromkeys(y, x))
    got = {r.doc_id: (r.component, r.cluster_size) for r in J.sketch_clusters(df).collect()}
    assert got == {i: (min(x), len(x)) for i, x in part.items()}
    assert len({c for c, _ in got.values()}) > 6 and max(n for _, n in got.values()) == 60


def test_texts_all_alike_are_linked_without_all_their_pairs(spark):
    same = [f"g{k}" for k in range(400)]
    df = spark.createDataFrame([(k, " ".join([*same, f"t{k}"]), "t", "h", 1) for k in range(80)], SCHEMA)
    scratch = J.Scratch(spark, "test")
    _, sketches = J.distinct_texts(df, scratch)
    assert J.near_links(sketches, scratch).count() < 80 * 79 // 8
    assert {(r.component, r.cluster_size) for r in J.sketch_clusters(df).collect()} == {(0, 80)}
