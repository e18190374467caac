import datetime as d
import random
from difflib import SequenceMatcher

from quern.operators import link as L


def norm(x):
    x = (x or "").upper().replace("&", " AND ")
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in x).split())


def brute(records, metadata):
    ratio = lambda a, b: 100 * SequenceMatcher(None, a, b).ratio()
    out = []
    for i, day, p, q in records:
        scored = []
        for m, held, a, b in metadata:
            if day is not None and day == held:
                first = ratio(norm(p), norm(a))
                s = first if not norm(q) or not norm(b) else 0.55 * first + 0.45 * ratio(norm(q), norm(b))
                scored.append((-round(s, 6), m))
        if not scored:
            out.append((i, 0, None, "NO_MATCH", None, 0))
            continue
        s, m = min(scored)
        status = "HIGH_CONFIDENCE" if -s >= 85 else "REVIEW" if -s >= 65 else "LOW_CONFIDENCE"
        out.append((i, len(scored), round(-s, 2), status, m, sum(x == s for x, _ in scored)))
    return out


def test_sequence_links_against_brute_force(spark):
    made = random.Random(3)
    names = ["A & B Corp.", "A and B Corp", "State of X", "Union", "M/s. Z", "", None, "ü", "Zed, M/s", "state of x "]
    days = [d.date(2020, 1, k) for k in (1, 2, 3)] + [None]
    row = lambda i: (i, made.choice(days), made.choice(names), made.choice(names))
    records, metadata = [row(i) for i in range(60)] + [(5, days[0], "Union", None)] * 2, [row(i + 100) for i in range(25)]
    schema = "id long, day date, p string, q string"
    a, b = spark.createDataFrame(records, schema), spark.createDataFrame(metadata, schema).withColumnRenamed("id", "score")
    columns = lambda key: (key, "day", "p", "q")
    got = L.link_by_date(a, b, columns("id"), columns("score"), L.sequence_similarity).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(records, metadata), key=str)
    assert {r.status for r in got} >= {"NO_MATCH", "HIGH_CONFIDENCE"} and max(r.ties for r in got) > 1
    none = L.link_by_date(a, b.limit(0), columns("id"), columns("score")).collect()
    assert len(none) == len(records) and {r.status for r in none} == {"NO_MATCH"}
    assert L.link_by_date(a.limit(0), b, columns("id"), columns("score")).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_of_all_pairs_of_names():
    from quern.functions.edits import distances

    made = random.Random(5)
    name = lambda: "".join(made.choice("ab\u00e9c 1") for _ in range(made.choice([0, 1, 2, 9, 63, 64, 65, 90])))
    a, b = [name() for _ in range(40)], [name() for _ in range(30)]
    assert distances(a, b).tolist() == [[edits(x, y) for y in b] for x in a]
    assert distances([], b).shape == (0, 30) and distances(a, []).shape == (40, 0)


def test_edit_links_over_many_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    made = random.Random(7)
    names = ["A & B Corp.", "A and B Corp", "State of X", "Union", "M/s. Z", "", None, "\u00fc", "state of x ", "Union of 1", "Union of 2", "long name " * 9]
    row = lambda i: (i, made.choice([1, 1, 1, 2, None]), made.choice(names), made.choice(names))
    records, metadata = [row(i) for i in range(80)], [row(i + 100) for i in range(60)] + [(99, 1, "Union", "")] * 2
    day = "date_add(date'2020-01-01', d) AS day"
    a, b = (spark.createDataFrame(t, "id long, d int, p string, q string").selectExpr("id", day, "p", "q") for t in (records, metadata))
    got = L.link_by_date(a, b, ("id", "day", "p", "q"), ("id", "day", "p", "q")).collect()
    alike = lambda x, y: 100.0 * (1 - edits(x, y) / max(len(x), len(y))) if x or y else 100.0
    for r, (i, d_, p, q) in zip(sorted(got), records, strict=True):
        scored = []
        for m, e, f, g in metadata:
            if d_ is not None and d_ == e:
                first = alike(norm(p), norm(f))
                scored.append((-round(first if not norm(q) or not norm(g) else 0.55 * first + 0.45 * alike(norm(q), norm(g)), 6), m))
        best = min(scored, default=(None, None))
        assert (r.id, r.candidates, r.match, r.ties) == (i, len(scored), best[1], sum(s[0] == best[0] for s in scored))


def test_nearest_names_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    asked = [(g, n) for g in (1, 2, 3) for n in ("abc", "abd", "", None, "zzzz")]
    held = [(1, n, k) for k, n in enumerate(["abx", "abc", "", None, "zz", "abx", "abd"], 10)] + [(2, "", 30), (2, None, 29)]
    a, b = spark.createDataFrame(asked, "g int, n string"), spark.createDataFrame(held, "g int, n string, k long")
    got = {(r.group, r.first): (r.least, r.edits) for r in L.nearest_name(a, b, "g", "n", "g", "n", "k").collect()}
    assert got == {(1, "abc"): (11, 0), (1, "abd"): (16, 0), (1, ""): (10, 3), (1, "zzzz"): (14, 2), (2, "abc"): (30, 3), (2, "abd"): (30, 3), (2, "zzzz"): (30, 4)}


def test_cells_of_names_against_whole_tables(monkeypatch):
    import numpy as np
    import pyarrow as pa

    made = random.Random(13)
    name = lambda: made.choice(["M S CUSTOMER AND SONS 00", "CUSTOMER ", "", "é" * 60]) + str(made.randrange(10 ** made.choice([1, 3, 5])))
    side = lambda n, seconds: sorted({(made.choice([name(), name(), ""]), made.choice(seconds)) for _ in range(n)}, key=lambda _: made.random())
    a, b = side(300, ["", "STATE OF X", "STATE OF Y", "UNION"]), side(400, ["", "STATE OF X", "1 URGENT", "STATE OF YZ"])
    left = pa.table({"group": pa.array([1] * len(a)), "first": [x for x, _ in a], "second": [x for _, x in a]})
    right = pa.table({"group": pa.array([1] * len(b)), "first": [x for x, _ in b], "second": [x for _, x in b], "rows": pa.array(range(1, len(b) + 1)), "least": pa.array(made.sample(range(9999), len(b)))})
    asked = []
    counted = L.distances
    monkeypatch.setattr(L, "distances", lambda x, y: asked.append(len(x) * len(y)) or counted(x, y))
    monkeypatch.setattr(L, "HELD", 3000)
    whole = L._best_of_tables(left, right.sort_by("least")).to_pylist()
    of_tables = sum(asked)
    asked.clear()
    cells = L._best_of_cells(left, (r := right.sort_by("least")), *([t.column(c).to_pylist() for c in ("first", "second")] for t in (left, r))).to_pylist()
    best = lambda rows: sorted(tuple(r.values()) for r in rows)
    assert best(cells) == best(whole) and 2 * sum(asked) < of_tables
    monkeypatch.setattr(L, "CELL", 0)
    assert best(L._best_of_block(left, right).to_pylist()) == best(whole)
    assert np.isfinite([r["score"] for r in whole]).all()


def test_edits_behind_a_common_beginning():
    from quern.functions.edits import distances

    made = random.Random(17)
    tail = lambda n: "".join(made.choice("ab1 ") for _ in range(made.randrange(n + 1)))
    for begin, most in (("ab", 6), ("a1b ab", 8), ("a" * 30, 16), ("b1" * 20, 24), ("a b", 61)):
        a, b = [begin + tail(most) for _ in range(25)], [tail(3) + begin[: made.randrange(len(begin) + 1)] + tail(most) for _ in range(25)] + [""]
        assert distances(a, b).tolist() == [[edits(x, y) for y in b] for x in a]
