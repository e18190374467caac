import random

from pyspark.sql import functions as F

from quern.operators import anchors as A
from quern.operators import verify as V


def test_same_as_the_plain_functions(spark):
    made = random.Random(8)
    words = ["the", "court", "held", "that", "Rule", "5", "naïve", "X.", "law;", "—", "so:", "no?", "a", "\n", "it's"]
    text = lambda n: " ".join(made.choice(words) for _ in range(made.randrange(n)))
    rows = []
    for i in range(150):
        source = text(70)
        own = source.split()
        anchor = made.choice([text(8), " ".join(own[3:9]), " ".join(w for w in own[2:12] if made.random() < 0.8), "", None])
        rows.append((i, made.choice([source, source, None, ""]) if i % 9 == 0 else source, anchor, made.choice([text(9), None]), "x"))
    rows += [rows[0], (None, "a b c d", "a b d", None, None)]
    df = spark.createDataFrame(rows, "id long, s string, rid string, p string, a string")
    got = A.resolve_anchors(df, "s", "rid", "p").collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["id", "s", "rid", "p", "a", "resolved"]
    by = {}
    for r in got:
        by.setdefault((r.id, r.s, r.rid, r.p), set()).add(r.resolved)
    for i, s, a, p, _ in rows:
        assert by[i, s, a, p] == {V.resolve_anchor(s, a, p)}, (s, a, p)
    assert len({r.resolved for r in got}) > 10
    both = df.select("s", A.clauses("s").alias("c"), A.ordered_coverage(A.tokens("rid"), A.tokens("s")).alias("o"), "rid").collect()
    for r in both:
        assert r.c == V.clauses(r.s)
        assert abs(r.o - V.ordered_coverage(V._norm(r.rid).split(), V._norm(r.s).split())) < 1e-12
    assert A.resolve_anchors(df.limit(0), "s", "rid", "p").collect() == []


def test_coverage_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "x", "b", "a"]), (["a", "z", "b"], ["a", "b"]), ([], ["a"]), (["a"], [])], "n array<string>, h array<string>")
    assert [round(r.x, 6) for r in df.select(A.ordered_coverage(F.col("n"), F.col("h")).alias("x")).collect()] == [1.0, 0.333333, 0.0, 0.0]


def test_ratios_are_worked_out_only_where_they_decide(monkeypatch):
    import difflib

    asked = []
    whole = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: asked.append(1) or whole(m))
    clause = "the tenant shall pay the rent of the month; "
    # no clause of a long text is long enough to be close to it, and a short text is as close as its common end says
    assert V.resolve_anchor(clause * 12, clause.replace("shall ", "") * 12, "") == "" and asked == []
    text = " ".join((clause * 3).split())
    assert V.resolve_anchor(text, text.replace("shall ", "", 1), "") == text and asked == []

    def plain(source, anchor):
        wanted, best = V._norm(anchor), (0.0, "", False)
        for c in V.clauses(source):
            have, need = V._norm(c).split(), wanted.split()
            sequence = whole(difflib.SequenceMatcher(None, wanted, V._norm(c)))
            covered = max(V.ordered_coverage(need, have), len(set(need) & set(have)) / len(set(need)))
            total = V.SEQUENCE_WEIGHT * sequence + V.COVERAGE_WEIGHT * covered
            if total > best[0]:
                best = (total, c, sequence >= V.SEQUENCE or (covered >= V.COVERAGE and sequence >= V.LEAST_SEQUENCE))
        return best[1] if best[2] else ""

    made, found = random.Random(4), set()
    for _ in range(400):
        words = [made.choice(["rent", "rents", "of", "a", "month;", "is", "due.", "paid", "late:", "so"]) for _ in range(made.choice([9, 30, 110]))]
        own = words[: made.choice([8, 30, 110])]
        anchor = " ".join(made.choice(own) if made.random() < 0.15 else w for w in own)
        if V._norm(anchor) not in V._norm(" ".join(words)):
            assert V.resolve_anchor(" ".join(words), anchor, "") == plain(" ".join(words), anchor)
            found.add(plain(" ".join(words), anchor) != "")
    assert found == {True, False}
