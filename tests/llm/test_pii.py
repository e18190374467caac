import hashlib
import random
import re

from quern.llm import pii as P

SCHEMA = "doc_id long, text string, kind int, found string, spans int"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def card(made):
    body = f"4{made.randrange(10**14):014d}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def corpus(n=120):
    made = random.Random(4)
    rows = []
    for i in range(n):
        words = [made.choice(["the", "eauü", "größe", "met", "at", "noon", "dot", "𝒳𝒴"]) for _ in range(30)]
        spans = [f"{made.choice('abcxyz')}{i}.{made.randrange(99)}@mail{i % 9}.example.com", ".".join(str(made.randrange(1, 255)) for _ in range(4)), card(made), f"+1 ({made.randrange(200, 999)}) 555-{made.randrange(9999):04d}"]
        words[5], words[12], words[18], words[25] = spans
        rows.append((i, " ".join(words)))
    return rows


ODD = [
    None, "", "a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "000001.2.3.0255", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49(0)30-123456.", "4539 1488 0343 6467-", "45391488 03436467 45391488 03436467",
    "a" * 50000, "1" * 50000, "1 " * 30000, "1.1." * 20000, "(1" * 20000, "a@" * 20000, "a.b at " * 5000, "+1" * 20000, "ü" * 9 + "a@b.c", "\n".join(["q@r.s"] * 3000), "..@--.-", "𝒳 +123456789 𝒳",
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_base_patterns_disguises_and_clean_texts(spark):
    rows = corpus()
    planted = [
        (1000, "please call (555) 123-4567 now", "(555) 123-4567"), (1001, "phone 555.123.4567", "555.123.4567"), (1002, "login from 10[.]20[.]30[.]40", "10[.]20[.]30[.]40"), (1003, "paid with 4539.1488.0343.6467 then", "4539.1488.0343.6467"),
        (1004, "write to jane.12 [at] mail [dot] example [dot] com", "jane.12 [at] mail [dot] example [dot] com"), (1005, "mail b.77 at mail3 dot example dot org", "b.77 at mail3 dot example dot org"),
    ]
    clean = ["on 2024-05-06 and 12/05/2024", "he met them at noon.Then he left", "order 12345678", "in 1990-1995 some 1 200 000", "version 1.2.3", "total 12,13,14,15"]
    data = rows + [(2000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), rows[1]] + [(i, t) for i, t, _ in planted] + [(3000 + i, t) for i, t in enumerate(clean)]
    got = P.op12_pii_boosting(frame(spark, data)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i, text in data:
        base = brute(text or "")
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, (text or "")[:50], base[:3], r.spans[:90])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in P.KINDS]
        spans = [s for s in r.spans.split(",") if s]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (P.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    caught = 0
    for i, text, wanted in planted:
        found = [text[int(a) : int(b)] for s in by[i].spans.split(",") if s for _, a, b in [s.split(":")]]
        assert all(f in wanted or wanted in f for f in found)
        caught += wanted in found
    assert caught >= 5
    assert all(by[3000 + i].spans == "" for i in range(len(clean))), [by[3000 + i].spans for i in range(len(clean))]
    assert all(by[i].spans.count(":") == 2 * len(brute(t)) for i, t in rows)  # nothing else is taken in the plain texts


def test_empty_small_and_reruns(spark):
    assert P.op12_pii_boosting(frame(spark, [])).collect() == []
    (one,) = P.op12_pii_boosting(frame(spark, [(1, "call (555) 123-4567 or a@b.co")])).collect()
    assert one.spans == "email:23:29"  # too few spans for a model
    df = frame(spark, corpus(60))
    assert sorted(P.op12_pii_boosting(df).collect()) == sorted(P.op12_pii_boosting(df.repartition(3)).collect())


def test_redacted_texts(spark):
    got = P.redact(frame(spark, [(1, "to a@b.co, 1.2.3.4!"), (2, None), (3, "𝒳 plain"), (4, "+123456789012 x")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: "to [email], [ip]!", 2: None, 3: "𝒳 plain", 4: "[phone] x"}


def test_every_base_span_is_learned_from(spark):
    from quern.sources.scratch import Scratch

    base = spark.createDataFrame([(3, f"+1 (555) {i:03d}-4567", f"w{i} ", "") for i in range(450)], "kind int, hit string, before string, after string")
    rows = P.training_rows(base, Scratch(spark, "test"))
    assert rows.selectExpr("regexp_extract(before, 'w([0-9]+)', 1) AS i").distinct().count() == 450
