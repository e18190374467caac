import re
from collections import Counter, defaultdict

from quern.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n long, df long, rank string"


def brute(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {k for k, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (k, s), c in groups.items() if k == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", far), ("term", over)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def rows():
    words = ["the", "The", "ünd", "naïve", "über", "x", "Ä", "end-of", "a1b", "ſ", "K"]
    made = []
    for i in range(160):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(1, 3 + i % 9))
        made.append((i % 150 or None, text, ("en", "de", None)[i % 3 if i % 7 else 0], ("s1", "s2", "é", "S", None)[(i // 3) % 5]))
    made += [(900, None, "en", "s9"), (901, "", "zz", "only"), (902, " 123 -- ", "zz", "two"), (903, "the " * 30000, "en", "s1"), made[5], made[5]]
    return made


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in data], SCHEMA)


def test_against_brute_force(spark):
    data = rows()
    for least, top in ((3, 4), (1, 50), (40, 2)):
        assert sorted(map(tuple, D.audit(frame(spark, data), least, top).collect())) == brute(data, least, top)


def test_small_blocks_and_batches(spark, monkeypatch):
    data = rows()
    for name, value in (("SORTED_BYTES", 100), ("HELD_RUNS", 20), ("PAIR_BLOCK", 2), ("HELD_BLOCKS", 1)):
        monkeypatch.setattr(D, name, value)
    texts = __import__("pyarrow").record_batch([[x or "" for x in c] for c in list(zip(*data, strict=True))[2:4] + [list(zip(*data, strict=True))[1]]], names=["lang", "source", "text"])
    runs = [b for b in D._count(iter([texts]))]
    assert len(runs) > 3
    counted = Counter()
    for b in runs:
        for lang, term, _source, _df, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counted[lang, term] += n
    assert counted["en", "the"] > 30000 and sum(counted.values()) == sum(len(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r[1] or "")) for r in data)
    shares = __import__("pyarrow").record_batch([["l"] * 6, ["t"] * 3 + ["u"] * 3, ["a", "b", "c"] * 2, [9, 4, 2, 1, 5, 3], [1, 2, 1, 1, 2, 1]], names=["lang", "term", "source", "p", "z"])
    sums = Counter()
    for b in D._pairs(iter([shares.slice(0, 2), shares.slice(2)])):
        for _, x, y, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[x, y] += v
    value = lambda p, z, q, y: abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y)
    assert sums["a", "b"] == sums["b", "a"] == value(9, 1, 4, 2) + value(1, 1, 5, 2)


def test_empty_and_reruns(spark):
    assert D.op11_source_divergence(frame(spark, [])).collect() == []
    only = frame(spark, [(1, None, None, None)])
    assert D.op11_source_divergence(only).collect() == []
    data = frame(spark, rows()).repartition(7)
    assert sorted(D.audit(data, 2).collect()) == sorted(D.audit(data.repartition(2), 2).collect())
