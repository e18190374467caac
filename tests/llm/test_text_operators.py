"""Quality rules, decontamination, url filters and line dedup against plain Python."""

import random
import re
from functools import lru_cache

from quern.llm import decontaminate as D
from quern.llm import line_dedup as L
from quern.llm import quality_rules as Q
from quern.llm import url_filter as U

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1}
    hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t", "a", "the of and to in a is that it for", "x y\nx y\n\nx y ", "a b c d e f " * 5, "é ü # * $\x0b% &|<>", "the cat sat on the mat and it was not\r\nthe dog for that",
    "w " * 4000, " ".join(f"w{i}" for i in range(3000)), "a b c d e a b c d e a b c d e", "\n".join(["same line here"] * 6),
]


def test_quality_counts(spark):
    df = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words int, kept boolean")
    rows = Q.op6_quality_rules(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        n, chars, symbols, dup, repeat = counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.doc_id
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)
    good = Q.keep_good(df)
    assert good.columns == df.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in rows if r.kept}
    assert {4, 8} <= {r.doc_id for r in good.collect()}
    assert Q.op6_quality_rules(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 8
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 9, 10, 11, 25))))) for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1]), (None, "w1 w2"), (33, "-- !!")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 5, 60, 400))))) for i in range(40)]
    docs += [(100, None), (101, "Padding, " + " ".join(w.upper() for w in items[3][1].split()) + ". end"), (102, "w " * 5000 + items[5][1])]
    docs.append(docs[-2])
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = {i: D.words_of(t.encode()) for i, t in items if i is not None and t}
    want = {}
    for i, t in docs:
        own = D.words_of(t.encode() if t else None)
        hit, found = D.brute_force(own, words)
        want[i] = (len(own), len(hit), len(found), D.sha256_of(found), bool(hit))
    # a small filter lets strangers through, which the join drops
    for bits in (D.BITS, 1 << 15, 1 << 5):
        found = D.mark_passages(df, bench, bits=bits)
        assert {r.doc_id: (len(r.item_ids), sum(s.stop - s.start for s in r.spans)) for r in found.collect()} == {i: (v[2], v[1]) for i, v in want.items()}
    rows = D.op10_decontaminate(df, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id
    left = D.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, v in want.items() if not v[4]}
    assert D.op10_decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert D.op10_decontaminate(df.limit(0), bench).count() == 0


URLS = [
    ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.net/es/1?x=/fr/", "a.net", "/es/1", "net/es/", "block"), ("http://a.net/de", "a.net", "/de", None, "allow"), ("http://example.com", "example.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://h#f/en/", "h", "", None, "allow"), ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for rows in (U.op1_redirect_filter(pages), U.filter_urls(pages, U.alias_edges(pages), [*U.RULES, *(("block", f"h{i}.org", "/") for i in range(300))])):
        got = {r.page_id: r for r in rows.collect()}
        assert len(got) == len(URLS)
        for i, (_, host, path, rule, verdict) in enumerate(URLS):
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), i
    assert U.op1_redirect_filter(pages.limit(0)).count() == 0


def test_redirects_pass_blocks_on(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.org/x", link.format("http://b.org/y")),
        (2, "http://b.org/y#top", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/z">'),
        (3, "http://d.org/q", link.format("/other")),
        (4, "https://d.org/other?", ""),
        (5, "http://ok.com/p", link.format("http://c.net/fr/z")),
        (6, "http://a.org/x", ""),
        (7, None, link.format("http://c.net/fr/z")),
    ]
    got = {r.page_id: r.verdict for r in U.op1_redirect_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # 1 and 2 reach the blocked c.net/fr/z; 5 does too, but a rule of its own allows it
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}


def test_long_rule_lists_order_ties_alike(spark):
    rules = [("block", "com", "/abcd"), ("block", "x.com", "/ab"), ("allow", "y.com", "/q"), ("block", "com", "/qqq"), ("block", "b.com", "/"), ("block", "a.b.com", "/")]
    urls = ["http://x.com/abcd", "http://y.com/qqq", "http://a.b.com/z", "http://c.b.com/z", "http://x.com/ab"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    more = [("block", f"h{i}.org", "/") for i in range(U.MAX_COMPILED + 1)]
    verdicts = lambda r: sorted(map(tuple, U.filter_urls(df, U.alias_edges(df), r).collect()))
    few = verdicts(rules)
    assert few == verdicts([*rules, *more])
    assert [v[3] for v in few] == ["com/abcd", "y.com/q", "a.b.com/", "b.com/", "x.com/ab"]


def test_links_are_resolved_and_chains_followed(spark):
    page = lambda *hrefs: "".join(f"<link rel='canonical' href='{h}'>" for h in hrefs)
    rows = [
        (1, "http://s.org/a/b/c?x=1", page("../d?p=1&amp;q=2", "?y=2", "./", "/../top")),
        (2, "http://s.org/plain", page("other")), (3, "http://s.org", page("//t.org/x", "http://u.org/a/../b")),
    ]
    got = {(r.source, r.target) for r in U.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    one, three = rows[0][1], rows[2][1]
    assert got == {
        (one, "http://s.org/a/d?p=1&q=2"), (one, "http://s.org/a/b/c?y=2"), (one, "http://s.org/a/b/"), (one, "http://s.org/top"),
        ("http://s.org/plain", "http://s.org/other"), (three, "http://t.org/x"), (three, "http://u.org/b"),
    }
    # a chain of nine hops over as many tasks, by redirects alone, reaches the blocked end
    chain = [f"http://n{i}.org/p" for i in range(9)] + ["http://z.net/es/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*chain, "http://free.org/p"])], "page_id long, url string, html string")
    moves = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "source string, target string").repartition(9)
    verdicts = {r.page_id: r.verdict for r in U.op1_redirect_filter(pages, moves).collect()}
    assert verdicts == {**dict.fromkeys(range(10), "block"), 10: "allow"}


@lru_cache(maxsize=None)
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_and_probes():
    rng = random.Random(1)
    for _ in range(3000):
        e = rng.choice((1, 2, 3))
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        d = edits(a, b)
        assert L.within(a, b, e) == (d <= e)
        short, long = sorted((a, b), key=len)
        if d <= e < len(short):
            own = {(k, short[s : s + n]) for k, (s, n) in enumerate(L.segments(len(short), e))}
            assert own & {(k, long[s : s + n]) for k, s, n in L.probes(len(long), len(short), e)}


def test_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(24, 60))).strip() + "x" * 24 for _ in range(12)]
    lines = list(base)
    for _ in range(60):
        b = list(rng.choice(lines))
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice("abcé")
        lines.append("".join(b))
    docs = [(i, "\n".join(rng.sample(lines, 9)) + "\n\n short \n") for i in range(20)] + [(90, None), (91, ""), (None, lines[0]), (19, lines[0])]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, line int")
    distinct = sorted({x.strip() for _, t in docs for x in (t or "").split("\n") if x.strip()})
    want = {}
    for x in distinct:
        want[x] = sum(x != y and edits(x, y) <= L.EDITS for y in distinct)
    classes, links = L.similar_lines(df)
    name = {bytes(r.line_id): r.line for r in classes.collect()}
    got = dict.fromkeys(name.values(), 0)
    for r in links.collect():
        got[name[bytes(r.x)]] += 1
        got[name[bytes(r.y)]] += 1
    assert got == want
    rows = L.op7_segment_edit_join(df).collect()
    assert {name[bytes.fromhex(r.line_id)]: r.n_links for r in rows} == want
    # groups: the smallest first document and all rows of the lines reachable over links
    own = {x: [i for i, t in docs for y in (t or "").split("\n") if y.strip() == x] for x in distinct}
    for r in rows:
        group, todo = set(), [name[bytes.fromhex(r.line_id)]]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in distinct if y not in group and edits(x, y) <= L.EDITS]
        holders = [i for x in group for i in own[x]]
        assert (r.component_doc_id, r.component_rows) == (min((i for i in holders if i is not None), default=None), len(holders))
    assert sum(r.n_rows for r in rows) == sum(bool(x.strip()) for _, t in docs for x in (t or "").split("\n"))
    assert L.op7_segment_edit_join(df.limit(0)).count() == 0


def test_bags(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcdeéz ñ") for _ in range(rng.randrange(1, 60)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "x", "Ω"])
        rows.append((a, "".join(b)))
    rows += [("o" * 8, "g" * 7), ("g" * 7, "o" * 15)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(edits(a, b), *(signed(int(v)) for v in L.bags_of([a.encode(), b.encode()]))) for a, b in rows], "d int, x long, y long")
    assert df.where(f"d <= 2 and not ({L.bags_near('x', 'y', 2)})").count() == 0
    assert df.where(f"not ({L.bags_near('x', 'y', 2)})").count() > 0


def test_short_lines_are_linked_too(spark):
    rng = random.Random(6)
    lines = {"".join(rng.choice("abcd é") for _ in range(rng.randrange(1, 28))).strip() for _ in range(150)} - {""}
    lines |= {"Subscribe to our list", "Subscribe to our list.", "x" * 23, "x" * 24, "a", "b", "yz", "wxyz"}
    df = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    classes, links = L.similar_lines(df)
    name = {bytes(r.line_id): r.line for r in classes.collect()}
    got = {tuple(sorted((name[bytes(r.x)], name[bytes(r.y)]))) for r in links.collect()}
    assert got == {(x, y) for x in lines for y in lines if x < y and edits(x, y) <= L.EDITS}


def test_bags_of_long_lines_are_counted_in_parts(monkeypatch):
    lines = [b"a", "é".encode() * 5000, b"", b"xyz" * 3000, b"q"]
    whole = L.bags_of(lines)
    monkeypatch.setattr(L, "PART", 700)
    assert L.bags_of(lines).tolist() == whole.tolist() == [int(L.bags_of([x])[0]) for x in lines]


def test_the_filter_lets_every_member_through(spark):
    from quern.llm import bits as B

    rng = random.Random(3)
    own = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, B.BITS - 1, B.BITS, 32767, 32768]
    table = B.collect_bits(spark.createDataFrame([(h,) for h in [*own, None]], "h long"), "h", 1 << 17)
    import numpy as np

    assert B.passes(table, np.array(own, np.int64).view(np.uint64)).all()
    strangers = np.array([rng.randrange(1 << 64) for _ in range(5000)], np.uint64)
    assert B.passes(table, strangers).mean() < 0.02


def test_every_holder_of_a_line_is_listed(spark):
    rows = [(1, "Subscribe to our list\n own line of one "), (2, "Subscribe to our list\nSubscribe to our list"), (3, "\x0b\tSubscribe to our list.\r\f\n\n"), (None, "Subscribe to our list"), (2, "Subscribe to our list")]
    got = L.op7_segment_edit_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fields = ("doc_id", "n_rows", "first_doc_id", "line_rows", "n_chars", "n_links", "component_doc_id", "component_rows")
    want = {(1, 1, 1, 5, 21, 1, 1, 6), (2, 3, 1, 5, 21, 1, 1, 6), (None, 1, 1, 5, 21, 1, 1, 6), (3, 1, 3, 1, 22, 1, 1, 6), (1, 1, 1, 1, 15, 0, 1, 1)}
    assert {tuple(r[f] for f in fields) for r in got} == want and len(got) == len(want)
