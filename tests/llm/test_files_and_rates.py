"""Token planes, archives, language model, mixing, sharding and the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import arc_convert as A
from quern.llm import lm_score as M
from quern.llm import mixing as X
from quern.llm import sharding as S
from quern.llm import token_planes as P

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 49408), (65536, 300), (33, 1 << 32)):
        ids = rng.integers(0, top, n).astype("<u4")
        assert (P.from_planes(P.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_tokens(spark, tmp_path, kind):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(P.TOKENIZER))
    texts = ["Hello, World!", None, "", "  \n", "It's I'LL 12a3'd <|endoftext|>x", "Ünïcödé ſtraße İstanbul ΣΑΣ é ½ ǅ Ⅷ 你好", "word " * 30_000, "a\u00a0b\u2003c\x1cd", "x.", "x,", "X."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "again", 1)], "doc_id long, text string, first int").repartition(3)
    t = Tokenizer.from_file(path)
    P.write_tokens(df, str(tmp_path / "t"), path, kind=kind, block=1000)
    rows = P.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 3])
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at
        assert ids in ([*t.encode(x or "", add_special_tokens=False).ids, P.END_ID] for x in ([texts[3], "again"] if r.doc_id == 3 else [texts[r.doc_id]]))
        at += len(ids)
    index = P.chunk_index(spark, str(tmp_path / "t")).orderBy("first").collect()
    assert sum(r.n_ids for r in index) == at and index[0].first == 0
    assert P.op2_token_planes(df.limit(0), path).count() == 0


def test_tokens_are_read_in_small_pieces(spark, tmp_path, monkeypatch):
    """A part's ids are never held whole: what a task hands on at a time is bounded by OUT_BYTES, and lengths by SLICE_BYTES."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(P.TOKENIZER))
    texts = [f"word{i}, \u00c9t\u00e9!! No\u00cbl... A1b2;" * (i % 7) + "x" * (i % 3) for i in range(300)] + ["long " * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    P.write_tokens(df, str(tmp_path / "t"), path, block=64)
    t, at, n = Tokenizer.from_file(path), 0, 0
    for r in P.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, P.END_ID]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == ids
        at, n = at + len(ids), n + 1
    assert n == len(texts)
    plan = P.read_tokens(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    monkeypatch.setattr(P, "SLICE_BYTES", 1000)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    slices = list(P._slices(batch))
    assert pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch]))
    assert all(s.num_rows == 1 or sum(len((x or "").encode()) for x in s.column(1).to_pylist()) <= 1000 for s in slices)


def test_arc_versions_and_conversion():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    raw = b"\n".join([A.version_block(1), A.arc_record("http://a b/c", "20010203", block), A.version_block(2), A.arc_record("http://x/\n", "20010203040506", b"\n\nWARC/1.1 filedesc:", 2), A.arc_record(None, "2001", b"", 2)])
    found = [r for r in A.parse_arc(raw) if not r[0]["url"].startswith("filedesc:")]
    assert [b for _, b in found] == [block, b"\n\nWARC/1.1 filedesc:", b""]
    assert found[1][0]["result"] == "200" and "checksum" not in found[0][0]
    assert A.iso_date("2001") == "2001-01-01T00:00:00Z" and A.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError, match="declares"):
        list(A.parse_arc(A.arc_record("http://a/", "2001", b"abc")[:-1]))
    assert list(A.parse_arc(b"http://a b/c 1.1.1.1 2001 text/html 1\nx"))[0][0]["url"] == "http://a b/c"


def test_records_are_members_and_keep_their_header_fields(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(A, "FILE_BYTES", 700)
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    arc = [A.version_block(2), *[A.arc_record("http://h/a", "20010203", block, 2, ip="9.8.7.6")] * 3, A.arc_record("dns:h", "2001", b"h 1 IN A 9.8.7.6", 2, mime="text/dns")]
    (tmp_path / "arc").mkdir()
    # one stream for the whole file, as old archives have it
    (tmp_path / "arc" / "part-old.arc.gz").write_bytes(gzip.compress(b"\n".join(arc)))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(A)
    try:
        A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    finally:
        cloudpickle.unregister_pickle_by_value(A)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 1 and all(f.stat().st_size <= 1000 for f in files)
    records = [r for f in files for raw in A.members_of(f.read_bytes()) for r in [list(A.parse_warc(raw))]]
    assert all(len(r) == 1 for r in records)
    heads = [r[0][0] for r in records]
    assert len({h["warc-record-id"] for h in heads}) == len(heads) == 5
    assert sorted(h["warc-type"] for h in heads) == ["resource", "response", "response", "response", "warcinfo"]
    pages = [h for h in heads if h["warc-type"] == "response"]
    assert all((h["warc-ip-address"], h["warc-identified-payload-type"], h["warc-date"]) == ("9.8.7.6", "text/html", "2001-02-03T00:00:00Z") for h in pages)
    assert [h["content-type"] for h in heads if h["warc-type"] == "resource"] == ["text/dns"]
    assert b"".join(gzip.decompress(f.read_bytes()) for f in files).count(b"hello") == 3


def test_archive_round_trip(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n\n\n", "x" * 300_000, "<p>é</p>", "solo"]
    rows = [(i, None if i == 3 else f"http://h/{i} \n x", h, "clash") for i, h in enumerate(html)] + [(7, "http://h/7", "solo", "c"), (None, "u", "", "c")]
    got = A.op4_arc_to_warc(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = html[r.page_id] if r.page_id is not None else ""
        raw = (text or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = min(i for i, h in enumerate(html) if (h or "") == (text or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    assert A.op4_arc_to_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scores(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", "x.", "End"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", None, " \t ", "new words only", "a\x0bb  c"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    words = [re.findall(WORD, (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    want = M.brute_force(words, train)
    rows = M.score_documents(df.repartition(5), range_bytes=300).collect()
    assert len(rows) == len(texts)
    known = {w for ws, used in zip(words, train, strict=True) if used for w in ws}
    for r in rows:
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id]), r.doc_id
        assert (r.held_out, r.n_tokens) == (not train[r.doc_id], len(words[r.doc_id]) + 1)
        assert r.n_known == sum(w in known for w in words[r.doc_id]) + 1
        assert r.train_tokens == sum(len(w) + 1 for w, used in zip(words, train, strict=True) if used)
    assert M.score_documents(df.limit(0)).count() == 0


def test_scores_of_repeated_null_and_long_rows(spark, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(M, "BLOCK_BYTES", 500)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(80))) for _ in range(30)] + [" ".join(rng.choice("abcdefgh") for _ in range(40_000))]
    ids = ["7", "7", None, None, *map(str, range(100, 127))]
    texts[1] = texts[0]
    words = [t.split() for t in texts]
    # a null id counts as the text null in the split
    train = [zlib.crc32((i or "null").encode()) % 7 != 2 for i in ids]
    want = sorted(M.brute_force(words, train))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string")
    cloudpickle.register_pickle_by_value(M)
    try:
        got = sorted((r.base_score, r.score) for r in M.score_documents(df, range_bytes=1000).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(M)
    assert got == [pytest.approx(w) for w in want]
    # no training rows at all
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = M.score_documents(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 4, 0, 0) and r.base_score == r.score == 0 for r in rows) and len(rows) == len(held)


def test_packed_numbers():
    rng = np.random.default_rng(3)
    for values in ([], [0], [255, 256], [(1 << 64) - 1, 0], list(rng.integers(0, 1 << 62, 50))):
        own = np.array(values, np.uint64)
        assert M._wide(M._narrow(own)).tolist() == own.tolist()
        if len(own):
            own.sort()
            assert M._summed(M._steps(own)).tolist() == own.tolist()


def docs_for(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "a", "é", None])
        rows.append((i, rng.choice([None, ""]) if i % 40 == 0 else " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), source))
    rows += [(i, "the same text " * 20, "hot") for i in range(n, n + 200)] + [(n, "the same text " * 20, "hot")]
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int"), rows


def test_mixing(spark):
    df, rows = docs_for(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    got = X.op3_entropy_balance(df).collect()
    assert len(got) == len(rows)
    taken, source = defaultdict(int), {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 10), s
    again = X.op3_entropy_balance(df).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    mixed = X.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got if r.size) + sum(r.copies for r in got if not r.size)
    assert X.op3_entropy_balance(df.limit(0)).count() == 0


def test_rates_are_the_entropy_solution(spark):
    """The dual's rates are min(3, exp(lambda * size)) with one lambda a source, found here by bisection, and copies follow them."""
    from quern.sources.scratch import Scratch

    cells = {"a": {3: 40, 10: 30, 50: 8, 400: 1}, "b": {1: 100, 7: 60, 90: 5}}
    targets = {"a": 700.0, "b": 1500.0}
    hist = spark.createDataFrame([(s, z, n) for s, c in cells.items() for z, n in c.items()], "source string, size long, n long")
    want = spark.createDataFrame([(s, 0, t) for s, t in targets.items()], "source string, source_size long, target double")
    dual = X.balance(hist, want, Scratch(spark, "test"))
    for r in dual.collect():
        own = cells[r.source]
        words = lambda lam: sum(min(3.0, math.exp(min(5.0, lam * z))) * z * n for z, n in own.items())  # noqa: B023, E731
        low, high = -10.0, 10.0
        for _ in range(200):
            low, high = (low, (low + high) / 2) if words((low + high) / 2) > targets[r.source] else ((low + high) / 2, high)
        assert r.lam / r.scale == pytest.approx(low, rel=1e-4, abs=1e-6)  # within 0.01 words of the target
    # whole copies: close to the rates, in a cell and along the sizes, but for the last moves towards the target
    for r in X.round_copies(hist, dual, Scratch(spark, "test")).collect():
        lam = next(d for d in dual.collect() if d.source == r.source)
        rate = min(3.0, math.exp(lam.lam / lam.scale * r.size))
        assert 0 <= r.copies <= 3 * r.n and abs(r.copies - rate * r.n) <= 1 + max(cells[r.source]) / r.size


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(None, "one two three", "a")] * 401 + [(7, "one two three", "a")] * 200 + [(i, "w " * (i % 9 + 1), "b") for i in range(100, 300)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, target = defaultdict(int), {}
    got = X.op3_entropy_balance(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for k, v in target.items():
        assert abs(taken[k] - v) <= 5, (k, taken[k], v)
    assert X.mixed_documents(df).count() == sum(r.copies for r in got)


def test_steps_that_do_not_converge_raise(spark, monkeypatch):
    df, _ = docs_for(spark)
    monkeypatch.setattr(X, "STEPS", 1)
    with pytest.raises(RuntimeError, match="converge"):
        X.op3_entropy_balance(df).collect()


def test_sharding(spark):
    df, rows = docs_for(spark)
    got = S.op9_sampled_splitters(df).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r.size for r in got)
    assert max(load.values()) - min(load.get(k, 0) for k in range(16)) <= 2 * largest + 0.1 * sum(load.values()) / 16
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, S.op9_sampled_splitters(df).collect()), key=str)
    assert S.op9_sampled_splitters(df.limit(0)).count() == 0


def test_shards_of_copies_with_null_and_repeated_ids(spark, monkeypatch):
    copies = "the same text again " * 20
    small = [(i, f"row {i} " * (1 + i % 30), "x") for i in range(2000)]
    for ids in ([None] * 2000, [7] * 2000, list(range(5000, 7000))):
        df = spark.createDataFrame(small + [(i, copies, "x") for i in ids], "doc_id long, text string, shard string").repartition(5)
        got = S.assign_shards(df).collect()
        load, slots = defaultdict(int), defaultdict(list)
        for r in got:
            load[r.shard] += r.size
            slots[r.shard].append(r.slot)
        mean = sum(load.values()) / 16
        assert len(got) == 4000 and all(abs(load[k] - mean) <= 0.1 * mean for k in range(16)), sorted(load.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted(r.row.text for r in S.assign_shards(df, keep=True).collect()) == sorted(t for t in [r.text for r in df.collect()])
    # equal texts stay together while they are light
    light = spark.createDataFrame([(i, f"text {i % 900}", "x") for i in range(3600)], "doc_id long, text string, shard string")
    homes = defaultdict(set)
    for r in S.assign_shards(light).collect():
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 16
    # ranges that are cut by size
    monkeypatch.setattr(S, "RANGE_BYTES", 4)
    got = S.assign_shards(light).collect()
    assert sorted(r.slot for r in got if r.shard == 3) == list(range(sum(r.shard == 3 for r in got)))


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    final = C.run(spark, sf)
    assert final.columns == [*docs.columns, "shard", "slot", "shard_bytes"]
    rows = final.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    import __spark_entry__

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] if q[:2] == "op" else q for q in __spark_entry__.queries()}
