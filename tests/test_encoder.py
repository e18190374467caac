import random

import numpy as np
import pytest

from quern.operators import encoder as E
from quern.sources.scratch import Scratch

SCHEMA = "doc_id long, text string, vec string, place int"


def corpus(n=120):
    made = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    return [(i, " ".join(made.choice(topics[i % 6] if made.random() < 0.8 else made.choice(topics)) for _ in range(60))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_near_texts_rank_first_and_reruns_agree(spark):
    rows = corpus()
    rows += [(1000 + i, " ".join([*t.split()[:-4], "new", "words", "at", "end"]).upper()) for i, t in rows[:20]] + [(2000, None), (2001, ""), (2002, "—"), (None, rows[0][1])]
    df = frame(spark, rows)
    found = [(r.doc_id, np.array(r.vec)) for r in E.encode_corpus(df, "doc_id", "text", 24, 1 << 12).collect()]
    again = {r.doc_id: list(r.vec) for r in E.encode_corpus(df.repartition(7), "doc_id", "text", 24, 1 << 12).collect()}
    assert len(found) == len(rows) and all(again[i] == list(v.astype(np.float32)) for i, v in found)
    vec = dict(found)
    assert not any(vec[i].any() for i in (2000, 2001)) and (vec[None] == vec[0]).all()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for i, v in found if i not in (2000, 2001))
    for i in range(20):
        scores = sorted(((float(vec[1000 + i] @ v), k) for k, v in found if k not in (1000 + i, None)), reverse=True)
        assert scores[0][1] == i


def test_against_a_dense_factorisation(spark):
    scratch = Scratch(spark, "test")
    words = E.bucketed(frame(spark, corpus()), "doc_id", "text", scratch, 1 << 10)
    model = E.fit(words, 8, 8, 3, 1 << 10)
    rows = words.collect()
    a = np.zeros((len(rows), 1 << 10))
    for k, r in enumerate(rows):
        n = np.array(r["count"])
        w = np.sign(n) * (1 + np.log(abs(n))) * model.idf[r.place]
        a[k, r.place] = w / np.linalg.norm(w)
    values = np.linalg.svd(a, compute_uv=False)[:8] ** 2
    assert model.variances[:6] == pytest.approx(values[:6], rel=1e-3)
    assert np.linalg.norm(a @ model.axes) ** 2 >= 0.99 * values.sum()
    assert E.fit(words.limit(0), 4, 2, 1, 1 << 10).axes.shape == (1 << 10, 4)


def test_batches_are_halved(spark):
    def load():
        def encode(texts):
            if len(texts) > 9:
                raise MemoryError
            return [[float(len(x)), 1.0] for x in texts]

        return encode

    def never():
        def encode(texts):
            raise MemoryError

        return encode

    df = frame(spark, corpus(50) + [(99, None)])
    got = {r.doc_id: list(r.vec) for r in E.encode_with(df, "doc_id", "text", load).collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in corpus(50) + [(99, None)]}
    with pytest.raises(Exception, match="MemoryError"):
        E.encode_with(df, "doc_id", "text", never).collect()
