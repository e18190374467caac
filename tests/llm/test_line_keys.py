"""Keys of the segment edit join: few for each line, none lost, and those of one line alone dropped before the join."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import line_dedup as L


def keys(*lines):
    counts, found = L.keys_of([x.encode() for x in lines])
    ends = np.cumsum(counts)
    return [set(found[e - n : e].tolist()) for e, n in zip(ends, counts, strict=True)]


def edited(rng, line):
    out = list(line)
    for _ in range(rng.randrange(L.EDITS + 1)):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randrange(2)] = rng.choice(["", "x", "é"])
    return "".join(out)


@pytest.mark.parametrize("long", [L.LONG, 50])
def test_lines_within_the_edits_share_a_key(monkeypatch, long):
    monkeypatch.setattr(L, "LONG", long)
    rng = random.Random(11)
    for _ in range(1500):
        a = "".join(rng.choice("abcdeé ñ") for _ in range(rng.choice([rng.randrange(1, 40), rng.randrange(1, 130), rng.randrange(90, 500)])))
        b = edited(rng, a)
        if b:
            before = "y" * rng.randrange(1, 200)  # the place in a slice makes no difference
            _, left, _, right = keys(before, a, before, b)
            assert left & right and [left] == keys(a)


def test_prose_has_few_keys_a_line_and_moved_words_share_none():
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(300)]
    own = keys(*lines)
    assert sum(map(len, own)) < 7.5 * len(lines)  # an index and probes of their own would be fifteen
    # a word moved from the front to the end leaves the counts of characters as they are, and must not make a candidate
    moved = keys(*(x.partition(" ")[2] + " " + x.partition(" ")[0] for x in lines))
    assert sum(bool(a & b) for a, b in zip(own, moved, strict=True)) < 10


def test_keys_of_one_line_alone_are_dropped():
    rng = random.Random(13)
    rows = sorted({(rng.randrange(60) * 16 + half % 3, half, half % 7) for half in (rng.randrange(40) for _ in range(150))})
    want = {(h, b, k) for k, h, b in rows if any(k >> 4 == x >> 4 and h != y for x, y, _ in rows)}
    rows = sorted(rows + rng.sample(rows, 50))  # a line that several tasks hold
    for size in (1, 3, 500):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch([pa.array([r[i] for r in p], pa.int64()) for i in (1, 2, 0)], names=["half", "bag", "key"]) for p in parts]
        got = [tuple(r.values()) for x in L._shared(iter(batches)) for r in x.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    assert list(L._shared(iter([]))) == []
