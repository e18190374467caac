"""Edit distances of all pairs of two lists of names, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Characters of a name that fit one machine word.
WORD = 64
NO_LETTER = 0xFFFFFFFF


def distances(names: list[str], others: list[str]) -> np.ndarray:
    """int32 (names, others): Levenshtein distances in code points.

    The names' columns of the distance table are kept as bits (Myers, Hyyro), one word each, and all names take a character at
    once. The others are taken in order, so those with a common beginning share its steps. What all names begin with is stepped
    once for all, and the words are as wide as the rest needs. Longer names take whole columns.
    """
    out = np.zeros((len(names), len(others)), np.int32)
    if not len(others):
        return out
    short = np.array([len(x) <= WORD for x in names], bool)
    order = sorted(range(len(others)), key=others.__getitem__)
    for rows, start, step, score in ((np.flatnonzero(short), *_bits([x for x in names if len(x) <= WORD])), (np.flatnonzero(~short), *_columns([x for x in names if len(x) > WORD]))):
        if not len(rows):
            continue
        found = np.zeros((len(order), len(rows)), np.int32)
        states, before = [start], ""
        for o in order:
            other = others[o]
            same = 0
            for a, b in zip(before, other):  # noqa: B905  the shorter one ends it
                if a != b:
                    break
                same += 1
            del states[same + 1 :]
            for c in other[same:]:
                states.append(step(states[-1], c))
            found[o] = score(states[-1], len(other))
            before = other
        if len(rows) == len(names):
            return found.T
        out[rows] = found.T
    return out


def _letters(names: list[str], most: int) -> np.ndarray:
    """Code points, a row for each name, filled up with NO_LETTER."""
    size = max(map(len, names), default=0)
    if 0 < size <= most and size == min(map(len, names)):
        return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(names), size)
    out = np.full((len(names), min(most, max(map(len, names), default=0))), NO_LETTER, np.uint32)
    for k, x in enumerate(names):
        out[k, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def _bits(names: list[str]):
    low, high = min(names, default=""), max(names, default="")
    same = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), len(low))  # noqa: B905  the shorter one ends it
    begin, names = low[:same], [x[same:] for x in names]
    width = next(w for w in (8, 16, 32, 64) if w >= max(map(len, names), default=0))
    kind = np.dtype(f"u{width // 8}")
    sizes = np.array([len(x) for x in names], np.uint64)
    ones = np.full(len(names), np.iinfo(kind).max, kind)
    used = np.where(sizes == 0, np.uint64(0), np.uint64((1 << width) - 1) >> np.where(sizes == 0, np.uint64(0), np.uint64(width) - sizes)).astype(kind)
    letters = _letters(names, width)
    bits = kind.type(1) << np.arange(letters.shape[1], dtype=kind)
    places = {chr(c): np.bitwise_or.reduce(np.where(letters == c, bits, kind.type(0)), axis=1) for c in np.unique(letters).tolist() if c != NO_LETTER}
    none, one = np.zeros(len(names), kind), kind.type(1)
    # the common beginning has a word of its own, whose last row hands its step on to the rest
    whole, last = (1 << same) - 1, same - 1
    common = {c: sum(1 << k for k, x in enumerate(begin) if x == c) for c in set(begin)}

    def step(state, c):
        more, less, top, bottom = state
        handed = 1
        if same:
            equal = common.get(c, 0)
            diagonal = (((equal & top) + top) ^ top) | equal | bottom
            up, down = (bottom | ~(diagonal | top)) & whole, top & diagonal
            handed = (up >> last & 1) - (down >> last & 1)
            up, down = (up << 1 | 1) & whole, down << 1 & whole
            top, bottom = (down | ~(diagonal | up)) & whole, up & diagonal
        equal = places.get(c, none)
        diagonal = equal & more if handed >= 0 else (equal | one) & more
        diagonal += more
        diagonal ^= more
        diagonal |= equal
        diagonal |= less
        if handed < 0:
            diagonal |= one
        up = more | diagonal
        np.invert(up, out=up)
        up |= less
        up <<= one
        if handed > 0:
            up |= one
        down = more & diagonal
        down <<= one
        if handed < 0:
            down |= one
        less = up & diagonal
        up |= diagonal
        np.invert(up, out=up)
        up |= down
        return up, less, top, bottom

    def score(state, size):
        counted = (np.bitwise_count(state[0] & used) - np.bitwise_count(state[1] & used)).view(np.int8)
        return counted.astype(np.int32) + (size + state[2].bit_count() - state[3].bit_count())

    return (ones, none, whole, 0), step, score


def _columns(names: list[str]):
    longest = max(map(len, names), default=0)
    letters = _letters(names, longest)
    sizes = np.array([len(x) for x in names], np.int64)
    place = np.arange(longest + 1, dtype=np.int32)

    def step(column, c):
        fresh = column + 1
        np.minimum(fresh[:, 1:], column[:, :-1] + (letters != ord(c)), out=fresh[:, 1:])
        return np.minimum.accumulate(fresh - place, axis=1) + place

    def score(column, size):
        return column[np.arange(len(sizes)), sizes]

    return np.tile(place, (len(names), 1)), step, score
