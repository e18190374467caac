"""Language-model scoring with a weighted backoff automaton.

The model has n-grams of ORDER = 3 words, each order smoothed by the one below with a Dirichlet prior:
p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3) and p(w | v) = (c(v w) + MU2 p(w)) / (c(v) + MU2), over the
add-one unigram p(w) = (c(w) + 1) / (N + V + 1). As an automaton every history of one or two words seen in training
is a state. A seen n-gram is an arc from its history; a failure arc of weight MU / (c(history) + MU) leads from a state
to that of its last word, and from there to the root, whose arcs are the unigrams. An arc leads to the longest state
that ends the words read. A text is traversed once from left to right, from the state of its beginning to its end token;
failure arcs are followed where no arc fits, and log10 probabilities are added up. As a state is fixed by the two words
before it, a block's texts are traversed together, all their places at once in each step.

No model is collected or broadcast. Documents are packed into blocks of about BLOCK_BYTES, which are written once, compressed;
a block sends the distinct n-grams of its texts, each with its training count, to hash ranges. A range sums the counts
of all blocks and answers each block with the totals of what it asked for. A block then holds the slice of the
automaton that its own texts can reach, and scores them. Texts move compressed, n-grams as differences of sorted hashes;
the rows between blocks and ranges are never more than the distinct n-grams of the blocks, so they grow with the input;
memory follows the block.

n-grams are identified by KEY_BITS = 56 bits of a hash. Words are runs of anything but ASCII white space, after A-Z are
lower-cased.

Defined results: a null or empty text is its end token alone. Rows that repeat an id are scored each, and
train each. A null id counts as the text ``null`` in the split. Without training tokens N and V are 0 and
every token has probability 1. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch, setting

#: Prior weights of the model below, for two and three words.
MU = (100.0, 25.0)
FOLDS, HELD_OUT = 7, 2
#: Bytes of texts in a block, and for each hash range; memory of a task is about 60 times the first.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 6 << 20
KEY_BITS = 56
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
#: Stand for the end and the beginning of a text among word hashes.
END, BEGIN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Block:
    """The texts of a block as local word numbers, and its distinct n-grams."""

    def __init__(self, table: pa.Table) -> None:
        text = pc.fill_null(table.column("text").combine_chunks().cast(pa.string()), "")
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        hashes = _mixed(pd.util.hash_array(words, categorize=False)) if len(words) else np.zeros(0, U)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        # pieces between two blanks in a row are empty and no words
        empty = {i for i, w in enumerate(words) if w == ""}
        real = ~np.isin(codes, list(empty)) if empty else np.ones(len(codes), bool)
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
        self.docs = len(offsets) - 1
        self.end, self.begin = len(hashes), len(hashes) + 1
        self.hashes = np.concatenate([hashes, np.array([END, BEGIN], U)])
        self.tokens = np.insert(codes, offsets[1:], self.end)
        self.bounds = offsets + np.arange(self.docs + 1)
        n = len(self.hashes)
        before = np.empty_like(self.tokens)
        if len(before):
            before[1:] = self.tokens[:-1]
            before[self.bounds[:-1]] = self.begin
        train = np.repeat(~table.column("held_out").to_numpy(), np.diff(self.bounds))
        #: distinct words, bigrams and trigrams in use, which one stands at each place, and how often training texts hold them
        word_n = np.bincount(self.tokens, weights=train, minlength=n).astype(np.int64)
        pair_ids, self.pair, pair_n = self._counts(before * n + self.tokens, train)
        #: the places that have two words before them, the beginning counted
        self.deep = np.flatnonzero(before != self.begin)
        tri_ids, self.tri, tri_n = self._counts(self.pair[self.deep - 1] * n + self.tokens[self.deep], train[self.deep])
        self.pair_first, self.pair_last = pair_ids // n, pair_ids % n
        self.tri_first, self.tri_last = tri_ids // n, tri_ids % n
        pair_hashes = _mixed(self.hashes[self.pair_first] * _STEP + self.hashes[self.pair_last])
        tri_hashes = _mixed(pair_hashes[self.tri_first] * _STEP + self.hashes[self.tri_last])
        # the low bits tell the orders apart; the beginning is a word of none
        short = lambda h, order: (h >> U(64 - KEY_BITS)) & ~U(3) | U(order)
        keys = np.concatenate([short(self.hashes[: n - 1], 1), short(pair_hashes, 0), short(tri_hashes, 2)])
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], np.concatenate([word_n[: n - 1], pair_n, tri_n])[self.order]

    @staticmethod
    def _counts(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, at = np.unique(values, return_inverse=True)
        return ids, at, np.bincount(at, weights=train, minlength=len(ids)).astype(np.int64)

    def ranges(self, n: int) -> list[tuple[int, int]]:
        """Where the keys of each hash range lie."""
        cuts = np.searchsorted(self.keys, (np.arange(1, n, dtype=object) * (1 << KEY_BITS) // n).astype(U)) if n > 1 else []
        return list(zip([0, *cuts], [*cuts, len(self.keys)], strict=True))


def _narrow(values: np.ndarray) -> bytes:
    """A byte that says how many bytes a value takes, then the values in as many."""
    most = int(values.max()) if len(values) else 0
    width = max(1, -(-most.bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : raw[0]] = part
    return out.reshape(-1).view("<u8")


def _small(values: np.ndarray) -> bytes:
    return zstandard.compress(_narrow(values), 1)


def _large(raw: bytes) -> np.ndarray:
    return _wide(zstandard.decompress(raw))


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the differences."""
    return keys[:1].tobytes() + _narrow(np.diff(keys))


def _summed(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw[:8], U), _wide(raw[8:])]), dtype=U)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) to (block, bytes, raw): documents in numbered, compressed blocks."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def made() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "raw"])

    for batch in batches:
        sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            stop, own = at, 0
            while stop < batch.num_rows and (own == 0 and not held or size + own + sizes[stop] <= BLOCK_BYTES):
                own += int(sizes[stop])
                stop += 1
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += own
            if stop < batch.num_rows:
                yield made()
                number, held, size = number + 1, [], 0
            at = stop
    if held:
        yield made()


def _unpacked(raw: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


def _ask(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(_unpacked(raw))
                parts = [(r, a, b) for r, (a, b) in enumerate(block.ranges(ranges)) if b > a]
                yield pa.record_batch(
                    [
                        pa.array([number] * len(parts), pa.int64()),
                        pa.array([r for r, _, _ in parts], pa.int32()),
                        pa.array([_steps(block.keys[a:b]) for _, a, b in parts], pa.binary()),
                        pa.array([_small(block.counts[a:b]) for _, a, b in parts], pa.binary()),
                    ],
                    names=["block", "range", "keys", "counts"],
                )
                del block, parts
                pa.default_memory_pool().release_unused()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Sums a range over all blocks; the row without a block holds the range's training tokens and distinct words."""
    keys = [_summed(x) for x in table.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_large(x) for x in table.column("counts").to_pylist()])
    # sums of whole numbers below 2**53 are exact
    totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    words = totals[(distinct & U(3)) == 1]
    parts = np.split(totals[at], np.cumsum([len(k) for k in keys])[:-1])
    none = [None] * len(parts)
    return pa.table(
        {
            "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
            "range": pa.array([table.column("range")[0].as_py()] * (len(parts) + 1), pa.int32()),
            "totals": pa.array([*(_small(p) for p in parts), None], pa.binary()),
            "tokens": pa.array([*none, int(words.sum())], pa.int64()),
            "words": pa.array([*none, int((words > 0).sum())], pa.int64()),
        }
    )


class Automaton:
    """The slice of the automaton that a block's texts reach. States are bigrams, words and the root; arcs lie beside the n-grams of the block."""

    def __init__(self, block: Block, totals: np.ndarray, tokens: int, words: int, mu: tuple[float, float] = MU) -> None:
        n, pairs = len(block.hashes), len(block.pair_first)
        by_place = np.empty(len(totals), np.int64)
        by_place[block.order] = totals
        #: training counts; as many texts begin as end
        self.count = np.append(by_place[: n - 1], by_place[block.end])
        pair, tri = by_place[n - 1 : n - 1 + pairs], by_place[n - 1 + pairs :]
        one = (self.count + 1) / (tokens + 1.0 * (words + 1))
        two = (pair + mu[0] * one[block.pair_last]) / (self.count[block.pair_first] + mu[0])
        # the bigram that ends each trigram
        inner = np.empty(len(tri), np.int64)
        inner[block.tri] = block.pair[block.deep]
        three = (tri + mu[1] * two[inner]) / (pair[block.tri_first] + mu[1])
        #: weights of the arcs of the root, of word states and of bigram states, and whether there is such an arc
        self.root, self.pair_arc, self.tri_arc = np.log10(one), np.log10(two), np.log10(three)
        self.has_pair, self.has_tri = pair > 0, tri > 0
        #: weights of the failure arcs, and whether a history is a state
        self.word_fail, self.pair_fail = np.log10(mu[0] / (self.count + mu[0])), np.log10(mu[1] / (pair + mu[1]))
        self.is_word, self.is_pair = self.count > 0, pair > 0

    def weights(self, block: Block) -> np.ndarray:
        """What each token adds on the way: the arc of its state, or failure arcs and the arc of the first state below that has one."""
        before = block.pair_first[block.pair]
        # from the state of the word before
        below = np.where(self.is_word[before], self.word_fail[before], 0.0) + self.root[block.tokens]
        out = np.where(self.has_pair[block.pair], self.pair_arc[block.pair], below)
        # from the state of the two words before, where training holds them
        deep, history = block.deep, block.pair[block.deep - 1]
        below = np.where(self.is_pair[history], self.pair_fail[history], 0.0) + out[deep]
        out[deep] = np.where(self.has_tri[block.tri], self.tri_arc[block.tri], below)
        return out


_SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(ranges: int, tokens: int, words: int, mu: tuple[float, float]):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.concat_tables([_unpacked(raw) for raw in packed.column("raw")])
        block = Block(docs)
        totals = np.zeros(len(block.keys), np.int64)
        places = block.ranges(ranges)
        for r, raw in zip(answers.column("range").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            a, b = places[r]
            totals[a:b] = _large(raw)
        model = Automaton(block, totals, tokens, words, mu)
        known = np.concatenate([[0], np.cumsum(model.count[block.tokens] > 0)])
        # each text has its end token, so none is empty; a difference of running sums would lose digits
        sums = lambda values: np.add.reduceat(values, block.bounds[:-1]) if block.docs else np.zeros(0)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(np.diff(block.bounds)),
                "n_known": pa.array(np.diff(known[block.bounds]).astype(np.int64)),
                "train_tokens": pa.array(np.full(block.docs, tokens, np.int64)),
                "base_score": pa.array(sums(model.root[block.tokens])),
                "score": pa.array(sums(model.weights(block))),
            }
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: tuple[float, float] = MU, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document, in the columns of the contract."""
    scratch = Scratch(docs.sparkSession, "lm")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    # written once: a block keeps its texts, whatever becomes of the tasks that read them
    packed = own.select("doc_id", held.alias("held_out"), "text").mapInArrow(_packed, "block long, bytes long, raw binary")
    packed = scratch.cut(packed, "blocks", compression="none", row_group_bytes=2 * BLOCK_BYTES)
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    blocks = packed.select("block", "raw")
    asked = blocks.mapInArrow(_ask(ranges), "block long, range int, keys binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "block long, range int, totals binary, tokens long, words long")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", 1):  # a block at a time
        answers = scratch.cut(answers, "answers", compression="zstd")
    sums = answers.where("block is null").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = sums[0] or 0, sums[1] or 0
    given = answers.where("block is not null").select(F.col("block").alias("for"), "range", "totals")
    schema = _SCORED.format(id=own.schema["doc_id"].dataType.simpleString())
    return blocks.groupBy("block").cogroup(given.groupBy("for")).applyInArrow(_scorer(ranges, tokens, words, mu), schema)


def op5_backoff_automaton(docs: DataFrame) -> DataFrame:
    return score_documents(docs)


def brute_force(texts: list[list[str]], train: list[bool], mu: tuple[float, float] = MU) -> list[tuple[float, float]]:
    """(base, score) of each text by the formulas alone (for tests)."""
    seen: dict[tuple, int] = {}
    follows: dict[tuple, int] = {}
    for words, used in zip(texts, train, strict=True):
        line = ["<s>", *words, None]
        for i in range(1, len(line) if used else 0):
            for k in (1, 2, 3):
                if k <= i + 1:
                    gram = tuple(line[i + 1 - k : i + 1])
                    seen[gram] = seen.get(gram, 0) + 1
                    follows[gram[:-1]] = follows.get(gram[:-1], 0) + 1
    n = sum(c for g, c in seen.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in seen)
    out = []
    for words in texts:
        line, base, score = ["<s>", *words, None], 0.0, 0.0
        for i in range(1, len(line)):
            p = (seen.get((line[i],), 0) + 1) / (n + v + 1)
            base += math.log10(p)
            for k in (2, 3):
                if k <= i + 1:
                    gram = tuple(line[i + 1 - k : i + 1])
                    p = (seen.get(gram, 0) + mu[k - 2] * p) / (follows.get(gram[:-1], 0) + mu[k - 2])
            score += math.log10(p)
        out.append((base, score))
    return out
