"""All near-duplicate pairs of a corpus through an inverted index over bottom-k sketches.

A pair is listed if its sketches overlap by at least 0.7 of the smaller one (the lowest class asks for no less), so
of the smaller sketch's n hashes at least ceil(0.7 n) lie in the other. Whatever order its hashes are put in, one of its
first n - ceil(0.7 n) + 1 is among them. Ordered by their number of texts, rarest first, these prefixes alone
probe the index of all hashes, so every pair is found and frequent hashes are rarely asked for. A hash of one text
is counted as rare and goes nowhere.

Clusters ask for `probable_near_duplicate` alone, which takes 0.9 in place of 0.7 and bounds the other two similarities,
so these are held against each candidate before its sketches are fetched. Of each hash's texts some pairs go first; what
they link needs no further pair, so a group of n copies alike is linked without its n (n - 1) / 2 pairs.

Equal texts collapse first: only the one of the smallest id is compared; its copies are listed with it. Texts are
sketched where they lie, in Arrow batches, without a shuffle. The pairs of n texts that are all alike are n (n - 1) / 2
rows of the result itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import sketch as S
from quern.functions import text as T
from quern.functions.hashes import md5_head
from quern.operators.components import connected_components
from quern.sources.scratch import Scratch

#: Least overlap of a listed pair, in tenths: that of the class `review`; and that of a probable one.
LEAST_TENTHS, NEAR_TENTHS = 7, 9
#: Bits in which a sketch leaves its marks, a multiple of 64.
MARKS = 512
#: Bytes of text that a task sketches at a time, and words whose votes fit a lane of sixteen bits.
SLICE_BYTES, LANE_WORDS = 2 << 20, (1 << 16) - 1
#: For four bits of a hash a number with one lane for each.
_LANES = np.array([sum((k >> b & 1) << 16 * b for b in range(4)) for k in range(16)], np.uint64)


def _hashes60(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first sixty bits of the MD5 of each part of the text."""
    return (md5_head(raw, starts, sizes) >> np.uint64(64 - S.HASH_BITS)).astype(np.int64)


def _votes(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each run of hashes, between two edges and not empty, how many of them have each bit set."""
    # a run is cut where its sums would leave their lanes
    cuts = np.concatenate([np.arange(x, y, LANE_WORDS) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]) if np.diff(edges).max() > LANE_WORDS else edges[:-1]
    sums = np.empty((len(cuts), S.HASH_BITS), np.int64)
    for k in range(0, S.HASH_BITS, 4):
        four = np.add.reduceat(_LANES[hashes >> k & 15], cuts)
        for b in range(4):
            sums[:, k + b] = four >> np.uint64(16 * b) & np.uint64(0xFFFF)
    return np.add.reduceat(sums, np.searchsorted(cuts, edges[:-1]))


def _sketch(texts: pa.Array, size: int, keep: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of texts of words joined by blanks: how many words, the sketch and the simhash."""
    raw = b"\0".join(texts.to_numpy(zero_copy_only=False))
    data = np.frombuffer(raw + b"\0", np.uint8)
    # words hold neither blanks nor zero bytes, which end words and texts
    ends = np.flatnonzero((data == 32) | (data == 0))
    starts = np.concatenate([[0], ends[:-1] + 1])
    upto = np.concatenate([[0], np.flatnonzero(data[ends] == 0) + 1])  # words before each text, empty texts counted as an empty word
    counts = np.diff(upto)
    empty = (counts == 1) & (ends[upto[:-1]] == starts[upto[:-1]])
    # a shingle begins at each word that has enough words of its text behind it, or at the first
    first = np.repeat(upto[:-1], counts)
    last = np.repeat(upto[1:], counts) - 1
    at = np.arange(len(starts))
    begins = (at + size - 1 <= last) | (at == first)
    until = np.minimum(at + size - 1, last)[begins]
    shingles = _hashes60(raw, starts[begins], ends[until] - starts[begins])
    of_text = np.concatenate([[0], np.cumsum(begins)])[upto]
    signatures = [np.unique(shingles[x:y])[:keep] if not none else shingles[:0] for x, y, none in zip(of_text[:-1].tolist(), of_text[1:].tolist(), empty.tolist(), strict=True)]
    # different words are hashed once
    words = pc.split_pattern(texts.cast(pa.large_string()), " ").flatten().dictionary_encode()
    sizes = pc.binary_length(words.dictionary).to_numpy()
    own = _hashes60(b"".join(words.dictionary.cast(pa.large_binary()).to_pylist()), np.cumsum(sizes) - sizes, sizes)
    set_bits = _votes(own[words.indices.to_numpy()], upto)
    bits = ((2 * set_bits >= counts[:, None]).astype(np.int64) << np.arange(S.HASH_BITS)).sum(axis=1)
    return np.where(empty, 0, counts), signatures, np.where(empty, 0, bits)


def sketches(size: int, keep: int):
    """(id, words joined by blanks) to (id, words, signature, simhash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
            upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
                counts, signatures, bits = _sketch(texts[at:end], size, keep)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signatures)]), pa.int32()), pa.array(np.concatenate(signatures), pa.int64()))
                yield pa.record_batch([batch.column(0).slice(at, end - at), pa.array(counts, pa.int64()), lists, pa.array(bits, pa.int64())], names=["id", "words", "signature", "simhash"])
                at = end

    return run


def distinct_texts(docs: DataFrame, scratch: Scratch, size: int = S.SHINGLE, keep: int = S.SKETCH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, first_id) of every id, and (doc_id, words, characters, signature, simhash) of the first id of each text; null ids are left out.

    Of rows of one id the text with the smallest hash stands for it.
    """
    norm = docs.where("doc_id is not null").select("doc_id", T.for_duplicates(F.coalesce("text", F.lit(""))).alias("t"))
    sized = norm.select(F.struct("doc_id", F.length("t").cast("long").alias("characters"), F.sha2("t", 256).alias("h")).alias("id"), F.array_join(S.unicode_words("t"), " ").alias("w"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = sized.mapInArrow(sketches(size, keep), f"id struct<doc_id:{kind},characters:bigint,h:string>, words long, signature array<long>, simhash long")
    each = scratch.cut(each.select("id.*", "words", "signature", "simhash"), "sketches")
    own = each.groupBy("doc_id").agg(F.min("h").alias("h"))
    first = own.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    members = scratch.cut(own.join(first, "h").select("doc_id", "first_id", "h"), "members")
    heads = members.where("doc_id = first_id").select(F.col("doc_id").alias("first_id"), "h")
    # repeated rows of the first id are equal
    single = each.join(heads, "h").where("doc_id = first_id").drop("first_id").groupBy("doc_id").agg(F.min(F.struct("words", "characters", "signature", "simhash")).alias("s"))
    return members.select("doc_id", "first_id"), scratch.cut(single.select("doc_id", "s.*"), "texts")


def hash_index(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n, h, texts): each hash that several texts hold, n the size of its text's sketch."""
    each = sketches.select("doc_id", F.size("signature").alias("n"), F.explode("signature").alias("h"))
    return scratch.cut(each.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("texts > 1"), "index")


def prefixes(index: DataFrame, tenths: int) -> DataFrame:
    """The rows of an index whose hashes are among those that a text asks for."""
    of_text = Window.partitionBy("doc_id")
    # a text's other hashes are of this text alone, and come first
    rank = F.row_number().over(of_text.orderBy("texts", "h")) + F.col("n") - F.count(F.lit(1)).over(of_text)
    return index.withColumn("rank", rank).where(F.col("rank") <= F.expr(f"n - ({tenths} * n + 9) div 10 + 1")).drop("rank", "texts")


def candidates(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_a, id_b), once each: pairs that may overlap by LEAST_TENTHS of the smaller sketch, and all that do."""
    index = hash_index(sketches, scratch)
    probes = prefixes(index, LEAST_TENTHS).select("h", F.col("doc_id").alias("p"), F.col("n").alias("pn"))
    met = probes.join(index.select("h", "doc_id", "n"), "h").where("p <> doc_id and pn <= n")
    return met.select(F.least("p", "doc_id").alias("id_a"), F.greatest("p", "doc_id").alias("id_b")).distinct()


def _length() -> Column:
    return (S.length_similarity("words_a", "words_b") + S.length_similarity("characters_a", "characters_b")) / 2


def scored(found: DataFrame, sketches: DataFrame) -> DataFrame:
    """(id_a, id_b, classification, shingle, sim, length) of pairs of ids."""
    side = lambda s: sketches.select(*(F.col(c).alias(f"{c}_{s}") for c in sketches.columns))
    both = found.join(side("a"), F.col("id_a") == F.col("doc_id_a")).join(side("b"), F.col("id_b") == F.col("doc_id_b"))
    of_pair = F.struct(S.overlap("signature_a", "signature_b").alias("shingle"), S.simhash_similarity("simhash_a", "simhash_b").alias("sim"), _length().alias("length"))
    # behind a generator the similarities are worked out once, not once for each use
    return both.select("id_a", "id_b", F.inline(F.array(of_pair))).select("id_a", "id_b", S.pair_class(F.lit(False), "shingle", "sim", "length").alias("classification"), "shingle", "sim", "length")


def sketch_pairs(docs: DataFrame) -> DataFrame:
    """(id_a, id_b, classification, shingle, sim, length) of all pairs of different texts above `likely_distinct`, and of each copy with the first of its text.

    Null and empty texts have no words: they are copies of each other and pair with nothing else. Rows of one id and one text count once; of
    rows of one id and different texts the text with the smallest hash stands for the id.
    """
    scratch = Scratch(docs.sparkSession, "sketch-pairs")
    members, sketches = distinct_texts(docs, scratch)
    found = candidates(sketches, scratch)
    named = scored(found, sketches).where("classification <> 'likely_distinct'")
    one = F.lit(1.0)
    copies = _copies(members).select("*", F.lit("exact_duplicate").alias("classification"), one.alias("shingle"), one.alias("sim"), one.alias("length"))
    return copies.union(named.select(*copies.columns))


def _copies(members: DataFrame) -> DataFrame:
    return members.where("doc_id <> first_id").distinct().select(F.col("first_id").alias("id_a"), F.col("doc_id").alias("id_b"))


def _alike(met: DataFrame) -> DataFrame:
    """(id_a, id_b), once each: pairs whose similarities of simhash and length are those of a probable pair."""
    near = met.where((S.simhash_similarity("simhash_a", "simhash_b") >= S.NEAR) & (_length() >= S.NEAR))
    return near.select(F.least("doc_id_a", "doc_id_b").alias("id_a"), F.greatest("doc_id_a", "doc_id_b").alias("id_b")).where("id_a <> id_b").distinct()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Behind other columns, in place of a sketch, MARKS bits, of which each hash sets one."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        bits = np.zeros((batch.num_rows, MARKS), bool)
        bits[np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists).to_numpy() % MARKS] = True
        words = np.packbits(bits, axis=1).view(np.int64)
        own = batch.schema.names[:-1]
        yield pa.record_batch([*batch.columns[:-1], *(pa.array(words[:, k].copy()) for k in range(words.shape[1]))], names=[*own, *(f"m{k}" for k in range(words.shape[1]))])


def near_links(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_a, id_b): probable pairs that have the same connected components as all probable pairs.

    First each text meets, under each hash it asks for, the shortest text that asks for it and the next shorter one. Then all pairs are
    held against each other whose texts these have not linked yet. A hash that one sketch lacks leaves its mark unset there or on another
    hash's, so marks of the smaller sketch that the other lacks are no more than the hashes it lacks.
    """
    own = ["doc_id", "words", "characters", "simhash"]
    marks = [f"m{k}" for k in range(MARKS // 64)]
    near = lambda pairs: scored(pairs, sketches).where("classification = 'probable_near_duplicate'").select("id_a", "id_b")
    index = hash_index(sketches, scratch)
    probes = scratch.cut(prefixes(index, NEAR_TENTHS), "probes")
    by_size = Window.partitionBy("h").orderBy("words", "characters", "doc_id")
    row = F.struct(*own)
    measured = probes.join(sketches.select(*own), "doc_id").select(*own, F.first(row).over(by_size).alias("shortest"), F.lag(row).over(by_size).alias("next"))
    beside = measured.select(*own, F.explode(F.array("shortest", "next")).alias("o")).where("o is not null")
    first = scratch.cut(near(_alike(beside.select(*(F.col(c).alias(f"{c}_a") for c in own), *(F.col(f"o.{c}").alias(f"{c}_b") for c in own)))), "first-links")
    linked = scratch.cut(connected_components(first, "id_a", "id_b", scratch), "linked")
    part = F.coalesce("component", "doc_id").alias("part")
    # hashes that nobody asks for, or whose texts are linked already, are done
    held = index.join(probes.select("h").distinct(), "h").join(linked, F.col("doc_id") == F.col("node"), "left").select("h", "doc_id", "n", part)
    held = scratch.cut(held, "held")
    scratch.drop(index)
    mixed = scratch.cut(held.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("h"), "mixed")
    marked = sketches.select(*own, "signature").mapInArrow(_marks, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sketches.select(*own).schema] + [f"{m} long" for m in marks]))
    rest = scratch.cut(held.join(mixed, "h").join(marked, "doc_id"), "rest")
    asked = probes.select("h", "doc_id").join(mixed, "h")
    side = lambda t, s: t.select(*(F.col(c).alias(f"{c}_{s}") for c in t.columns))
    met = side(rest.join(asked, ["h", "doc_id"]), "a").join(side(rest, "b"), F.col("h_a") == F.col("h_b")).where("part_a <> part_b and n_a <= n_b")
    lacking = sum((F.bit_count(F.col(f"{m}_a").bitwiseAND(F.bitwise_not(f"{m}_b"))) for m in marks), F.lit(0))
    return first.union(near(scratch.cut(_alike(met.where(lacking <= F.expr(f"n_a - ({NEAR_TENTHS} * n_a + 9) div 10"))), "met")))


def sketch_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, component, cluster_size) over exact copies and all probable pairs; component is the smallest id."""
    scratch = Scratch(docs.sparkSession, "sketch-clusters")
    members, sketches = distinct_texts(docs, scratch)
    edges = _copies(members).union(near_links(sketches, scratch))
    groups = scratch.cut(connected_components(edges, "id_a", "id_b", scratch), "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    return groups.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "cluster_size")
