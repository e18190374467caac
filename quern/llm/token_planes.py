"""Token ids in bit- or byte-plane shuffled, zstandard-compressed chunks.

The ids of all documents, in ascending order of id, form one stream that is cut into blocks of `BLOCK`
ids. A block is transposed: plane k holds bit k (or byte k) of every id, so planes of high bits are nearly
constant and compress well; each plane is compressed on its own with zstandard, and planes that are all
zero are left out. The format is two Parquet tables, written and read by Spark alone:

* ``chunks``: one row per block with its planes and its place in the index: part, number in the part, first id
  in the part, count of ids, plane width and a checksum;
* ``index``: one row per document: part, its order there, first id in the part, count of ids.

Parts are ranges of the document id; the ids before a part come from a prefix sum over the part totals.

Defined results: a null or empty text gives the end id alone. A null document id comes first. Rows with one
id follow each other, ordered by text. An empty table gives an empty archive. Extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

BLOCK = 1 << 16
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words that each of the two generations of a Python worker's cache holds.
CACHE = 150_000
#: Text bytes that a task encodes at a time, and bytes of ids that it hands on at a time.
SLICE_BYTES, OUT_BYTES = 6 << 20, 4 << 20
#: Text bytes of a part.
PART_BYTES = 48 << 20


# ---- planes


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of uint32 ids, lowest first, compressed; trailing planes of zeros are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    bits = top.bit_length()
    if kind == "byte":
        rows = ids.view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]
    else:
        rows = [np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little") for k in range(bits)]
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(unpack.decompress(p, max_output_size=n), np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        raw = np.frombuffer(unpack.decompress(p, max_output_size=-(-n // 8)), np.uint8)
        ids |= np.unpackbits(raw, count=n, bitorder="little").astype("<u4") << k
    return ids


# ---- tokens


#: Characters whose letters and case follow plain rules: printable ASCII, Latin-1 letters and Latin Extended-A but dotted I.
_PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"

_MARKS = ",.;:!?#%&$*"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids. White space ends every piece of this tokenizer, so each distinct run between ASCII white space is encoded once and kept.

    Plain pieces go to the tokenizer's model directly, without its normalizer and pre-tokenizer, whose work on
    them is lower-casing, splitting by `words` and the byte alphabet; all others take the whole tokenizer. If the
    tokenizer file is of another kind, everything does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        splits = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        lowers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.words = regex.compile(splits[0]) if len(splits) == 1 and lowers else None
        # a piece that holds the first character of an added token takes the whole tokenizer
        risky = "".join({t["content"][0] for t in spec.get("added_tokens", [])})
        self.is_plain = regex.compile(f"[{_PLAIN}--[{regex.escape(risky)}]]+" if risky else f"[{_PLAIN}]+", regex.V1).fullmatch
        self.plain = "^[" + "".join(f"\\x{{{k:x}}}" for k in range(0x180) if self.is_plain(chr(k))) + "]+$"
        self.alphabet = byte_alphabet()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.short: dict[str, list[int]] = {}

    def _plain(self, piece: str) -> list[int]:
        if piece.isalpha():
            low = piece.lower()
            return [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet))]
        ids: list[int] = []
        for run in self.words.findall(piece.lower()):
            own = self.short.get(run)
            if own is None:
                mapped = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
                own = [t.id for t in self.tokenizer.model.tokenize(mapped)]
                if len(run) <= 3:
                    self.short[run] = own
            ids += own
        return ids

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of every word as bytes. Two generations of CACHE words each are kept; the older goes when the newer is full."""
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        new, old, slow, plain, tokenize = self.new, self.old, [], self.words is not None, self.tokenizer.model.tokenize
        for w in words:
            if w not in new:
                known = old.get(w)
                if known is None:
                    if plain and w.isascii() and w.isalpha():
                        known = array("I", [t.id for t in tokenize(w.lower())]).tobytes()
                    elif plain and self.is_plain(w):
                        known = array("I", self._plain(w)).tobytes()
                    else:
                        slow.append(w)
                        continue
                new[w] = known
        for w, e in zip(slow, self.tokenizer.encode_batch_fast(slow, add_special_tokens=False) if slow else [], strict=True):
            new[w] = array("I", e.ids).tobytes()
        return [new[w] for w in words]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after the other, and each piece's count.

        A plain piece goes by way of its lower-case word without the marks at its end, which are a word of their own after a letter.
        """
        if self.words:
            word = pc.utf8_rtrim(pc.utf8_lower(pieces), characters=_MARKS)
            split = pc.and_(pc.match_substring_regex(pieces, self.plain), pc.match_substring_regex(word, r"\pL$"))
            marks = pc.if_else(split, pc.replace_substring_regex(pieces, r"^.*\pL", ""), "").dictionary_encode()
            words = pc.if_else(split, word, pieces).dictionary_encode()
        else:
            words, marks = pieces.dictionary_encode(), pc.if_else(pc.is_valid(pieces), "", pieces).dictionary_encode()
        own = self._known(words.dictionary.to_pylist())
        tails = self._known(marks.dictionary.to_pylist())
        codes = np.empty(2 * len(pieces), np.int64)
        codes[0::2] = words.indices.to_numpy(zero_copy_only=False)
        codes[1::2] = marks.indices.to_numpy(zero_copy_only=False)
        codes[1::2] += len(own)
        own += tails
        flat, per = _spread(np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4, codes)
        return flat, per[0::2] + per[1::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and each text's count, with the end id after each."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        body, per = _spread(*self.pieces(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        edges = np.asarray(lists.offsets.to_numpy(), np.int64) - lists.offsets[0].as_py()
        upto = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])[edges]
        counts = np.diff(upto)
        out = np.insert(body, upto[1:], END_ID)
        return out.astype("<u4", copy=False), counts + 1


def _spread(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat`, of the given sizes, in the order of `codes`, and the size of each."""
    per = sizes[codes]
    total = int(per.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    ends = np.cumsum(per, dtype=kind)
    at = np.repeat(((np.cumsum(sizes) - sizes).astype(kind)[codes] - ends + per).astype(kind), per)
    at += np.arange(total, dtype=kind)
    return flat[at], per


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_CHUNK = "part int, chunk int, n_ids int, kind string, crc32 long, planes array<binary>"
_INDEX = "ord int, doc_id {id}, first long, n_tokens long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", block: int = BLOCK) -> None:
    """Encode every text and write the two tables below `path`."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), spark.sparkContext.defaultParallelism if total > (4 << 20) else 1)
    keyed = own.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(int(parts), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    kind_of_id = own.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        left, chunk, first, order = np.zeros(0, "<u4"), 0, 0, 0
        code = encoder(tokenizer)

        def chunks(ids: list[np.ndarray], from_: int) -> pa.RecordBatch:
            rows = [(part, from_ + k, len(x), kind, zlib.crc32(x.tobytes()), to_planes(x, kind), None, None, (from_ + k) * block, None) for k, x in enumerate(ids)]
            return _batch(rows, batch_type)

        batch_type = None
        for batch in batches:
            batch_type = batch_type or batch.schema.field(0).type
            for some in _slices(batch):
                ids, counts = code.encode(some.column(1))
                starts = first + np.cumsum(counts) - counts
                n = len(counts)
                nulls = lambda t: pa.nulls(n, t)
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, part, np.int32)), nulls(pa.int32()), nulls(pa.int32()), nulls(pa.string()), nulls(pa.int64()), nulls(pa.list_(pa.binary())),
                        pa.array(np.arange(order, order + n, dtype=np.int32)), some.column(0), pa.array(starts), pa.array(counts),
                    ],
                    names=_NAMES,
                )
                first += int(counts.sum())
                order += n
                left = np.concatenate([left, ids])
                full = len(left) // block
                if full:
                    yield chunks([left[k * block : (k + 1) * block] for k in range(full)], chunk)
                    chunk += full
                    left = left[full * block :].copy()
        if len(left):
            yield chunks([left], chunk)

    schema = f"{_CHUNK}, {_INDEX.format(id=kind_of_id.simpleString())}"
    made = ordered.mapInArrow(run, schema)
    made.withColumn("table", F.when(F.col("ord").isNull(), "chunks").otherwise("index")).write.partitionBy("table").option("compression", "snappy").parquet(path)


_NAMES = ["part", "chunk", "n_ids", "kind", "crc32", "planes", "ord", "doc_id", "first", "n_tokens"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of up to SLICE_BYTES of text each, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.int32(), id_type, pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _stored(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    # with a schema, an empty archive can be read as well
    return spark.read.schema(f"{_CHUNK}, {_INDEX.format(id=id_type)}, table string").parquet(path)


def chunk_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per chunk: part, number, first id in the whole stream, count and bytes; no plane is decompressed."""
    chunks = _stored(spark, path, id_type).where("table = 'chunks'")
    size = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    own = chunks.select("part", "chunk", "n_ids", "kind", size.alias("bytes"), "first")
    return own.join(F.broadcast(_part_starts(spark, path, id_type)), "part").withColumn("first", F.col("first") + F.col("part_start")).drop("part_start")


def _part_starts(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """(part, ids before it): a row per part, of which there is one for PART_BYTES of text."""
    totals = _stored(spark, path, id_type).where("table = 'index'").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) of every document, from the files: `ids` is little-endian uint32."""
    # a part's chunks and documents by their first id: a document follows the chunk in which it begins, and waits for the one in which it ends
    rows = _stored(spark, path, id_type).drop("table").repartition("part").sortWithinPartitions("part", "first", F.col("ord").isNotNull())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, base, part = b"", 0, None  # the bytes of the decoded ids that documents may still ask for, and where they begin
        waiting: deque = deque()
        for batch in batches:
            done, size = [], 0
            columns = [batch.column(c).to_pylist() for c in ("part", "ord", "doc_id", "first", "n_tokens", "n_ids", "kind", "crc32")]
            planes = batch.column("planes")
            for k, (own, order, doc, first, n, n_ids, kind, crc) in enumerate(zip(*columns, strict=True)):
                if own != part:
                    if waiting:
                        raise ValueError("a part ends before its last document")
                    raw, base, part = b"", 0, own
                if order is not None:
                    waiting.append((own, doc, first, n))
                else:
                    ids = from_planes(planes[k].as_py(), n_ids, kind).tobytes()
                    if zlib.crc32(ids) != crc:
                        raise ValueError("a chunk does not match its checksum")
                    if base + len(raw) // 4 != first:
                        raise ValueError("a chunk is missing")
                    keep = waiting[0][2] if waiting else first
                    raw, base = raw[(keep - base) * 4 :] + ids, keep
                while waiting and waiting[0][2] + waiting[0][3] <= base + len(raw) // 4:
                    at, doc, first, n = waiting.popleft()
                    done.append((at, doc, first, raw[(first - base) * 4 : (first + n - base) * 4]))
                    size += n * 4
                    if size >= OUT_BYTES:
                        yield _documents(done, batch.schema.field("doc_id").type)
                        done, size = [], 0
            if done:
                yield _documents(done, batch.schema.field("doc_id").type)
        if waiting:
            raise ValueError("a part ends before its last document")

    made = rows.mapInArrow(decode, f"part int, doc_id {id_type}, first long, ids binary")
    return made.join(F.broadcast(_part_starts(spark, path, id_type)), "part").select("doc_id", (F.col("part_start") + F.col("first")).alias("start"), "ids")


def _documents(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), id_type, pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "doc_id", "first", "ids"])


def op2_token_planes(docs: DataFrame, tokenizer: str, kind: str = "byte") -> DataFrame:
    """Write, read back, and return per document where its ids start, their count and their checksum."""
    scratch = Scratch(docs.sparkSession, "planes")
    path = scratch.path("tokens")
    write_tokens(docs, path, tokenizer, kind=kind)
    back = read_tokens(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
