"""Subword counts by a trained vocabulary, loaded once per worker and applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: Bytes of text that are encoded at a time; a longer text is encoded alone.
ENCODED_BYTES = 1 << 20


@cache
def _counter(path: str, pattern: str | None):
    """A function from texts to their numbers of tokens; special tokens in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    if path.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def subword_counts(docs: DataFrame, key: str, text: str, path: str, pattern: str | None = None) -> DataFrame:
    """(key, characters, words, tokens, tokens_per_word) of whole texts; a null counts as empty, and a text without words has 0 tokens a word.

    `path` names a vocabulary that every worker can read: `.tiktoken` ranks (with the `pattern` that cuts texts), a `.json` tokenizer, or a
    sentencepiece model. Repeated rows are counted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, pattern)
        for batch in batches:
            found, held, size = [], [], 0
            for x in batch.column(1).to_pylist():
                held.append(x)
                size += len(x)
                if size >= ENCODED_BYTES:
                    found += count(held)
                    held, size = [], 0
            found += count(held) if held else []
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["row", "tokens"])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.struct(F.col(key).alias("k"), F.length(whole).cast("long").alias("characters"), F.size(T.words(whole)).cast("long").alias("words"))
    rows = docs.select(own.alias("row"), whole.alias("t"))
    counted = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, tokens long")
    ratio = F.when(F.col("row.words") > 0, F.col("tokens") / F.col("row.words")).otherwise(0.0)
    return counted.select(F.col("row.k").alias(key), "row.characters", "row.words", "tokens", F.round(ratio, 6).alias("tokens_per_word"))
