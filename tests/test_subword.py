import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quern.functions import subword as W

TEXTS = [None, "", " ", "one  two\nthree", "größe naïve 𝒳 été", "<|endoftext|> <|startoftext|>", "a" * 5000, "1234567890 " * 300, " x　y", "Don't stop."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_tokenizers(spark, monkeypatch, name):
    import sentencepiece
    import tiktoken

    path = str(P.path(name))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1)] * 2, "doc_id long, text string, tokens int")
    got = W.subword_counts(df, "doc_id", "text", path, P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2 and [r.tokens for r in got if r.doc_id is None] == [1, 1]
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    elif name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(sp.encode(x))
    else:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = lambda x: len(own.encode_ordinary(x))
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            words = len(text.split())
            assert (r.characters, r.words, r.tokens) == (len(text), words, count(text)), text[:20]
            assert r.tokens_per_word == (round(r.tokens / words, 6) if words else 0)
    assert W.subword_counts(df.limit(0), "doc_id", "text", path, P.PATTERN).collect() == []


def test_both_forms_of_a_vocabulary_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (W.subword_counts(df, "doc_id", "text", str(P.path(n)), P.PATTERN) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    assert sorted(a.collect()) == sorted(b.collect())
