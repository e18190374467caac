"""Subword counts of whole texts, by document and by source."""

from __future__ import annotations

from quern.functions import subword as W
from quern.plans.registry import query

VOCABULARY = "byte_bpe_50k.tiktoken"


def _counts(t):
    import public_tokenizers

    return W.subword_counts(t("documents"), "doc_id", "text", str(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


@query("subword_counts", None)
def subword_counts(t):
    """No SQL form; tests hold it against the tokenizer."""
    return _counts(t)
