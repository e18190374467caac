"""Vectors of documents by a model fitted on them."""

from __future__ import annotations

from quern.operators import encoder as E
from quern.plans.registry import query


@query("corpus_vectors", None)
def corpus_vectors(t):
    """No SQL form; tests hold the model against a dense factorisation and the ranking against planted near texts."""
    return E.encode_corpus(t("documents"), "doc_id", "text")
