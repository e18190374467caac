"""Every named query of the library and the SQL it is held against."""

from quern.plans import anchor_queries, assembly_queries, chunk_queries, corpus_queries, encoder_queries, layout_queries, link_queries, matrix_queries, retrieval_queries, salvage_queries, staged_queries, subword_queries, text_queries, tree_queries, verify_queries  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
