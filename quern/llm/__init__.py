"""Training-data operators. Nothing outside this folder and corpus_pipeline.py imports it."""
