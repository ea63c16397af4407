"""Operators for training-data pipelines (deduplication, token counts, licence
scans, quality, decontamination, nearest neighbours, toxicity, packing).

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when it is present."""
