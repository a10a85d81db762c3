"""Training-data operators (chat formatting, dedup, decontamination, quality, PII, packing).

Nothing outside this folder, ``corpus_pipeline.py`` and the guard in ``__spark_entry__.py``
imports it. ``registry.py`` lists the registered queries.
"""
