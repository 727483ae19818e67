"""Operators for large text corpora: deduplication, filtering, sharding, extraction,
mixing, redaction, language-model scoring, chat formatting and decontamination.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per
operator; the pipeline is ``corpus_pipeline.py`` at the top of the repository.
"""
