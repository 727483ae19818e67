"""rankfold — recommender analytics expressed as Spark DataFrame jobs.

Subpackages:
    sources    — table readers/writers (driver tables, CSV, Parquet, JSON logs, model tables)
    functions  — scalar column expressions (genre parsing, title year, score formatting ...)
    operators  — relational building blocks (k-core, dense ids, splits, recommenders,
                 ranking metrics, drift, request-log analytics)
    plans      — named end-to-end queries and their DuckDB oracle SQL
    streaming  — Structured Streaming variants of the log analytics
"""

from rankfold.session import build_session, checkpoint, ensure_checkpoint_dir

__version__ = "0.2.0"

__all__ = ["build_session", "checkpoint", "ensure_checkpoint_dir"]
