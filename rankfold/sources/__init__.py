from rankfold.sources import tables
from rankfold.sources.tables import item_vectors, movies, ratings, request_log, table, tags

__all__ = ["tables", "table", "ratings", "movies", "tags", "item_vectors", "request_log"]
