"""Small inputs for the text operators, and brute-force helpers."""

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size int, row bigint, bucket string, _keep int, _row int"


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def prose(seed, n):
    r = random.Random(seed)
    stop = ["the", "of", "and", "to", "in", "is", "de", "la", "und", "die"]
    return " ".join(r.choice(stop) if r.random() < 0.3 else "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(3, 8))) for _ in range(n))


def documents(spark: SparkSession, rows) -> DataFrame:
    """Rows (doc_id, text[, source]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None, "x", 1, 2, None, 3, 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    """Null, empty and blank texts, a long one, copies, a near copy, repeated rows, null ids."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, base, "s1"), (7, base, "s1"), (8, " ".join(near), None),
        (9, prose(2, 30_000), "s1"), (10, prose(3, 80)), (10, prose(3, 80)), (11, "a " * 400), (None, prose(4, 90)), (None, base),
        (12, "Zeile eins\nZeile eins\n\nénorme « texte »   \U0001f600 fin"), (13, "x" * 20_000),
    ]
