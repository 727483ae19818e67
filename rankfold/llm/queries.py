"""One query per operator over its whole table, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import chat, decontam, dialogue_repair, html_text, katz, lexical, mixing, ngram_join, packing, pii, quality, repeats, sharding

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every document (five-word shingles, Jaccard 0.8 or more)."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only these columns, so that no further one can clash with the measures
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    return judged.select(
        "doc_id", *[F.col(f"_q_{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"), (~base_failed & F.col("_q_kept")).alias("kept"),
    )


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256"
    )


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted as a prefix tree and read back from it."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(*chat.prefix_tree(rows))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a test item's five-word shingles."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the contract's damage."""
    rows = _table(spark, sf_dir, "conversations")
    return dialogue_repair.report(dialogue_repair.damage(rows), rows)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packing.pack(cut)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_source_mixing": op5_source_mixing,
    "op6_personal_data": op6_personal_data,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_katz_backoff": op8_katz_backoff,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_structure_repair": op12_structure_repair,
    "op13_best_fit_packing": op13_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}

_STOP = ", ".join("'" + w + "'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words.split()}))



def _rules_sql() -> str:
    parts = []
    for r in quality.RULES:
        bottom = r.denominator or "1"
        if r.low is not None:
            parts.append(f"{r.numerator} * 100 >= {bottom} * {r.low}")
        if r.high is not None:
            parts.append(f"{r.numerator} * 100 <= {bottom} * {r.high}")
    return " AND ".join(parts)


_RULES_SQL = _rules_sql()

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g,
            unnest(range(1, len(w) - 1)) AS i FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^!?]+', '', 'g'))::BIGINT AS n_marks,
        len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  ({_RULES_SQL}) AS kept
FROM m
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size,
        CASE WHEN size = 0 THEN 10
             ELSE 10 - least(9, (10 * length(regexp_replace(text, '[^#*$%&|<>!?]+', '', 'g'))) // size) END AS level,
        ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), md5(text))), 1, 13))::BIGINT AS draw
      FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        1.0::DOUBLE + ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 AS weight
      FROM d GROUP BY source),
-- the largest scale at which the capped shares still sum to the total
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        row_number() OVER (ORDER BY source_size / weight, source) AS pos FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(source_size) OVER () AS total FROM o),
f AS (SELECT *, (total - capped) / open AS scale FROM c),
l AS (SELECT min(CASE WHEN weight * scale <= cap THEN pos END) AS first FROM f),
t AS (SELECT f.source, f.source_size,
        CASE WHEN f.pos < l.first THEN f.cap ELSE f.weight * (SELECT scale FROM f g WHERE g.pos = l.first) END AS target
      FROM f, l),
b AS (SELECT k.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY -ln((draw + 0.5) / 4503599627370496.0) / (level / 10.0), doc_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT item, item_id, t, count(*)::BIGINT AS times FROM (
        SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS t FROM benchmark)
      GROUP BY item, item_id, t),
p AS (SELECT row, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY row, doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
r AS (SELECT item, item_id, row, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM p JOIN w USING (t) JOIN q USING (t), s GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op5_source_mixing": OP5_SQL, "op11_lexical_search": OP11_SQL}
