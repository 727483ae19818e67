"""The pipeline against brute force, and the registered queries against their SQL."""

import duckdb
import pytest
import test_decontam
import test_mixing
import test_ngram_join
import test_quality
from cases import documents, prose, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from rankfold.llm import quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small_dir, name):
    got = queries.QUERIES[name](spark, small_dir).toPandas()
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    expected = db.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a = sorted(got[sorted(got.columns)].round(6).itertuples(index=False, name=None))
    assert a == sorted(expected[sorted(got.columns)].round(6).itertuples(index=False, name=None))


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    item = prose(777, 30)
    clean = [(i, prose(i, 100 + i), f"s{i % 2}") for i in range(40)]
    copies = [(100 + i, clean[i][1], "s1") for i in range(10)]
    leaks = [(200 + i, prose(300 + i, 60) + " " + item + " " + prose(400 + i, 60), "s0") for i in range(5)]
    junk = [(300, "short", "s0"), (301, None, None), (302, "### " * 200, "s1")]
    documents(spark, clean + copies + leaks + junk).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    expected = {d for d, *_ in clean}
    assert left[0] == expected | {d for d, *_ in copies + leaks}
    assert left[1] == expected | {d for d, *_ in leaks}
    assert left[2] == expected and left[3] <= expected
    sizes = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert all(r.last == r.n - 1 for r in sizes) and max(r.n for r in sizes) - min(r.n for r in sizes) <= 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    assert shingles(item)


def test_empty_documents_pass_through(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(1, 20))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def good(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = test_quality.brute(text)
    text = text or ""
    stop = {w for words in quality.STOP_WORDS.values() for w in words.split()}
    metrics = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "n_marks": text.count("!") + text.count("?"), "n_stop_words": sum(w.lower() in stop for w in test_quality.words(text)),
        "n_lines": sum(bool(test_quality.words(x)) for x in text.split("\n")),
    }
    for r in quality.RULES:
        top, bottom = 100 * metrics[r.numerator], metrics[r.denominator] if r.denominator else 1
        if (r.low is not None and top < bottom * r.low) or (r.high is not None and top > bottom * r.high):
            return False
    return True


def test_run_equals_brute_force_on_the_given_documents(spark, small_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if good(r[1])]
    classes = {doc_id: klass for doc_id, klass, _ in test_ngram_join.brute(rows)}
    rows = [r for r in rows if classes[str(r[0])] == str(r[0])]
    leaking = {d for d, *_ in test_decontam.brute(rows, items)}
    rows = [r for r in rows if str(r[0]) not in leaking]
    taken, _, _ = test_mixing.brute(rows)
    expected = sorted((d, 1) for d, n, total in taken if n for _ in range(total // n))
    got = corpus_pipeline.run(spark, small_dir).collect()
    assert sorted((str(r.doc_id), 1) for r in got) == expected and expected
    slots = sorted((r.shard, r.slot) for r in got)
    assert slots == sorted((p % corpus_pipeline.SHARDS, p // corpus_pipeline.SHARDS) for p in range(len(got)))
