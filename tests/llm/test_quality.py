from collections import Counter

from cases import awkward, documents, prose, words

from rankfold.llm import quality


def brute(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_metrics_match_brute_force(spark):
    rows = awkward() + [(20, "a b c a b c d"), (21, "l1\nl1\n \nl2 # <x>\nl1"), (22, "x y x y x y x")]
    got = quality.judge(documents(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r.doc_id), *[r["_q_" + n] for n in names]) for r in got) == sorted((str(d), *brute(t)) for d, t, *_ in rows)


def test_rules_reject_junk_and_keep_clean_text(spark):
    clean, stop = prose(7, 200), "the of and to in is for"
    junk = {
        "too_few_words": "the of and", "symbols": " ".join(f"{w}### and" for w in clean.split()), "shouting": " ".join(f"{w}!! and" for w in clean.split()),
        "stop_words": " ".join(f"zq{i}" for i in range(100)), "repeated_lines": "\n".join(["the same line of text"] * 40), "repeated_words": f"{stop} " * 30,
    }
    docs = documents(spark, [(0, clean), *[(i + 1, t) for i, t in enumerate(junk.values())]])
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[0]["_q_kept"] and not judged[0]["_q_failed"]
    for i, name in enumerate(junk):
        assert name in judged[i + 1]["_q_failed"], name
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_empty_table_and_name_clash(spark):
    docs = documents(spark, []).withColumnRenamed("node", "_q_words")
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
