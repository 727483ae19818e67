import random

from cases import awkward, documents, prose, shingles

from rankfold.llm import ngram_join, textops


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None and sets[i]:
            classes[root(i)] = min(classes.get(root(i), doc_id), doc_id)
    return sorted(
        (str(d), str(classes.get(root(i)) if sets[i] else d), links[i]) for i, (d, *_) in enumerate(rows)
    )


def check(spark, rows):
    got = ngram_join.ngram_join(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(rows)


def test_awkward_documents(spark):
    check(spark, awkward())


def test_large_group_spans_several_blocks(spark):
    r = random.Random(5)
    base = prose(9, 150).split(" ")
    rows = []
    for i in range(2 * ngram_join.BLOCK_NODES + 30):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows + [(5000 + i, prose(100 + i, 60)) for i in range(20)])


def test_texts_under_one_template_are_no_group():
    """4,000 different texts of 100 words over a common footer of 80: few pairs share a band."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    footer = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(100)) + " " + footer for _ in range(4000)]
    bands, rows = textops.band_count(0.8, ngram_join.RECALL, ngram_join.NOISE * 0.8, ngram_join.NOISE_SHARE)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text_key", "text"])
    keys = np.concatenate([np.array(b.column("bands").to_pylist()) for b in ngram_join._signatures(5, bands, rows)(iter([batch]))])
    shared = sum(ngram_join.candidates(keys[i : i + 500], keys[j : j + 500], i == j).sum() // (2 if i == j else 1) for i in range(0, 4000, 500) for j in range(i, 4000, 500))
    assert shared < 20_000 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_empty_table(spark):
    assert ngram_join.ngram_join(documents(spark, [])).count() == 0
    assert ngram_join.one_of_each_class(documents(spark, [])).count() == 0


def test_one_row_of_each_class_stays(spark):
    docs = documents(spark, awkward())
    kept = ngram_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    # 7, 8 and one null row copy 6; one of the two rows 10 stays; rows without words all stay
    assert ids == sorted(["1", "2", "3", "4", "5", "6", "9", "10", "11", "12", "13", "None"])


def test_classes_of_null_and_repeated_ids_stay_apart(spark):
    copied = prose(50, 90)
    rows = [(None, prose(51, 90)), (None, prose(52, 90)), (None, copied), (None, copied), (7, prose(53, 90)), (7, prose(54, 90)), (8, prose(53, 90))]
    kept = ngram_join.one_of_each_class(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(d), t) for d, t in {*rows[:3], *rows[4:6]})


def test_banding_reaches_the_recall():
    bands, rows = textops.band_count(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
