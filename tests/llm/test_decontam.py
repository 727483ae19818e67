import pytest
from cases import awkward, documents, prose, shingles

from rankfold.llm import decontam


def brute(docs, items):
    out = []
    for d, t, *_ in docs:
        own = shingles(t)
        for i, x in items:
            item = shingles(x)
            if item and len(own & item) >= 0.8 * len(item):
                out.append((str(d), i, len(item), len(own & item)))
    return sorted(out, key=str)


def cases():
    items = [(i, prose(500 + i, n)) for i, n in enumerate([6, 9, 14, 25, 40, 70, 150])] + [(20, None), (21, ""), (22, "one two three"), (23, prose(9, 5))]
    hide = lambda i, text: prose(800 + i, 3000 + 37 * i) + " " + text + " " + prose(900 + i, 2500)
    docs = awkward() + [(100 + i, hide(i, t)) for i, t in items if t]
    for i, text in items[:7]:
        w = text.split(" ")
        docs.append((200 + i, hide(i, " ".join(w[: len(w) * 6 // 10]))))  # too little of it
        w.insert(len(w) // 2, "inserted")
        docs.append((300 + i, hide(i, " ".join(w))))
    return docs, items


@pytest.mark.parametrize("filter_bits", [1 << 17, 1 << 28])
def test_leaks_match_brute_force(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(decontam, "FILTER_BITS", filter_bits)
    docs, items = cases()
    items += [(3, items[4][1]), (3, items[4][1]), (None, items[2][1])]  # repeated and null ids
    bench = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id bigint, text string, item int, keys string, row int").repartition(3)
    got = decontam.leaks(documents(spark, docs), bench).collect()
    expected = brute(docs, items)
    assert sorted(((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in got), key=str) == expected
    leaking = {d for d, *_ in expected}
    kept = decontam.decontaminate(documents(spark, docs), bench)
    assert kept.columns == documents(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in docs if str(d) not in leaking)


def test_empty_tables(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.leaks(documents(spark, []), bench).count() == 0
    assert decontam.leaks(documents(spark, docs), bench.limit(0)).count() == 0
    assert decontam.decontaminate(documents(spark, docs), bench.limit(0)).count() == len(docs)
    assert decontam.leaks(documents(spark, docs), bench.where("item_id = 21")).count() == 0


def test_a_large_benchmark_of_short_items_stays_small():
    """80,000 items of five words: the filter keeps its size, and most windows of other texts fail it."""
    import numpy as np
    import pyarrow as pa

    from rankfold.llm import textops as X

    items = pa.array([f"item{i} word{i} of number{i} end{i}" for i in range(80_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(80_000)), pa.array(range(80_000)), items], names=["item", "item_id", "text"])
    keys = np.concatenate([b.column("keys").flatten().to_numpy() for b in decontam._item_sets(0.8, 0.9999, 5)(iter([batch]))]).view(X.U64)
    bits = int(np.clip(np.ceil(np.log2(len(keys) * decontam.BITS_PER_KEY)), 16, 28))
    words = np.zeros(1 << (bits - 6), dtype=X.U64)
    for place in decontam._places(keys, bits):
        np.bitwise_or.at(words, place >> X.U64(6), X.U64(1) << (place & X.U64(63)))
    known = decontam.Filter((1,), bits, words)
    assert words.nbytes <= 32 << 20 and known.passes(keys).all()
    assert known.passes(X.random_words(5, 1_000_000)).mean() < 0.001
