import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, prose

from rankfold.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + 75 * c.total() * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def items():
    base = prose(1, 120).split(" ")
    return [
        (1, " ".join(base[:30])), (2, "THE of, and-The"), (3, None), (4, " ..."), (5, "énorme « TEXTE » Énorme\U0001f600"), (6, prose(3, 40)),
        (6, "x" * 20_000 + " a"), (None, "one two\x00three"), (8, "nowhere-to-be-found"), (9, prose(2, 3000)),
    ]


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.mark.parametrize("block_terms", [25, 200_000])
def test_search_matches_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    docs = awkward() + [(100 + i, prose(i % 40, 20 + i % 60)) for i in range(300)]
    queries = spark.createDataFrame([(i, t, i) for i, t in items()], "item_id bigint, text string, query bigint")
    assert rows(lexical.search(documents(spark, docs).repartition(5), queries)) == brute(docs, items())


def test_empty_tables(spark):
    queries = spark.createDataFrame(items(), "item_id bigint, text string")
    assert lexical.search(documents(spark, []), queries).count() == 0
    assert lexical.search(documents(spark, [(1, None), (2, " .")]), queries).count() == 0
    found = lexical.search(documents(spark, awkward()), queries.limit(0))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def local_index(docs, monkeypatch, **sizes):
    """The operator's own steps over one batch, with small segments and blocks."""
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    names = sorted({t for _, text, *_ in docs for t in terms(text)})
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs])], names=["doc_id", "text"])
    (forward,) = lexical._forward(SimpleNamespace(value=pa.array([n.encode() for n in names], pa.large_binary())))(iter([batch]))
    df = Counter(t for _, text, *_ in docs for t in set(terms(text)))
    n = sum(bool(terms(t)) for _, t, *_ in docs)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in names])
    stats = lexical.Statistics(n, int(sum(forward.column("n").to_pylist())), weights)
    return names, weights, [lexical._Segment(b.to_pylist()[0]) for b in lexical._index(SimpleNamespace(value=stats))(iter([forward]))]


def test_blocks_bound_their_members_and_skip(monkeypatch):
    # topics: each has its own words, all share the stop words
    r = random.Random(5)
    topics = [[f"t{i}w{j}" for j in range(30)] for i in range(12)]
    docs = [(i, " ".join(r.choices(topics[i % 12], k=25) + r.choices(["the", "of", "and", "common"], k=15))) for i in range(900)]
    names, weights, segments = local_index(docs, monkeypatch, SEGMENT=400, BLOCK=16, SHORT=4)
    assert [len(s.of) for s in segments] == [400, 400, 100]
    dense = np.zeros(len(names), dtype=np.int64)
    scored = 0
    for _ in range(20):
        text = " ".join(r.choices(topics[r.randrange(12)], k=6) + ["the", "common"])
        ids = np.array(sorted({names.index(t) for t in terms(text)}))
        times = np.array([terms(text).count(names[i]) for i in ids])
        dense[ids] = weights[ids] * times
        best = lexical._Best(10)
        for s in segments:
            for place in range(len(s.packed)):
                sizes, members, summary = s.list_of(place)
                assert sizes.sum() == len(members) and sorted(members) == sorted(set(members))
                if summary:
                    bounds = np.add.reduceat(dense[summary[0]] * summary[1], summary[2])
                    real = np.maximum.reduceat(s.scores(members, dense), np.cumsum(sizes) - sizes)
                    assert (bounds >= real).all()
            scored += lexical.probe(s, ids, dense[ids], dense, best)
        dense[:] = 0
        expected = brute(docs, [(0, text)])
        assert sorted(((0, i + 1, d, v) for i, (d, v) in enumerate(zip(best.ids.tolist(), best.score.tolist(), strict=True))), key=str) == expected
    assert scored < 0.5 * 20 * len(docs)


def test_many_copies_split_into_blocks(monkeypatch):
    docs = [(i, "same words in every copy") for i in range(300)] + [(1000 + i, f"same other{i}") for i in range(50)]
    names, weights, (segment,) = local_index(docs, monkeypatch, BLOCK=16, SHORT=4)
    sizes, members, _ = segment.list_of(segment.place[names.index("same")])
    assert sizes.max() <= 32 and len(members) == 350


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical.X, "PIECE", 64)
    text = "alpha beta gamma " * 50 + "x" * 500 + " alpha"
    names, _, (segment,) = local_index([(1, text), (2, "beta")], monkeypatch)
    assert names == ["alpha", "beta", "gamma", "x" * 500]
    assert segment.of.tolist() == [4, 1]
