import hashlib
import math

import pytest
from cases import awkward, documents, prose, words

from rankfold.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return target | share
        target |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return target


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = brute_targets(sizes)
    taken = []
    for s, size in sizes.items():
        epochs = math.floor(target[s] / size) if size else 0
        rest, before, keyed = target[s] - epochs * size, 0, []
        for d, t, src in rows:
            if src == s:
                n = len(words(t))
                level = 10 if n == 0 else 10 - min(9, 10 * sum((t or "").count(c) for c in "#*$%&|<>!?") // n)
                text = hashlib.md5((t or "").encode()).hexdigest()
                u = int(hashlib.md5(f"17|{'' if d is None else d}|{text}".encode()).hexdigest()[:13], 16)
                keyed.append((-math.log((u + 0.5) / 2**52) / (level / 10), d, n))
        for _, d, n in sorted(keyed, key=lambda k: k[0]):
            taken.append((str(d), n, n * (epochs + (n > 0 and 2 * before + n <= 2 * rest))))
            before += n
    return sorted(taken), target, sizes


def cases():
    return [(d, t, s) for d, t, *x in awkward() for s in [x[0] if x else "s0"]] + [
        (100 + i, prose(i, 5 + i % 90), ["s0", "s1", "s2", "é", None][i * i % 5]) for i in range(700)
    ]


@pytest.mark.parametrize("bin_rows", [3, 256])
def test_takes_match_brute_force(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rows = cases()
    got = mixing.mix(documents(spark, rows)).collect()
    taken, target, sizes = brute(rows)
    assert sorted((str(r.doc_id), r.size, r.times * r.size) for r in got) == taken
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-9) and r.source_size == sizes[r.source] and r.times <= 3
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.times * r.size for r in mine) - target[s]) <= max(r.size for r in mine)


def test_the_mix_repeats_rows(spark):
    docs = documents(spark, cases())
    times = sorted((str(r.doc_id), r.times) for r in mixing.mix(docs).collect() if r.times)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[str(r.doc_id)] = count.get(str(r.doc_id), 0) + 1
    total = {}
    for d, n in times:
        total[d] = total.get(d, 0) + n
    assert count == total


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.times for r in mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_rows_with_nulls_in_other_columns_stay_apart(spark):
    text = "one two three"
    rows = [(1, text, None, "a"), (1, text, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mixed = [(r.lang, r.source) for r in mixing.mix_documents(docs).collect()]
    assert set(mixed) == {(None, "a"), ("a", None)}
    times = {r.source: r.times for r in mixing.mix(docs).collect()}
    assert mixed.count((None, "a")) == times["a"] and mixed.count(("a", None)) == times[None]
