import math
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, documents, prose, words

from rankfold.llm import katz

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def model(texts, order):
    """(unigram counts, p(word, history), followers by context, unknown) from the definitions."""
    grams = [Counter(), Counter(), Counter()]
    for t in texts:
        padded = ["<s>", *t]
        grams[0].update(t)
        grams[1].update(zip(padded, t, strict=False))
        grams[2].update(zip(padded, t, t[1:], strict=False))

    def discounts(counts):
        n = Counter(counts.values())
        common = 6 * n[6] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, 6):
            ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            d = (ratio - common) / (1 - common) if common < 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    one = grams[0]
    d = [discounts(g) for g in grams]
    total = sum(one.values()) + (not one or min(one.values()) > 5)
    p1 = {w: d[0].get(c, 1) * c / total for w, c in one.items()}
    unknown = 1 - math.fsum(p1.values())
    followers = defaultdict(dict)
    for level in (1, 2):
        for gram, c in grams[level].items():
            followers[gram[:-1]][gram[-1]] = c
    size = {h: sum(f.values()) + (0 if min(f.values()) <= 5 else 1) for h, f in followers.items()}
    memo = {}

    def seen(h, w):
        return d[len(h)].get(followers[h][w], 1) * followers[h][w] / size[h]

    def alpha(h):
        if h not in memo:
            f = followers[h]
            memo[h] = (1 - math.fsum(seen(h, w) for w in f)) / (1 - math.fsum(p(h[1:], w) for w in f))
        return memo[h]

    def p(h, w):
        h = h[-(order - 1) :] if h else h
        if not h:
            return p1.get(w, unknown)
        if h not in followers:
            return p(h[1:], w)
        return seen(h, w) if w in followers[h] else alpha(h) * p(h[1:], w)

    return one, p, followers, unknown


def log_score(p, text):
    padded = ["<s>", *text]
    return sum(math.log10(p(tuple(padded[max(i - 1, 0) : i + 1]), w)) for i, w in enumerate(text))


@pytest.mark.parametrize(("small", "order"), [(True, 2), (False, 2), (True, 3), (False, 3)])
def test_scores_match_brute_force(spark, monkeypatch, small, order):
    if small:
        monkeypatch.setattr(katz, "BATCH_BYTES", 4000)
        monkeypatch.setattr(katz, "BUCKET_BYTES", 8000)
    rows = awkward() + [(100 + i, " ".join(["Hot word"] * (i % 7)) + " " + prose(i % 40, 20)) for i in range(90)]
    # held-out texts alone hold some words, and some contexts stand in one batch of training texts only
    rows += [(400 + i, f"the hot word w{i % 5} and the w{i % 3} of the hot and the") for i in range(60)]
    texts = [(d, [*words((t or "").translate(LOWER)), "\n"]) for d, t, *_ in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    one, p, followers, _ = model([w for d, w in texts if not held(d)], order)
    n, v = sum(one.values()), len(one)
    known = [h for h in followers if len(h) < order]
    for h in known[:150] + known[-150:]:  # the probabilities after a context sum to one
        assert math.fsum(p(h, w) for w in one) + p(h, "\r") == pytest.approx(1, abs=1e-9)
    expected = sorted(
        (str(d), held(d), len(w), sum(x in one for x in w), n, round(sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4), round(log_score(p, w), 4))
        for d, w in texts
    )
    got = katz.score_texts(documents(spark, rows).repartition(3), order).collect()
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-4)


@pytest.mark.parametrize("order", [2, 3])
def test_repeated_texts_leave_something_for_unknown_words(spark, order):
    rows = [(i, "one text again") for i in range(60)] + [(1000 + i, f"unknown word{i} here one text") for i in range(60)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    rows = [(d, t) for d, t in rows if d < 1000 or held(d)]
    texts = [(d, [*words(t), "\n"]) for d, t in rows]
    one, p, _, unknown = model([w for d, w in texts if not held(d)], order)
    assert min(one.values()) > 5 and unknown > 0
    got = {r.doc_id: r.score for r in katz.score_texts(documents(spark, rows), order).collect()}
    for d, w in texts:
        assert got[d] == pytest.approx(log_score(p, w), abs=1e-6)


def test_empty_table_and_no_training_texts(spark):
    assert katz.score_texts(documents(spark, [])).count() == 0
    only_held_out = [(None, "a b"), (None, None)]
    for r in katz.score_texts(documents(spark, only_held_out)).collect():
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0 and r.base_score == 0.0
