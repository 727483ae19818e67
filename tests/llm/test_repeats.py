import hashlib
import random

import numpy as np
import pytest
from cases import awkward, documents, prose

from rankfold.llm import repeats


def brute(rows):
    first = {}
    for d, t, *_ in rows:
        b, key = (t or "").encode(), (d is None, d or 0)
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key), key)
    out = []
    for d, t, *_ in rows:
        b, key = (t or "").encode(), (d is None, d or 0)
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key:
                gone[p : p + 50] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shared_passages():
    r = random.Random(3)
    passages = [prose(70 + i, 12) for i in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(1000 + i, r.randint(1, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randint(30, 90)], prose(2000 + i, r.randint(1, 4))]
        rows.append((r.randrange(90), "".join(parts)))
    return rows + [(200, "ab" * 400), (201, "ab" * 30), (202, "a" * 300), (203, "b" + "ab" * 60), (None, passages[0]), (None, passages[0])]


@pytest.mark.parametrize("small", [True, False])
def test_removed_bytes_match_brute_force(spark, monkeypatch, small):
    if small:  # many batches, buckets and pieces
        monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
        monkeypatch.setattr(repeats, "RUN_BUCKET_BYTES", 900)
        monkeypatch.setattr(repeats, "PIECE", 128)
        monkeypatch.setattr(repeats, "HOT_RUNS", 5)
    rows = awkward() + shared_passages()
    got = repeats.remove_repeats(documents(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


@pytest.mark.parametrize("hot_runs", [20, 4096])
def test_a_line_in_thousands_of_surroundings(spark, monkeypatch, hot_runs):
    """An anchor whose runs are all different, with some equal windows among them."""
    monkeypatch.setattr(repeats, "HOT_RUNS", hot_runs)
    r = random.Random(6)
    line = "a line of twenty-five bytes and eleven more"
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    sides = [(word() + " " + word(), word() + " " + word()) for _ in range(2500)]
    rows = [(i, f"{word()} {a} {line} {b} {word()}") for i, (a, b) in enumerate(sides)]
    rows += [(3000 + i, f"{word()} {sides[i][0]} {line} {sides[i][1]} {word()}") for i in range(0, 2500, 50)]
    got = repeats.remove_repeats(documents(spark, rows).repartition(4), keep_text=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows)
    assert sum(r.n_removed > 0 for r in got) >= 50


def test_hot_anchors_deal_their_windows_one_by_one():
    r = random.Random(7)
    line = b"0123456789abcdefghijklmnopqrstuvwxyz"
    docs = [bytes(r.choices(b"ABCDEFGH", k=40)) + line + bytes(r.choices(b"ABCDEFGH", k=40)) for _ in range(200)]
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, len(docs[0]))
    anchor, _, count, _, _ = repeats.anchor_runs(data, offsets)
    values, n = np.unique(anchor >> np.uint64(16), return_counts=True)
    hot = values[n > 100]
    assert len(hot)
    row = {"anchors": [], "hot": [repeats._six_bytes(hot)]}
    s = repeats._surviving(row, data, offsets)
    assert (s["count"] == 1).all() and len(np.unique(s["anchor"])) > 0.9 * len(s["anchor"])
    for at, key in zip(s["start"][:50], s["anchor"][:50], strict=True):
        assert repeats.window_hashes(data, np.array([at]))[0] >> np.uint64(16) == key


def test_colliding_hashes_are_told_apart(monkeypatch):
    data = np.frombuffer((prose(1, 40) + prose(1, 40) + prose(2, 40)).encode(), dtype=np.uint8)
    starts = np.arange(len(data) - 49)
    monkeypatch.setattr(repeats.X, "mix", lambda x: x & np.uint64(3))
    order, firsts = repeats.group_windows(data, starts)
    groups = np.split(order, firsts[1:])
    seen = set()
    for g in groups:
        contents = {data[s : s + 50].tobytes() for s in starts[g]}
        assert len(contents) == 1 and not contents & seen
        seen |= contents


def test_empty_table(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
