import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankfold.llm import packing
from rankfold.session import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, length):
    """The least number of bins, by trying every place for every item."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] if k == j else r for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, length - sizes[i]])

    place(0, [])
    return best


def check_bins(sizes, bins, length):
    assert sorted(i for items in bins for i in items) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) <= length for items in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_groups_against_brute_force(sizes):
    bins = packing.pack_group(sizes, 24)
    check_bins(sizes, bins, 24)
    used, best = sum(1 for b in bins if b), fewest(sizes, 24)
    assert packing.lower_bound(np.array(sizes), 24) <= best <= used <= best + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.randoms(use_true_random=False))
def test_search_increases_squared_fill(sizes, r):
    # a poor packing to start from: items in any order, next fit
    bins, order = [[]], list(range(len(sizes)))
    r.shuffle(order)
    for i in order:
        if sum(sizes[j] for j in bins[-1]) + sizes[i] > 40:
            bins.append([])
        bins[-1].append(i)
    squared = lambda bins: sum(sum(sizes[i] for i in items) ** 2 for items in bins)
    before, first = squared(bins), len(bins)
    search = packing.LocalSearch(sizes, [list(b) for b in bins], 40)
    search.run(packing.lower_bound(np.array(sizes), 40))
    check_bins(sizes, search.bins, 40)
    assert squared(search.bins) >= before and sum(1 for b in search.bins if b) <= first
    assert search.fill == [sum(sizes[i] for i in items) for items in search.bins]


@pytest.mark.parametrize(
    ("sizes", "bins"),
    [
        ([6, 4, 5], [[0], [1, 2]]),  # move: 4 beside 6
        ([7, 2, 5, 3, 3], [[0, 1], [2, 3], [4]]),  # one for one: 3 for 2
        ([6, 1, 1, 4, 4, 4], [[0, 1, 2], [3, 4], [5]]),  # one for two
    ],
)
def test_each_exchange_empties_a_bin(sizes, bins):
    search = packing.LocalSearch(sizes, bins, 10)
    search.run(2)
    check_bins(sizes, search.bins, 10)
    assert sum(1 for b in search.bins if b) == 2


def test_two_for_one_from_the_donor():
    # the emptiest bin gives 3 + 3 for 5
    sizes = [9, 5, 4, 3, 3]
    search = packing.LocalSearch(sizes, [[0], [1, 2], [3, 4]], 10)
    found = search._best(2)
    assert found is not None
    search._empty(2)
    check_bins(sizes, search.bins, 10)


def test_large_group_meets_the_bound():
    r = random.Random(1)
    sizes = [min(2047, max(1, int(r.lognormvariate(6.4, 0.9)) % 2048)) for _ in range(20_000)]
    used = sum(1 for b in packing.pack_group(sizes, 2048) if b)
    assert used <= packing.lower_bound(np.array(sizes), 2048) * 1.002


def rows(docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out = []
    for d, t, *_ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [7, 1 << 16])
def test_pack_documents(spark, group):
    docs = awkward() + [(200 + i, prose(i, 5 + 17 * i % 900)) for i in range(60)] + [(None, "<|endoftext|> x"), (None, None)]
    frame = documents(spark, docs).repartition(3)
    cut = packing.pieces(frame, PATH, keep_ids=False)
    packed = packing.pack(cut, group=group).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == rows(docs)
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    least = packing.lower_bound(np.array([r.length for r in packed]), 2048)
    assert len(at) <= least + (1 if group > 100 else 4)


def test_sequences_hold_the_tokens(spark):
    docs = awkward()
    cut = materialize(packing.pieces(documents(spark, docs), PATH), "cut")
    packed = materialize(packing.pack(cut), "placed")
    every = {r.sequence_id: r for r in packing.sequences(cut, packed).collect()}
    for r in packed.collect():
        held = every[r.sequence_id]
        assert r.offset in held.starts
        assert zlib.crc32(np.array(held.ids[r.offset : r.offset + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    assert sum(len(r.ids) for r in every.values()) == sum(r.length for r in packed.collect())


ODD = (
    "\n\n  two   blanks  \n" + "x" * 300 + " énorme « texte »  1234 56 7.8 it's we'll 're x\u00a0 y\u2003 z\u3000 \u00a0 \x1c a\x1f b \x85 c"
    "\u0085 d 日本 語 \U0001f600 \U0001f600 ñ à é\u0301 e <|endoftext|> Ж ж.  \t tab\t tab \r\n"
)


@functools.cache
def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def whole(text):
    return plain(PATH).encode(text, add_special_tokens=False).ids


def encoded(encoder, texts):
    ids, at = encoder(*packing.X.text_bytes(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_words_encode_like_whole_texts():
    encoder = packing.Encoder(PATH)
    texts = [ODD, "", prose(3, 300), " ", "a", " a", ODD + prose(4, 50) + ODD, None]
    assert encoder.in_words
    assert encoded(encoder, texts) == [whole(t or "") for t in texts]
    assert encoded(encoder, [None, ""]) == [[], []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\u00a0\u2003\x1caB1'.é日s<|", max_size=30), max_size=5))
def test_random_texts_encode_like_whole_texts(texts):
    assert encoded(ENCODER, [*texts, "x"]) == [whole(t) for t in [*texts, "x"]]


ENCODER = packing.Encoder(PATH)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    assert not encoder.in_words
    assert encoded(encoder, ["A b  c", "d"]) == [plain(path).encode(t, add_special_tokens=False).ids for t in ("A b  c", "d")]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(packing.X, "PIECE", 50)
    texts = ["short", prose(3, 300) + ODD + prose(4, 50), "", "y" * 400]
    data, offsets = packing.X.text_bytes(pa.array(texts))
    parts, owners = packing._parts(data, offsets, True)
    assert len(parts) > 20 and set(owners.tolist()) == {0, 1, 2, 3}
    ids, at = ENCODER(data, parts)
    for i, text in enumerate(texts):
        assert [t for p in np.flatnonzero(owners == i) for t in ids[at[p] : at[p + 1]].tolist()] == whole(text)


def test_empty_table(spark):
    found = packing.pack(packing.pieces(documents(spark, []), PATH, keep_ids=False))
    assert found.count() == 0 and found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
