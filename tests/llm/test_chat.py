import hashlib
import random

import pytest

from rankfold.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, path int"


def rows_of(conversations):
    return [(c, i, role, text, "x", 1) for c, turns in conversations for i, (role, text) in enumerate(turns)]


def cases():
    r = random.Random(2)
    start = [("user", "hi"), ("assistant", "hello | \\ <|end|>\n"), ("user", "more")]
    trap = r"\### Assistant: </turn> ok"
    out = [(-7, [("user", trap), ("assistant", trap)]), (0, start), (1, start[:1]), (2, start), (3, [("user", None), (None, "x"), ("assistant", "")]), (4, [("assistant", "é\U0001f600")])]
    for i in range(60):
        turns = start[: r.randint(0, 3)] + [(r.choice(["user", "assistant"]), r.choice(["a", "b", "c|", "\\"])) for _ in range(r.randint(1, 5))]
        out.append((10 + i, turns))
    out.append((200, [("user", "long " * 20_000), *[("assistant", str(i % 3)) for i in range(700)]]))
    return out


def digest(turns):
    whole = "".join(f"{a or ''}\n{t or ''}\n" for a, t in turns)
    learned = "".join(t or "" for a, t in turns if a == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_conversations_read_back_exactly(spark):
    data = cases()
    got = chat.read_back(*chat.prefix_tree(spark.createDataFrame(rows_of(data), SCHEMA).repartition(5))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: digest(t) for c, t in data}
    chars = {c: sum(len(chat.segment(a or "", t or "")[0]) for a, t in turns) for c, turns in data}
    assert {r.conv_id: r.formatted_chars for r in got} == chars


@pytest.mark.parametrize("layout", [1, 6])
def test_tree_shares_prefixes_and_attends_to_ancestors_only(spark, layout):
    data = cases()
    nodes, paths = chat.prefix_tree(spark.createDataFrame(rows_of(data), SCHEMA).repartition(layout))
    nodes = sorted(nodes.collect(), key=lambda n: n.start)
    prefixes = {tuple(map(tuple, turns[: i + 1])) for _, turns in data for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # every shared turn once
    at = 0
    for n in nodes:
        assert n.start == at and n.length == len(n.segment)
        at += n.length
    by_key = {bytes(n.node): n for n in nodes}
    below = 0
    for n in nodes:
        above, x = [], n
        while x.parent is not None:
            x = by_key[bytes(x.parent)]
            above.append((x.start, x.start + x.length))
        assert n.position == sum(b - a for a, b in above) and n.depth == len(above)
        merged = []
        for a, b in sorted(above):
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        assert [[i.start, i.end] for i in n.attends] == merged
        below += len(merged) > 1
    assert below  # some nodes skip a sibling's branch
    # depth first: a parent comes before its children, and subtrees are contiguous
    seen = []
    for n in nodes:
        while seen and (n.parent is None or seen[-1] != bytes(n.parent)):
            seen.pop()
        assert n.parent is None or seen
        seen.append(bytes(n.node))
    assert paths.count() == len(data)


def test_tokens_of_a_public_tokenizer(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    data = cases()[:4]
    nodes, _ = chat.prefix_tree(spark.createDataFrame(rows_of(data), SCHEMA), tokenizer_path=tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    for n in nodes.collect():
        assert n.length == len(n.tokens) and tokenizer.decode(n.tokens, skip_special_tokens=False) == n.segment


def test_escaping_is_reversible():
    for text in ("", "\\", "|", "<|end|>", "\\|", "\\\\||", "\n<|end|>\n", "x|>\n"):
        formatted, a, b = chat.segment("assistant", text)
        assert chat.read_segment(formatted) == ("assistant", text) and chat.unescape(formatted[a:b]) == text
    with pytest.raises(ValueError):
        chat.read_segment("<|user|>\na|b\n<|end|>\n")


def test_empty_table_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nodes, paths = chat.prefix_tree(empty)
    assert nodes.count() == 0 and chat.read_back(nodes, paths).count() == 0
    rows = [(None, None, "user", "b", "", 0), (None, 1, "user", "a", "", 0), (5, 0, "user", "q", "", 0), (5, 0, "user", "q", "", 0)]
    got = {r.conv_id: r for r in chat.read_back(*chat.prefix_tree(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[None].turns_sha256 == digest([("user", "b"), ("user", "a")])[1] and got[5].n_turns == 2
