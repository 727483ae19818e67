import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankfold.llm import dialogue_repair as D

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq bigint, edit string, copy int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else v
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def with_faults(rows):
    """Rows (turn, role, text) of one conversation in order, with their first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        word = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by whole strings for every prefix and state."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                new = cost + 3, audit + "I", [*out, name[due[state]] + ":"]
                if due[state] not in best or new[:2] < best[due[state]][:2]:
                    best[due[state]] = new
        return best

    best = {"": (0, "", [])}
    for _, role, text, fault in rows:
        found = {}

        def offer(state, *new):
            if state not in found or new[:2] < found[state][:2]:
                found[state] = new

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, cost + 4, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            for initial in ["u", "a"]:
                if due[state] == initial:
                    offer(initial, cost + 3 + more, audit + "R", [*out, f"{name[initial]}:{text}"])
            if role[:1] == due[state] or (state == "" and role[:1] == "s"):
                offer(role[:1], cost + more, audit + "K", [*out, f"{role}:{text}"])
        best = found
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def expected(conv, rows):
    rows = with_faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, out = cheapest(rows)
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == kind for *_, f in rows) for kind in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "u2"]
TEXTS = ["Yes.", "No!", "cut", "", " \n", "Really? ", "same.", "same."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS), st.integers(0, 5)), max_size=14))
def test_repair_matches_brute_force(picked):
    rows = [(i, role, text + str(k) if text == "Yes." else text) for i, (role, text, k) in enumerate(picked)]
    repair, edits = D.Repair(), []
    for row in with_faults(rows):
        edits += repair.row(*row)
    edits += repair.end()
    cost, audit, out = cheapest(with_faults(rows))
    assert "".join(e[0] for e in edits) == audit
    assert [f"{role}:{text}" for edit, _, role, text, _, _ in edits if edit != "D"] == out
    assert sum(D.COST[e[0]] + (3 if e[5] == "truncated" and e[0] != "D" else 0) for e in edits) == cost


def test_memory_stays_bounded():
    r = random.Random(3)
    repair, emitted, most = D.Repair(), 0, 0
    for i in range(20_000):
        kind = r.random()
        role = ["user", "assistant"][i % 2] if kind < 0.8 else r.choice(ROLES)
        fault = r.choice([None, "blank", "duplicate", "truncated"]) if kind > 0.7 else None
        emitted += len(repair.row(i, role, f"text {i}.", fault))
        most = max(most, repair.unresolved)
    assert most < 60 and emitted + len(repair.end()) >= 20_000


def test_only_deleted_rows_do_not_hold_their_texts():
    repair = D.Repair()
    emitted = repair.row(0, "user", "", None)
    for i in range(2000):
        emitted += repair.row(i, "user", "x" * 1000, "duplicate")
    todo, held = [repair.root], 0
    while todo:
        node = todo.pop()
        held += len((node.row or (0, 0, None))[2] or "")
        todo += node.children
    assert held == 0
    assert "".join(e[0] for e in emitted + repair.end()) == "K" + "D" * 2000 + "I"


def conversations():
    r = random.Random(8)
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 9)):
            role = "system" if turn == 0 and r.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, r.choice(["Fine.", "Well", "Ask?", f"No {turn}!", "ok. \t", None])))
    rows += [(None, t, "user", "No id.") for t in range(4)] + [(500, None, "assistant", "No turn."), (500, None, None, "x."), (500, 7, "user", None), (500, 2, "user", "y" * 5000 + "?")]
    rows += [(501, None, None, None)] + [(502, 0, "user", "Same."), (502, 0, "user", "Same."), (502, -(2**62), "user", "a."), (502, 2**62, "assistant", "b.")]
    hot = [(900, t, r.choice(ROLES), f"Turn {r.randrange(700)}" + r.choice([".", "", "!"])) for t in range(3000)]
    return rows + hot


def in_order(rows, conv):
    own = [(t, role, text) for c, t, role, text in rows if c == conv]
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_report_matches_brute_force(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = D.report(D.damage(frame), frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    worse = damaged(rows)
    found = {r.conv_id: tuple(r) for r in got.collect()}
    assert len(found) == got.count() == len({r[0] for r in rows})
    for conv in found:
        assert found[conv] == expected(conv, in_order(worse, conv)), conv
    # at least one conversation has lost every row
    assert any(not in_order(worse, conv) for conv in found)


def test_edits_are_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Again?"), (2, 0, "assistant", "Hello!")]
    edits = D.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(e.conv_id, e.edit, e.turn, e.role, e.text, e.was, e.fault) for e in sorted(edits, key=lambda e: (e.conv_id, e.seq))] == [
        (1, "K", 0, "user", "Hi.", "user", None), (1, "D", 1, None, None, "user", "duplicate"), (1, "R", 2, "assistant", "Again?", "user", None),
        (2, "I", None, "user", "", None, None), (2, "K", 0, "assistant", "Hello!", "assistant", None),
    ]


@pytest.mark.parametrize("report", [D.report, D.repair])
def test_empty_table(spark, report):
    empty = spark.createDataFrame([], SCHEMA)
    assert report(empty).count() == 0 and report(empty, empty).count() == 0
    gone = report(empty, spark.createDataFrame([(3,), (3,), (None,)], "conv_id bigint"))
    assert gone.count() == 2
