"""Conversation repair against a table of cheapest edits, filled in plain Python over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from marlstone.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost double, `key` string, piece int"


def plain_damage(rows):
    """rows: (conv_id, turn, role, text). {conv_id: [(turn, role, text)]} after damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        kept.extend([(turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1))
    return out


def plain_answer(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:]))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def better(into, state, new):
        if state not in into or new[:2] < into[state][:2]:
            into[state] = new

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, left) in list(best.items()):
                better(best, due[state], (cost + 5, audit + "I", left + [name[due[state]] + ":"]))
        return best

    for k, (_, role, text) in enumerate(rows):
        new = {}
        for state, (cost, audit, left) in inserted(best).items():
            better(new, state, (cost + 2, audit + "D", left))
            if faults[k] in ("", "truncated"):
                extra = 5 if faults[k] else 0
                if role[:1] in after[state]:
                    better(new, after[state][role[:1]], (cost + extra, audit + "K", left + [f"{role}:{text}"]))
                better(new, due[state], (cost + 1 + extra, audit + "R", left + [f"{name[due[state]]}:{text}"]))
        best = new
    best = inserted(best)
    cost, audit, left = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def random_rows(seed, conversations_, most):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None])
            text = r.choice(["Yes.", "no", "", " \n", "What?", "Well!  ", "a. b", None, f"row {turn}."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


def in_order(rows):
    """Rows of one turn that differ would need a hash to be put in order; these tests keep one of each turn."""
    seen, out = set(), []
    for row in rows:
        if (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            out.append(row)
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "k", 3) for r in rows], SCHEMA)


def collected(df):
    found = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    return found


def expected(rows):
    return {conv: plain_answer(kept) for conv, kept in plain_damage(rows).items()}


def test_edits_are_the_cheapest_and_least(spark):
    rows = in_order(random_rows(1, 400, 12))
    assert collected(conversations.repaired(conversations.damaged(frame(spark, rows).repartition(5)))) == expected(rows)


def test_long_conversations_cross_blocks(spark):
    rows = in_order(random_rows(2, 6, 400))
    assert collected(conversations.repaired(conversations.damaged(frame(spark, rows)))) == expected(rows)


def test_pieces_give_the_same_answers(spark):
    """Small limits make long conversations pieces over tasks."""
    rows = in_order(random_rows(3, 12, 60) + [(100 + c, t, r, x) for c, t, r, x in random_rows(4, 3, 600)])
    assert collected(conversations.repaired(conversations.damaged(frame(spark, rows)), long=20)) == expected(rows)


def test_prices_are_exact_costs_from_every_state():
    r = random.Random(5)
    for _ in range(300):
        codes = [r.randrange(12) for _ in range(r.randint(1, 9))]
        exits = [r.randint(0, 17) for _ in range(4)]
        cost = {(len(codes), s): exits[s] for s in range(4)}
        for i in range(len(codes) - 1, -1, -1):
            for s in range(4):
                cost[i, s] = min(c + cost[i + 1, a] for c, _, step, a in conversations.ARCS[codes[i]][s] if step)
            for _ in range(3):
                for s in range(4):
                    cost[i, s] = min(cost[i, s], conversations.INSERT + cost[i, conversations.DUE[s]])
        price = conversations.auction(codes, exits, range(4))
        assert price[:4] == [cost[0, s] for s in range(4)]
        assert all(price[4 * i + s] <= cost[i, s] for i, s in cost)  # a dual solution


def test_odd_tables(spark):
    assert conversations.repaired(conversations.damaged(frame(spark, []))).collect() == []
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (-5, 3, "assistant", "x" * 300_000 + "."), (-5, 2**40, "user", "日本。"), (7, None, "user", "a."), (7, 1, "assistant", "b.")]
    assert collected(conversations.repaired(conversations.damaged(frame(spark, rows)))) == expected(rows)


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = collected(conversations.repaired(conversations.damaged(frame(spark, [(conv, 0, "user", "Hi.")]))))
    assert found == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repeated_rows_and_equal_turns(spark):
    """Repeats of a row are duplicates, wherever they stand among the rows of their turn."""
    rows = [(1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 6, "assistant", "Yes.")]
    for limit in (1, 100):
        assert collected(conversations.repaired(conversations.damaged(frame(spark, rows)), long=limit)) == expected(rows)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_over_whole_tables(spark, name):
    rows = sorted((tuple(r) for r in spark.read.parquet(f"/root/testdata/{name}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()), key=lambda x: x[:2])
    assert collected(conversations.query(spark, f"/root/testdata/{name}")) == expected(rows)
