"""Repair of conversations: edits against a search over all of them, faults and replay against plain Python."""

import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import repair

OF = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def legal(roles):
    return GOOD.fullmatch(roles) is not None


def search(signature):
    """(cost, audit) by trying edits in order of (cost, audit); roles are checked only at the end."""
    n = len(signature)
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, roles = heapq.heappop(queue)
        if (i, roles, audit) in seen or len(roles) > n + 4:
            continue
        seen.add((i, roles, audit))
        if i == n and legal(roles):
            return cost, audit
        for role in "ua":
            heapq.heappush(queue, (cost + 3, audit + "I", i, roles + role))
        if i < n:
            symbol = signature[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles))
            if symbol != "-":
                stays = 3 * symbol.isupper()
                heapq.heappush(queue, (cost + stays, audit + "K", i + 1, roles + symbol.lower()))
                for role in "ua":
                    heapq.heappush(queue, (cost + stays + 3, audit + "R", i + 1, roles + role))


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_short_signatures_against_a_search(length):
    symbols = "suaxSUAX-" if length < 3 else "suaxSA-"
    for signature in map("".join, itertools.product(symbols, repeat=length)):
        assert repair.cheapest(signature) == search(signature), signature


@settings(max_examples=60, deadline=None)
@given(st.text("suaxUA-", min_size=4, max_size=6))
def test_longer_signatures_against_a_search(signature):
    assert repair.cheapest(signature) == search(signature)


@settings(max_examples=100, deadline=None)
@given(st.text("suaxSUAX-", max_size=40))
def test_plans_give_legal_roles(signature):
    cost, audit = repair.cheapest(signature)
    plan = repair.plan_of(signature, audit)
    assert legal("".join(role[0] if role else signature[row].lower() for row, role in plan))
    assert [row for row, _ in plan if row >= 0] == sorted({row for row, _ in plan if row >= 0}) and len(audit.replace("I", "")) == len(signature)
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    assert cost == sum(price[e] for e in audit) + 3 * sum(row >= 0 and signature[row].isupper() for row, _ in plan)


def test_a_very_long_signature():
    cost, audit = repair.cheapest("ua" * 30_000 + "u")
    assert (cost, audit[-1], len(audit)) == (3, "I", 60_002)


WHITE = " \t\n\v\f\r"


def faults(turns):
    """First faults of (turn, role, text) in order, and the counts."""
    found, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(WHITE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    signature = "".join("-" if f in ("blank", "duplicate") else (lambda r: r.upper() if f else r)(t[1][:1] if t[1][:1] in ("s", "u", "a") else "x") for f, t in zip(found, turns))
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, signature


def damage(rows):
    """{conv_id: turns after damage, in order}."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        own, kind = out.setdefault(conv, []), zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        one = (turn, "user" if kind == 4 else name(role), "" if kind == 1 else re.sub("[.!?]", "", name(text)) if kind == 2 else name(text))
        own += [one] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, t in out.items()}


def expected(turns):
    *counts, signature = faults(turns)
    cost, audit = repair.cheapest(signature)
    lines = [(role or turns[row][1], turns[row][2] if row >= 0 else "") for row, role in repair.plan_of(signature, audit)]
    return (*counts, cost, audit, lines)


def got(frame):
    return [(r["conv_id"], (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], [(t["role"], t["text"]) for t in r["repaired"]])) for r in repair.repaired(frame).collect()]


def test_conversations_damaged_and_repaired(spark):
    rng = random.Random(5)
    texts = ["One.", "Two!", "cut off", "", " \n", "Three? ", "é. ", " ", "\u0085", None, "no end.\t", "x . y"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(None, None, "user", "a."), (None, 3, "user", "a."), (None, 3, "user", "a.")]
    frame = spark.createDataFrame(rows, OF).repartition(6)
    result = dict(got(repair.damaged(repair.conversations_of(frame))))
    assert result == {c: expected(t) for c, t in damage(rows).items()}
    assert any(not r[-1] for r in result.values())


def test_conversations_as_they_are(spark):
    """Ties of a turn, repeated rows, a conversation without turns, no rows, a long text."""
    rows = [(1, 0, "user", "q?"), (1, 0, "assistant", "a."), (1, 0, "assistant", "a."), (2, 5, "system", "S."), (2, 9, "user", "w " * 200_000 + "."), (3, None, "assistant", "hello")]
    lists = repair.conversations_of(spark.createDataFrame(rows, OF))
    result = dict(got(lists))
    assert result[1] == expected([(0, "assistant", "a."), (0, "assistant", "a."), (0, "user", "q?")]) and result[1][2] == 1
    assert result[2][0] == 3 and result[2][6] == "KKI" and result[2][7][-1] == ("assistant", "")
    assert result[3] == (0, 0, 0, 1, 0, 4, "D", [])
    none = spark.createDataFrame([(7, [])], f"conv_id long, turns {repair.TURNS}")
    assert got(none) == [(7, (0, 0, 0, 0, 0, 0, "", []))]
    assert got(lists.limit(0)) == []


def test_each_signature_is_solved_once(spark):
    """A third of all conversations share one signature; other columns may have any names."""
    rows = [(c, t, role, f"{c} {t}.", "x") for c in range(90) for t, role in enumerate(("user", "user") if c % 3 == 0 else ("user", "assistant"))]
    lists = repair.conversations_of(spark.createDataFrame(rows, OF + ", signature string"))
    result = got(lists)
    assert len(result) == 90 and {r[6] for c, r in result if c % 3 == 0} == {"KR"} and {r[5] for c, r in result if c % 3} == {0}
    assert repair.with_faults(lists).select("signature").distinct().count() == 2
