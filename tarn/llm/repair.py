"""Repair of conversation structure, solved once for each distinct signature.

A conversation's turns have roles and faults; texts matter no further. So each conversation becomes a
compact string, its signature: one character a turn, from the role's initial and the fault. Damaged
conversations share few signatures, so only the distinct ones are solved: a memoised recursion over (turn,
what the repaired conversation ends with so far) finds the cheapest edits that make the roles read
``(s?(ua)+)?``. The solutions are joined back by signature and replayed on the texts.

A conversation is one row, as its repaired form is one value; one reader must be able to hold it.

Edits and what they cost: keep (0), give the role user or assistant (3), delete (4), insert an empty turn of
the user or the assistant (3). Blank turns and repeats of an earlier turn must go; a truncated turn that
stays costs 3 more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.shared import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The roles that a repaired conversation gives.
GIVEN = {"u": "user", "a": "assistant"}
#: In a signature: a turn that must go, and a role that is no one of the three.
GOES, OTHER = "-", "x"
#: What may follow what the repaired conversation ends with: nothing yet, or a role.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
TURNS = "array<struct<turn:bigint,role:string,text:string>>"
_WHITE = r"\\x20\\x09-\\x0D"


def conversations_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (array of turn, role, text) by turn (nulls first), then role and text. A null role
    or text is one space; a null conv_id is a conversation of its own."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    each = F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    return rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults for tests, by the checksum of ``conv_id:turn`` (null: one space): a turn in twenty each is
    dropped, emptied, loses its ``.!?``, stands twice, or gets the role user. All of a conversation's turns
    may go."""
    kind = "crc32(encode(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(t.turn as string), ' ')), 'UTF-8')) % 20"
    text = "case k when 1 then '' when 2 then regexp_replace(t.text, '[.!?]', '') else t.text end"
    one = f"struct(t.turn as turn, if(k = 4, 'user', t.role) as role, {text} as text)"
    each = f"transform(array({kind}), k -> case k when 0 then cast(array() as {TURNS}) when 3 then array({one}, {one}) else array({one}) end)[0]"
    return conversations.withColumn("turns", F.expr(f"sort_array(flatten(transform(turns, t -> {each})))"))


def with_faults(conversations: DataFrame) -> DataFrame:
    """``conversations`` with signature and the counts gaps, blank, duplicate, truncated and illegal.

    The first fault of a turn counts: blank (no character that is not white space), duplicate (role and text
    of an earlier turn), truncated (the last such character is none of ``.!?``). Equal turns are found by
    sorting, not by comparing all."""
    # (role, text, place) in order: all but the first of equal ones repeat it; then back in order of place
    rows = conversations.withColumn("sorted", F.expr("sort_array(transform(turns, (t, i) -> struct(t.role as role, t.text as text, i as i)))"))
    again = "k > 0 and x.role = sorted[greatest(k - 1, 0)].role and x.text = sorted[greatest(k - 1, 0)].text"
    rows = rows.withColumn("again", F.expr(f"sort_array(transform(sorted, (x, k) -> struct(x.i as i, {again} as is_again)))")).drop("sorted")
    fault = f"case when not t.text rlike '[^{_WHITE}]' then 'blank' when again[i].is_again then 'duplicate' when t.text rlike '[^.!?{_WHITE}][{_WHITE}]*\\\\z' then 'truncated' else '' end"
    rows = rows.withColumn("faults", F.expr(f"transform(turns, (t, i) -> {fault})")).drop("again")
    rows = rows.withColumn("initials", F.expr("transform(turns, t -> substring(t.role, 1, 1))"))
    role = f"if(r in ('s', 'u', 'a'), r, '{OTHER}')"
    symbol = f"case faults[i] when 'blank' then '{GOES}' when 'duplicate' then '{GOES}' when 'truncated' then upper({role}) else {role} end"
    numbers = "array_distinct(filter(turns.turn, x -> x is not null))"
    made = {
        "gaps": f"coalesce(array_max({numbers}) - array_min({numbers}) + 1 - size({numbers}), 0L)",
        **{name: f"cast(size(filter(faults, f -> f = '{name}')) as long)" for name in ("blank", "duplicate", "truncated")},
        "illegal": "cast(size(filter(initials, (r, i) -> i > 0 and concat(initials[greatest(i - 1, 0)], r) not in ('su', 'ua', 'au'))) as long)",
        "signature": f"array_join(transform(initials, (r, i) -> {symbol}), '')",
    }
    return rows.withColumns({name: F.expr(of) for name, of in made.items()}).drop("faults", "initials")


def cheapest(signature: str) -> tuple[int, str]:
    """(cost, audit): the cheapest edits' initials, the least string of those that tie.

    Edits of one place have different initials, so ties are settled one edit at a time, and the recursion
    returns costs only. It is asked from the last turn on: what it needs is known by then, and it goes only a
    few calls deep however long the conversation is."""
    n = len(signature)

    @lru_cache(maxsize=None)
    def best(i: int, last: str, inserted: int) -> tuple[float, str, int, str]:
        """(cost, edit, next turn, next end) from turn i on. More than two insertions side by side only cost."""
        found = [(0.0, "", i, last)] if i == n and last in ("", "a") else []
        if i < n:
            symbol = signature[i]
            found.append((DELETE + best(i + 1, last, 0)[0], "D", i + 1, last))
            if symbol != GOES:
                stays = TRUNCATED * symbol.isupper()
                for role in NEXT[last]:
                    if symbol.lower() == role:
                        found.append((KEEP + stays + best(i + 1, role, 0)[0], "K", i + 1, role))
                    if role in GIVEN:
                        found.append((REROLE + stays + best(i + 1, role, 0)[0], "R", i + 1, role))
        if inserted < 2:
            role = NEXT[last][-1]
            found.append((INSERT + best(i, role, inserted + 1)[0], "I", i, role))
        return min(found, key=lambda x: x[:2]) if found else (float("inf"), "~", i, last)

    for i in range(n, -1, -1):
        for last in NEXT:
            best(i, last, 0)
    cost, audit, at = best(0, "", 0)[0], [], (0, "", 0)
    while (edit := best(*at))[1]:
        audit.append(edit[1])
        at = edit[2], edit[3], at[2] + 1 if edit[1] == "I" else 0
    return int(cost), "".join(audit)


def plan_of(signature: str, audit: str) -> list[tuple[int, str | None]]:
    """The repaired turns: (turn that it comes from or -1, role that it gets or None to keep its own)."""
    out: list[tuple[int, str | None]] = []
    row, last = 0, ""
    for edit in audit:
        if edit in "KRI":
            last = signature[row].lower() if edit == "K" else NEXT[last][-1]
            out.append((row if edit != "I" else -1, None if edit == "K" else GIVEN[last]))
        row += edit != "I"
    return out


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit and plan of each row of ``signatures``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(s, *cheapest(s)) for s in batch["signature"]]
            yield pd.DataFrame(
                {"signature": [f[0] for f in found], "cost": [f[1] for f in found], "audit": [f[2] for f in found], "plan": [[{"row": r, "role": role} for r, role in plan_of(f[0], f[2])] for f in found]}
            )

    return signatures.mapInPandas(work, "signature string, cost long, audit string, plan array<struct<row:int,role:string>>")


def repaired(conversations: DataFrame) -> DataFrame:
    """Repair conversations (conv_id, turns): conv_id, gaps, blank, duplicate, truncated, illegal (as long),
    cost, audit and repaired (array of role and text).

    A row for each row, also for a conversation without turns, which needs no edit. Turns are taken in the
    order of the array. ``gaps`` is how many numbers are missing between the least and the greatest turn
    (nulls aside). The conversations are written once, as signatures and replay both read them."""
    known = written(with_faults(conversations.select("conv_id", "turns")), "faults")
    # a row a signature on the right: conversations of a common one are split at run time where that is no broadcast
    joined = known.join(solved(known.select("signature").distinct()), "signature")
    replay = "transform(plan, p -> struct(coalesce(p.role, turns[greatest(p.row, 0)].role) as role, if(p.row < 0, '', turns[greatest(p.row, 0)].text) as text))"
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.expr(replay).alias("repaired"))


def rendered(turns: str) -> Column:
    """``role:text`` of each turn, a line each."""
    return F.expr(f"array_join(transform({turns}, t -> concat(t.role, ':', t.text)), '\\n')")
