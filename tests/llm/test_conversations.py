"""Conversation repair against a search of all edits, and on nulls, repeated rows, long runs and empty tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from sheaf.llm import conversations as cv
from sheaf.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, _c int, n string"
ROLES = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)


def damaged(rows):
    """The rows (turn, role, text) of each conversation after damage, in order."""
    out = {}
    for c, t, role, text in rows:
        mine = out.setdefault(c, [])
        key = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        mine += [(t, "user" if key == 4 else role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(BLANKS)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """The report by a forward search that keeps the least (cost, audit) for each place of the pattern."""
    found = faults(rows)
    inserted = lambda places: with_inserts(places)
    best = {0: (0, "", ())}
    for (_, role, text), f in zip(rows, found):
        new = {}
        for at, (cost, audit, said) in inserted(best).items():
            late = int(f == "t")
            options = [(3, "D", at, ())]
            if f in ("", "t"):
                options.append((2 + late, "R", NEXT[at], ((ROLES[at], text),)))
                if role[:1] == "s" and at == 0:
                    options.append((late, "K", 1, ((role, text),)))
                if role[:1] == ROLES[at][0]:
                    options.append((late, "K", NEXT[at], ((role, text),)))
            for price, edit, to, more in options:
                option = (cost + price, audit + edit, said + more)
                if to not in new or option[:2] < new[to][:2]:
                    new[to] = option
        best = new
    cost, audit, said = min((v for at, v in inserted(best).items() if at in (0, 3)), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": found.count("b"), "duplicate": found.count("d"), "truncated": found.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    }


def with_inserts(places):
    """The places that inserts lead to as well."""
    out = dict(places)
    for _ in range(4):
        for at, (cost, audit, said) in list(out.items()):
            option = (cost + 2, audit + "I", (*said, (ROLES[at], "")))
            if NEXT[at] not in out or option[:2] < out[NEXT[at]][:2]:
                out[NEXT[at]] = option
    return out


def compared(found, rows):
    wanted = damaged(rows)
    got = {r["conv_id"]: r for r in found}
    assert set(got) == set(wanted) and len(found) == len(got)
    for c, mine in wanted.items():
        expected = plain(mine)
        assert {k: got[c][k] for k in expected} == expected, c


def test_whole_table(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    compared(QUERIES["op13_conversations"](spark, sf).collect(), rows)


def test_random_conversations_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    texts = ["Yes.", "No", "Well!", "", " \t", None, "As I said", "Fine?  "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "u"]
    rows = []
    for c in [None, *range(80)]:
        for t in range(rng.integers(1, 12)):
            row = (c, None if rng.random() < 0.1 else int(t - rng.integers(0, 2)), roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))])
            rows += [row] * int(rng.integers(1, 4) if rng.random() < 0.15 else 1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    compared(cv.repair_report(df).collect(), rows)


def test_all_short_conversations():
    """Every sequence of up to four symbols: the dynamic programme's cost and audit are those of the plain search."""
    words = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    kinds = [(k, f) for k in "suao" for f in (cv.CLEAN, cv.TRUNCATED)] + [("o", cv.BLANK)]
    for n in range(5):
        for row in itertools.product(kinds, repeat=n):
            runs = [(s, len(list(g))) for s, g in itertools.groupby(cv.symbol("suao".index(k), f) for k, f in row)]
            texts = [(i, words[k], "" if f == cv.BLANK else f"{i}{'.' if f == cv.CLEAN else ''}") for i, (k, f) in enumerate(row)]
            expected = plain(texts)
            assert cv.repair(runs) == (expected["cost"], expected["audit"]), row


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_long_runs(block):
    rng = np.random.default_rng(4)
    for _ in range(20):
        rows, runs = [], []
        for _ in range(rng.integers(1, 6)):
            kind, fault, n = int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(1, 40))
            runs.append((cv.symbol(kind, fault), n))
            rows += [(len(rows) + i, ("system", "user", "assistant", "tool")[kind], "" if fault in (cv.BLANK, cv.DUPLICATE) else f"{len(rows) + i}{'.' if fault == cv.CLEAN else ''}") for i in range(n)]
        runs = [(s, sum(n for _, n in g)) for s, g in itertools.groupby(runs, key=lambda r: r[0])]
        expected = plain(rows)
        assert cv.repair(runs, block) == (expected["cost"], expected["audit"])


def test_powers_are_the_steps():
    sym = cv.symbol(1, cv.TRUNCATED)
    costs = cv.AT_END
    for n in range(1, 70):
        costs = sym.before(1, costs)
        assert sym.before(n, cv.AT_END) == costs
    assert len(sym.powers) == 7 and sym.before(10**12, cv.AT_END)[0] == 10**12 + 2 * (10**12 // 2)  # every other row is made the assistant's


def test_repaired_rows_follow_the_audit(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = cv.damage(df)
    by = collections.defaultdict(list)
    for r in cv.repaired_rows(rows).collect():
        by[r["conv_id"]].append(r)
    for r in cv.repair_report(df).collect():
        mine = sorted(by[r["conv_id"]], key=lambda x: x["place"])
        assert [x["place"] for x in mine] == list(range(len(mine)))
        assert "".join(x["edit"] for x in mine) == r["audit"].replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in mine))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in mine).encode()).hexdigest() == r["repaired_sha256"]
        assert all((x["turn"] is None) == (x["edit"] == "I") for x in mine)


def test_undamaged_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello!"), (1, 2, "assistant", "Good day."), (2, 5, "user", "Why?"), (2, 9, "assistant", "So.")]
    out = cv.repaired_rows(cv.turns(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA))).collect()
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in out) == rows and {r["edit"] for r in out} == {"K"}


def test_empty_table_and_one_very_long_conversation(spark):
    assert cv.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i // 3}.") for i in range(3000)] + [(8, 0, "user", "x" * 300_000 + "."), (8, 1, "assistant", "y.")]
    compared(cv.repair_report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)).collect(), rows)
