"""Conversation structure repair: the cheapest edits that make a conversation alternate, by dynamic programming over runs.

A conversation's roles should read `(s?(ua)+)?` by their initials: a system turn or none, then user and assistant by turns.
Each row is kept (cost 0), gets the role that should stand there (2) or is deleted (3); empty turns are inserted (2). Blank
rows and repeats of an earlier row must go; a row that breaks off costs 1 more if it stays. The audit is the initials of
the edits in order (D, I, K, R), of all cheapest ones the least in ASCII.

Method: a row is a symbol, role and fault, and equal consecutive symbols are one run. What a row does to the costs of the
four places where the pattern can stand is a min-plus matrix; a run multiplies the costs behind it by the binary powers
of its matrix, which are kept. That gives the costs at each run's end, from the last to the first; then the
choices are read off from the first row on, in blocks of a run, whose costs come from the same powers.

Scale: equal rows of a turn are counted before anything is shuffled. A conversation's rows are sorted by Spark and pass
through a task one by one: what a task holds is the runs and the audit, never the texts. Since a digest of the repaired text is
sequential, one conversation stays in one task, however long it is.

Nulls: a null role or text is one space, as is a null number in the key of the damage; rows without a turn come first; a null
conv_id is a conversation of its own. Rows of one turn are ordered by role and text. Repeated rows are duplicates. An
empty table gives an empty result, and columns besides the four are not looked at. Very long texts are hashed as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from .common import id_again, id_of

#: What a row's text may have besides a blank's.
BLANKS = " \t\n\x0b\x0c\r"
#: Where the pattern stands: at the start, behind s, behind u, behind a. What it takes next, and where that leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
RIGHT_ROLE = ("user", "user", "assistant", "user")
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 60
CLASSES = "sua"  # initials; any other is class 3
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def keeps(place: int, kind: int) -> int | None:
    """Where a kept row of that class leads; None where it can't stand."""
    if kind == 0:
        return AFTER_S if place == START else None
    return NEXT[place] if kind < len(CLASSES) and CLASSES[kind] == RIGHT_ROLE[place][0] else None


class Symbol:
    """A row's role and fault: its edits, its matrix and the matrix's binary powers, each made once."""

    def __init__(self, kind: int, fault: int) -> None:
        self.must_go = fault in (BLANK, DUPLICATE)
        late = CUT_OFF if fault == TRUNCATED else 0
        #: For each place (edit, cost, next place, whether the row is done), in the order of the initials.
        self.edits: list[list[tuple[str, int, int, bool]]] = []
        for place in range(4):
            options = [("D", DELETE, place, True), ("I", INSERT, NEXT[place], False)]
            if not self.must_go:
                kept = keeps(place, kind)
                options += [("K", late, kept, True)] if kept is not None else []
                options.append(("R", REROLE + late, NEXT[place], True))
            self.edits.append(options)
        rows = []
        for place in range(4):
            row, at = [NEVER] * 4, place
            for inserted in range(4):  # more would come back to a place
                for _, cost, to, done in self.edits[at]:
                    if done:
                        row[to] = min(row[to], cost + INSERT * inserted)
                at = NEXT[at]
            rows.append(tuple(row))
        self.powers: list[Matrix] = [tuple(rows)]  # type: ignore[list-item]

    def before(self, times: int, costs: Vector) -> Vector:
        """The costs before so many rows of this symbol, from those behind them."""
        k = 0
        while times:
            if k == len(self.powers):
                m = self.powers[-1]
                self.powers.append(tuple(tuple(min(m[i][x] + m[x][j] for x in range(4)) for j in range(4)) for i in range(4)))  # type: ignore[arg-type]
            if times & 1:
                costs = tuple(min(row[j] + costs[j] for j in range(4)) for row in self.powers[k])  # type: ignore[assignment]
            times, k = times >> 1, k + 1
        return costs


#: Cost of the inserts that end a conversation in each place.
AT_END: Vector = (0, 2 * INSERT, INSERT, 0)
_symbols: dict[tuple[int, int], Symbol] = {}


def symbol(kind: int, fault: int) -> Symbol:
    """One object for all rows that have the same edits; what must go is alike for all roles."""
    key = (3, BLANK) if fault in (BLANK, DUPLICATE) else (kind, fault)
    if key not in _symbols:
        _symbols[key] = Symbol(*key)
    return _symbols[key]


def repair(runs: list[tuple[Symbol, int]], block: int = 1024) -> tuple[int, str]:
    """(cost, audit) of a conversation, given as runs of equal symbols."""
    behind = [AT_END]
    for sym, times in reversed(runs):
        behind.append(sym.before(times, behind[-1]))
    cost, place, audit = behind.pop()[START], START, []
    for (sym, left), end in zip(runs, reversed(behind), strict=True):
        while left:
            now = min(block, left)
            costs = [sym.before(left - now, end)]
            for _ in range(now):
                costs.append(sym.before(1, costs[-1]))
            for i in range(now, 0, -1):
                due, done = costs[i][place], False
                while not done:
                    for edit, price, to, done in sym.edits[place]:
                        rest = costs[i - 1][to] if done else min_before(sym, costs[i - 1], to)
                        if price + rest == due:
                            audit.append(edit)
                            place, due = to, rest
                            break
            left -= now
    audit.append("I" * (AT_END[place] // INSERT))
    return cost, "".join(audit)


def min_before(sym: Symbol, behind: Vector, place: int) -> int:
    """The cost from a place in front of a row."""
    return min(a + b for a, b in zip(sym.powers[0][place], behind, strict=True))


class Editor:
    """Carries out an audit on the rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield "I", RIGHT_ROLE[self.place], ""
            self.at, self.place = self.at + 1, NEXT[self.place]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands for this row in the repaired conversation, inserted turns before it included."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = AFTER_S if role[:1] == "s" else NEXT[self.place]
            yield "K", role, text
        elif edit == "R":
            right, self.place = RIGHT_ROLE[self.place], NEXT[self.place]
            yield "R", right, text


def damage(conversations: DataFrame, every: int = 20) -> DataFrame:
    """_c, _t, role, text, n: rows with faults put in by the crc32 of `conv_id:turn`: one in `every` dropped (n 0), emptied, without
    its sentence ends, repeated (n 2), made the user's."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % every
    rows = turns(conversations).withColumn("_fate", fate)
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    n = F.when(F.col("_fate") == 0, 0).when(F.col("_fate") == 3, 2).otherwise(1)
    return rows.select("_c", "_t", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), n.alias("n"))


def turns(conversations: DataFrame) -> DataFrame:
    """_c, _t, role, text, n of the rows as they are, besides conv_id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", id_of("conv_id").alias("_c"), id_of("turn").alias("_t"), text("role"), text("text"), F.lit(1).alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """The rows in order (_p), equal ones of a turn once with their number n (0: dropped), and _fault and _kind of the first."""
    whole = rows.groupBy("_c", "_t", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    of = W.partitionBy("_c")  # one shuffle serves both windows
    places = whole.withColumn("_p", F.row_number().over(of.orderBy("_t", "role", "text")).cast("long"))
    seen = places.withColumn("_again", F.coalesce(F.max(F.col("n") > 0).over(W.partitionBy("_c", "role", "text").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("_again"), DUPLICATE).when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    kind: Column = F.lit(len(CLASSES))
    for i, initial in enumerate(CLASSES):
        kind = F.when(F.substring("role", 1, 1) == initial, i).otherwise(kind)
    return seen.withColumns({"_fault": fault.cast("int"), "_kind": kind.cast("int")}).drop("_again")


REPORT = "_c long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Conversation:
    """What is kept of a conversation while its rows pass."""

    def __init__(self, number: int) -> None:
        self.number, self.runs, self.faults, self.illegal = number, [], [0] * 4, 0
        self.kind: int | None = None
        self.turns: list[int] = []  # first, last, how many

    def add(self, turn: int | None, kind: int, fault: int, n: int) -> None:
        if turn is not None:
            first, last, many = self.turns or (turn, None, 0)
            self.turns = [first, turn, many + (turn != last)]
        if self.kind is not None:
            self.illegal += (self.kind, kind) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += n - 1
        self.kind = kind
        for f, times in ((fault, 1), (fault if fault == BLANK else DUPLICATE, n - 1)):
            self.faults[f] += times
            sym = symbol(kind, f)
            if times and self.runs and self.runs[-1][0] is sym:
                self.runs[-1] = (sym, self.runs[-1][1] + times)
            elif times:
                self.runs.append((sym, times))

    def report(self) -> tuple:
        first, last, many = self.turns or (0, -1, 0)
        cost, audit = repair(self.runs)
        return (self.number, last - first + 1 - many, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit)


def audits(rows: DataFrame) -> DataFrame:
    """REPORT of each conversation of `marked` rows."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        for pdf in batches:
            out = []
            for number, turn, kind, fault, n in zip(*(pdf[c].tolist() for c in ("_c", "_t", "_kind", "_fault", "n")), strict=True):
                if now is None or now.number != number:
                    out += [now.report()] if now else []
                    now = Conversation(number)
                if n:
                    now.add(turn if turn != NO_TURN else None, kind, fault, n)
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([now.report()], columns=names)

    narrow = rows.select("_c", "_p", "_t", "_kind", "_fault", "n").repartition("_c").sortWithinPartitions("_c", "_p")
    return narrow.mapInPandas(repaired, REPORT)


NO_TURN = -(1 << 63)


def with_audits(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its report as the first of them, so that a task needs no other row beside the one at hand."""
    held = written(rows, "conversations")
    both = audits(held).withColumn("_p", F.lit(0).cast("long")).unionByName(held.select("_c", "_p", "_t", "role", "text", "n"), allowMissingColumns=True)
    return both.repartition("_c").sortWithinPartitions("_c", "_p")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, turn (null where inserted), role, text: the repaired conversations."""

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, number, place = Editor(""), None, 0
        for pdf in batches:
            out = []
            for c, p, t, role, text, n, audit in zip(*(pdf[x].tolist() for x in ("_c", "_p", "_t", "role", "text", "n", "audit")), strict=True):
                if p == 0:
                    for edit in editor.inserted():
                        out.append((number, place, edit[0], NO_TURN, *edit[1:]))
                        place += 1
                    editor, number, place = Editor(audit), c, 0
                    continue
                for _ in range(int(n)):
                    for edit in editor.row(role, text):
                        out.append((c, place, edit[0], NO_TURN if edit[0] == "I" else int(t), *edit[1:]))
                        place += 1
            yield pd.DataFrame(out, columns=["_c", "place", "edit", "_t", "role", "text"])
        yield pd.DataFrame([(number, place + i, e[0], NO_TURN, *e[1:]) for i, e in enumerate(editor.inserted())], columns=["_c", "place", "edit", "_t", "role", "text"])

    done = with_audits(marked(rows)).mapInPandas(edited, "_c long, place long, edit string, _t long, role string, text string")
    return done.select(id_again("_c").alias("conv_id"), "place", "edit", id_again("_t").alias("turn"), "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """REPORT and repaired_sha256: of the repaired `role:text`, joined by newlines."""
    kept = [c.split()[0] for c in REPORT.split(", ")]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, report, sha, empty = Editor(""), None, hashlib.sha256(), True

        def feed(edits: Iterator[tuple[str, str, str]]) -> None:
            nonlocal empty
            for _, role, text in edits:
                sha.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
                empty = False

        def ended() -> list[tuple]:
            feed(editor.inserted())
            return [(*report, sha.hexdigest())] if report is not None else []

        for pdf in batches:
            out = []
            columns = {c: pdf[c].tolist() for c in ("_p", "role", "text", "n", *kept)}
            for i, p in enumerate(columns["_p"]):
                if p == 0:
                    out += ended()
                    editor, report, sha, empty = Editor(columns["audit"][i]), [columns[c][i] for c in kept], hashlib.sha256(), True
                else:
                    for _ in range(int(columns["n"][i])):
                        feed(editor.row(columns["role"][i], columns["text"][i]))
            yield pd.DataFrame(out, columns=[*kept, "repaired_sha256"]).astype({c: "int64" for c in kept[:-1]})
        yield pd.DataFrame(ended(), columns=[*kept, "repaired_sha256"]).astype({c: "int64" for c in kept[:-1]})

    return with_audits(marked(rows)).mapInPandas(hashed, f"{REPORT}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: what the damage leaves wrong, the cheapest repair and a digest of the repaired conversation."""
    return digests(damage(conversations)).withColumn("conv_id", id_again("_c")).select("conv_id", *[c.split()[0] for c in REPORT.split(", ")[1:]], "repaired_sha256")
