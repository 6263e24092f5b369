"""Repair of conversation structure by a Viterbi search that emits decisions as survivors coalesce.

Initials of roles must read ``(s?(ua)+)?``. A row is kept, given another role or deleted, and empty
turns are inserted; the cheapest sequence of edits wins, of equal ones the least in ASCII. The
search goes through the rows with four states (before the first turn; after s; after u; after a).
The best way into a state, its survivor, is a leaf of a backpointer tree whose nodes count what
holds on to them: what no survivor reaches is freed, and once all survivors share an ancestor, the
edits up to it are emitted. Ways of equal cost into one state are told apart by all of their
unresolved edits, those since that ancestor. Insertions stand before a row's own edit or at the
very end, so of two ways through the same rows neither begins the other, and their order stays.

A conversation of at most ``ROWS`` rows is searched where it is read. Rows of a longer one are
numbered by running sums and dealt by pieces of ``ROWS`` rows. Each piece is searched from every
state it may start in; the (cost, order) tables of a conversation's pieces are put together, a few
numbers a piece, and each piece is then searched once more between the two states that this
fixes. So a conversation with a third of all rows is worked on by many tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import stored
from rolesieve.operators.running import running

#: Rows of a piece, and of a task.
ROWS = 2000
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: States in which a row of a role can be kept, and the state that an edit other than keeping leads to.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
FOLLOWING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: The most that a way in one state pays above another state, to do all that can be done from there:
#: a missing turn is inserted, a leading row of role s deleted. A survivor that costs more is dropped.
CATCH_UP = {  # by the state that costs too much, then by the other one
    START: {SYSTEM: 2 * INSERT, USER: INSERT + DELETE, ASSISTANT: DELETE}, SYSTEM: {START: 0, USER: INSERT, ASSISTANT: 0},
    USER: {START: INSERT, SYSTEM: INSERT, ASSISTANT: INSERT}, ASSISTANT: {START: 0, SYSTEM: 2 * INSERT, USER: INSERT},
}
#: Faults of a row: none, truncated, one that must go.
FINE, CUT, MUST_GO = range(3)
BLANKS = " \t\n\v\f\r"


def after(state: int, inserted: int) -> int:
    for _ in range(inserted):
        state = FOLLOWING[state]
    return state


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """By state: (target, cost, edits) of the best way a row can lead to each target. More than two
    insertions lead nowhere that fewer do not."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        for n in range(3):
            at, cost, edits = after(state, n), n * INSERT, "I" * n
            options = [(at, cost + DELETE, edits + "D")]
            if fault != MUST_GO:
                cost += TRUNCATED * (fault == CUT)
                options.append((FOLLOWING[at], cost + REROLE, edits + "R"))
                if at in KEPT[initial]:
                    options.append((KEPT[initial][at], cost, edits + "K"))
            for target, c, e in options:
                best[target] = min(best.get(target, (c, e)), (c, e))
        out.append([(t, c, e) for t, (c, e) in best.items()])
    return out


MOVES = {(i, f): _moves(i, f) for i in KEPT for f in (FINE, CUT, MUST_GO)}


class Node:
    """A row's edits in the backpointer tree, and how many nodes and survivors hold on to it."""

    __slots__ = ("edits", "before", "held")

    def __init__(self, edits: str, before: Node | None):
        self.edits, self.before, self.held = edits, before, 1
        if before is not None:
            before.held += 1


class Survivors:
    """The cheapest way into each state; takes rows, gives back edits once they are certain."""

    def __init__(self, start: int = START):
        self.root = Node("", None)
        self.best = {start: (0, self.root)}

    def row(self, initial: str, fault: int) -> list[str]:
        """Takes a row of role ``initial`` ("" if none of s, u, a); the edits of the rows, oldest
        first, that all survivors now agree on."""
        moves, ways = MOVES[initial, fault], {}
        for state, (cost, _) in self.best.items():
            for target, more, edits in moves[state]:
                ways.setdefault(target, []).append((cost + more, state, edits))
        new, costs = {}, {target: min(options)[0] for target, options in ways.items()}
        for target, options in ways.items():
            least = costs[target]
            if any(least > costs[s] + more for s, more in CATCH_UP[target].items() if s in costs):
                continue
            ties = [o for o in options if o[0] == least]
            _, origin, edits = ties[0] if len(ties) == 1 else min(ties, key=lambda o: self.unresolved(o[1]) + o[2])
            new[target] = least, Node(edits, self.best[origin][1])
        for _, node in self.best.values():
            node.held -= 1
            while node.held == 0 and node.before is not None:  # no survivor reaches it any more
                before, node.before = node.before, None
                before.held -= 1
                node = before
        self.best = new
        return self._agreed()

    def _agreed(self) -> list[str]:
        if self.root.held != 1:
            return []
        chain, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.before
        out = []
        while chain and self.root.held == 1:  # one child, and no survivor of its own
            self.root = chain.pop()
            out.append(self.root.edits)
            self.root.before.held -= 1
            self.root.before, self.root.edits = None, ""
            if not chain:
                break
        return out

    def rest(self, state: int) -> list[str]:
        """Edits of the rows that are not certain yet, on the way into a state."""
        node, out = self.best[state][1], []
        while node.before is not None:
            out.append(node.edits)
            node = node.before
        return out[::-1]

    def unresolved(self, state: int) -> str:
        return "".join(self.rest(state))

    def size(self) -> int:
        """Nodes that are held."""
        seen = set()
        for _, node in self.best.values():
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                node = node.before
        return len(seen)

    def finish(self) -> tuple[int, int, int]:
        """(cost, state, insertions) of the best end; of equal ones the least in ASCII."""
        ends = [(cost + n * INSERT, self.unresolved(s) + "I" * n, s, n) for s, (cost, _) in self.best.items() for n in range(3) if after(s, n) in ENDS]
        cost, _, state, n = min(ends)
        return cost, state, n

    def table(self) -> tuple[list[int], list[int]]:
        """By state: the cost of the way into it (-1: none), and its place among them in ASCII order."""
        order = sorted(self.best, key=self.unresolved)
        return [self.best[s][0] if s in self.best else -1 for s in range(4)], [order.index(s) if s in self.best else -1 for s in range(4)]


class Writer:
    """Turns edits back into turns: (edit, role, text), in order."""

    def __init__(self, state: int = START):
        self.state, self.waiting = state, deque()

    def take(self, role: str, text: str) -> None:
        self.waiting.append((role, text))

    def write(self, decided: list[str]) -> Iterator[tuple[str, str, str]]:
        for edits in decided:
            for edit in edits:
                if edit == "D":
                    yield edit, *self.waiting.popleft()
                    continue
                if edit == "K":
                    role, text = self.waiting.popleft()
                    self.state = KEPT[role[0]][self.state]
                else:
                    self.state = FOLLOWING[self.state]
                    role, text = ROLE[self.state], self.waiting.popleft()[1] if edit == "R" else ""
                yield edit, role, text


class Counts:
    """Faults and turns of consecutive rows."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_initial = self.last_initial = None

    def row(self, turn: int | None, role: str, text: str, seen: Callable[[], bool]) -> tuple[str, int]:
        """Counts a row; its initial as the search knows it, and its fault."""
        end = text.rstrip(BLANKS)[-1:]
        if not end:
            self.blank += 1
            fault = MUST_GO
            seen()
        elif seen():
            self.duplicate += 1
            fault = MUST_GO
        elif end not in ".!?":
            self.truncated += 1
            fault = CUT
        else:
            fault = FINE
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        return initial if initial in KEPT else "", fault

    def add(self, other: Counts) -> None:
        """What follows; ``other`` has at least one row."""
        self.illegal += other.illegal + (self.last_initial is not None and self.last_initial + other.first_initial not in LEGAL)
        self.turns += other.turns - (other.first is not None and other.first == self.last)
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.last_initial = other.last_initial

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "key string, piece long, at long, edit string, role string, text string"


class _Digest:
    """Audit and digest of repaired turns."""

    def __init__(self):
        self.audit, self.hash, self.any = [], hashlib.sha256(), False

    def add(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def both(self) -> tuple[str, str]:
        return "".join(self.audit), self.hash.hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows whose first ``width`` columns are equal, read one by one."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    first = next(rows, None)
    while first is not None:
        group, following = first[:width], [None]

        def one(row=first):
            while row is not None and row[:width] == group:
                yield row[width:]
                row = next(rows, None)
            following[0] = row

        members = one()
        yield group, members
        deque(members, 0)
        first = following[0]


def _out(rows: Iterator[tuple], schema: str, each: int = 1000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [(n, types[t]) for n, t in (f.split() for f in schema.split(", "))]
    step, size = [], 0
    for row in rows:
        step.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(step) >= each or size > chars:
            yield _batch(step, fields)
            step, size = [], 0
    if step:
        yield _batch(step, fields)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _steps(rows: Iterator[tuple], search: Survivors, counts: Counts, writer: Writer) -> Iterator[tuple[str, str, str]]:
    """Turns that are certain while (turn, role, text, seen or None) come in."""
    known = set()

    def new(role, text):
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        return key in known or known.add(key) is not None

    for turn, role, text, seen in rows:
        move = counts.row(turn, role, text, (lambda: seen) if seen is not None else (lambda: new(role, text)))
        writer.take(role, text)
        yield from writer.write(search.row(*move))


def _whole_reports(batches):
    def rows():
        for (key,), turns in _grouped(batches, 1):
            search, counts, writer, digest = Survivors(), Counts(), Writer(), _Digest()
            for turn in _steps(turns, search, counts, writer):
                digest.add(*turn)
            cost, state, closing = search.finish()
            for turn in writer.write([*search.rest(state), "I" * closing]):
                digest.add(*turn)
            yield key, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, *digest.both()

    return _out(rows(), REPORT)


def _whole_edits(batches):
    def rows():
        for (key,), turns in _grouped(batches, 1):
            search, writer = Survivors(), Writer()
            at = 0
            for turn in _steps(turns, search, Counts(), writer):
                yield key, 0, at, *turn
                at += 1
            _, state, closing = search.finish()
            for turn in writer.write([*search.rest(state), "I" * closing]):
                yield key, 0, at, *turn
                at += 1

    return _out(rows(), EDITS)


TABLE = ("key string, piece long, cost array<long>, place array<long>, blank long, duplicate long, truncated long, illegal long, turns long, "
         "first long, last long, first_initial string, last_initial string")


def _tables(batches):
    """Of each piece: costs and order of the ways from each state into each state, and its counts."""
    def rows():
        for (key, piece), turns in _grouped(batches, 2):
            searches, counts = [Survivors(s) for s in range(4 if piece else 1)], Counts()
            for turn, role, text, seen in turns:
                move = counts.row(turn, role, text, lambda: seen)
                for s in searches:
                    s.row(*move)
            both = [s.table() for s in searches]
            yield (key, piece, [c for cost, _ in both for c in cost], [p for _, place in both for p in place], counts.blank, counts.duplicate,
                   counts.truncated, counts.illegal, counts.turns, counts.first, counts.last, counts.first_initial, counts.last_initial)

    return _out(rows(), TABLE)


WAY = "key string, piece long, start long, end long, closing long, gaps long, blank long, duplicate long, truncated long, illegal long, cost_all long"


def _ways(batches):
    """Through which states the best way of a conversation passes; its counts stand at the last piece."""
    def rows():
        for (key,), pieces in _grouped(batches, 1):
            total, best, place, back = Counts(), {START: 0}, {START: 0}, []
            for _, cost, order, blank, duplicate, truncated, illegal, turns, first, last, first_initial, last_initial in pieces:
                counts = Counts()
                counts.__dict__.update(blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, turns=turns, first=first, last=last,
                                       first_initial=first_initial, last_initial=last_initial)
                total.add(counts)
                # ways from different states differ in what comes before, so that order decides
                new = {e: min((c + cost[4 * s + e], place[s], s) for s, c in best.items() if cost[4 * s + e] >= 0)
                       for e in range(4) if any(cost[4 * s + e] >= 0 for s in best)}
                back.append(bytes(new[e][2] if e in new else 9 for e in range(4)))
                ranked = sorted(new, key=lambda e: (new[e][1], order[4 * new[e][2] + e]))
                best, place = {e: v[0] for e, v in new.items()}, {e: i for i, e in enumerate(ranked)}
            least, _, closing, state = min((c + n * INSERT, place[e], n, e) for e, c in best.items() for n in range(3) if after(e, n) in ENDS)
            numbers = total.gaps, total.blank, total.duplicate, total.truncated, total.illegal, least
            for piece in range(len(back) - 1, -1, -1):
                start = back[piece][state]
                yield key, piece, start, state, closing, *numbers
                state, closing, numbers = start, 0, (None,) * 6

    return _out(rows(), WAY)


def _piece_edits(batches):
    def rows():
        for (key, piece, start, end, closing), turns in _grouped(batches, 5):
            search, writer, at = Survivors(start), Writer(start), 0
            for turn in _steps(turns, search, Counts(), writer):
                yield key, piece, at, *turn
                at += 1
            for turn in writer.write([*search.rest(end), "I" * closing]):
                yield key, piece, at, *turn
                at += 1

    return _out(rows(), EDITS)


DIGEST = "key string, audit string, repaired_sha256 string"


def _digests(batches):
    def rows():
        for (key,), turns in _grouped(batches, 1):
            digest = _Digest()
            for turn in turns:
                digest.add(*turn)
            yield key, *digest.both()

    return _out(rows(), DIGEST)


class Repair:
    """Conversations ``turns`` (``conv``, turn, role, text), repaired.

    Rows of a conversation go by turn, nulls first; equal turns by role, then text. A null role or
    text is one space. A null conversation is one like any other. Roles count by their first letter;
    one that starts with none of s, u, a is never kept as it is. Repeated rows are duplicates. Other
    columns are left out of the results; an empty table gives empty results.
    """

    def __init__(self, turns: DataFrame, conv: str = "conv_id", rows: int = ROWS):
        self.kind = turns.schema[conv].dataType
        key = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        table = turns.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
        long = stored(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("key"))
        self.any_long = not long.isEmpty()
        short = table.join(long, "key", "left_anti") if self.any_long else table
        self.short = short.withColumn("seen", F.lit(None).cast("boolean"))
        if self.any_long:
            placed = running(table.join(long, "key", "left_semi"), ["key"], "key", ["turn", "role", "text"], {"place": ("sum", F.lit(1).cast("long"))})
            placed = stored(placed.withColumns({"piece": F.expr(f"(place - 1) div {rows}"), "same": F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))}))
            first = placed.groupBy("key", "same").agg(F.min("place").alias("first"))
            self.long = stored(placed.join(first, ["key", "same"]).withColumn("seen", F.col("place") > F.col("first")).drop("same", "first"))
            tables = self._sorted(self.long, ["key", "piece"], ["place"]).select("key", "piece", "turn", "role", "text", "seen").mapInArrow(_tables, TABLE)
            self.ways = stored(self._sorted(tables, ["key"], ["piece"]).mapInArrow(_ways, WAY))

    @staticmethod
    def _sorted(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, *order)

    def _whole(self) -> DataFrame:
        return self._sorted(self.short, ["key"], ["turn", "role", "text"]).select("key", "turn", "role", "text", "seen")

    def _long_edits(self) -> DataFrame:
        ways = self.ways.select("key", "piece", "start", "end", "closing")
        return self._sorted(self.long.join(ways, ["key", "piece"]), ["key", "piece"], ["place"]).select(
            "key", "piece", "start", "end", "closing", "turn", "role", "text", "seen").mapInArrow(_piece_edits, EDITS)

    def _named(self, df: DataFrame) -> DataFrame:
        conv = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(self.kind)
        return df.select(conv.alias("conv_id"), *(c for c in df.columns if c != "key"))

    def edits(self) -> DataFrame:
        """One row per edit: conv_id, piece and at (its place), edit (K kept, R given another role, D
        deleted, I inserted), and the role and text it leaves; of a deleted row, those it had."""
        out = self._whole().mapInArrow(_whole_edits, EDITS)
        return self._named(out.unionByName(self._long_edits()) if self.any_long else out)

    def reports(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
        (all edits in order) and repaired_sha256. A digest is made from beginning to end by its
        nature: turns of a long conversation stream through one task for it."""
        out = self._whole().mapInArrow(_whole_reports, REPORT)
        if self.any_long:
            edits = self._sorted(self._long_edits(), ["key"], ["piece", "at"]).select("key", "edit", "role", "text")
            numbers = self.ways.where("cost_all is not null").withColumnRenamed("cost_all", "cost")
            long = numbers.join(edits.mapInArrow(_digests, DIGEST), "key")
            out = out.unionByName(long.select(*out.columns))
        return self._named(out)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults by CRC-32 of ``conv_id:turn``, each null
    one space: of twenty rows one goes, one loses its text, one its sentence ends, one comes twice
    and one has role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies: Column = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")
