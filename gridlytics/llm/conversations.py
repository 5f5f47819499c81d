"""Conversation structure repair: the cheapest edits that give every conversation the roles (system)? (user assistant)+.

A Viterbi search over four states of that grammar. The paths that survive hang in a tree of back pointers that counts who refers to a
node: what no survivor refers to any more goes at once, and as soon as all survivors share an ancestor, the edits up to it are emitted.
So a task holds the unresolved stretch of one conversation, not the conversation. Paths of equal cost are compared by all of their
unresolved edits: after each row the survivors get a rank in that order, and as no two edits of one row begin alike, a rank and
what a path has inserted since then order the whole paths.

Rows are dealt by conversation and sorted by (turn, nulls first; role; digest of the text). Which row of a text is the first is
found before, from digests alone: a mark for it goes with the rows and stands before it in that order. Texts are shuffled once.
One conversation is read by one task, row by row, in memory that does not grow with its length unless its ties last as long: a
digest of the repaired text can't be taken in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage

RETAG, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row. Accepted: the first and the last.
KEEP_TO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT, ACCEPTED = (2, 2, 3, 2), (0, 3)
ROLE = {2: "user", 3: "assistant"}
SPACE = r" \u0009\u000a\u000b\u000c\u000d"


class Node:
    """One row's edits on a path: its edit and what is inserted after it."""

    __slots__ = ("parent", "children", "edits", "row", "held")

    def __init__(self, parent, edits: str, row):
        self.parent, self.edits, self.row, self.children, self.held = parent, edits, row, set(), False
        if parent is not None:
            parent.children.add(self)


class Digest:
    """The running digest of a path's repaired lines."""

    def __init__(self):
        self.sum, self.begun = hashlib.sha256(), False

    def after(self, lines: list[bytes]) -> Digest:
        if not lines:
            return self
        out = Digest()
        out.sum, out.begun = self.sum.copy(), True
        out.sum.update((b"\n" if self.begun else b"") + b"\n".join(lines))
        return out


class Survivors:
    """The best path to each state after the rows so far. `row(...)` returns the edits that are settled by it, `end()` the rest."""

    def __init__(self, digests: bool):
        self.root = Node(None, "", None)
        self.settled = 0  # the state where the root stands
        start = {0: (0, 0, "", None, "")}
        self.paths = {0: (0, 0, "", self.root, Digest() if digests else None)}  # cost, rank, tail, node, digest
        self.root.held = True
        self._take(self._with_inserts(start), None, b"")

    def _with_inserts(self, best: dict) -> dict:
        """Candidates are (cost, rank, tail, state they come from, edits); an insertion always costs, so the cheapest is final."""
        open_states = set(best)
        while open_states:
            q = min(open_states, key=lambda s: best[s][0])
            open_states.discard(q)
            cost, rank, tail, origin, edits = best[q]
            new = (cost + INSERT, rank, tail + "I", origin, edits + "I")
            if NEXT[q] not in best or new[:3] < best[NEXT[q]][:3]:
                best[NEXT[q]] = new
                open_states.add(NEXT[q])
        if 3 in best:  # whatever can follow state 1 can follow state 3; state 0 can keep one system row more
            if 1 in best and best[1][0] > best[3][0]:
                del best[1]
            if 0 in best and best[0][0] > best[3][0] + DELETE:
                del best[0]
        return best

    def _take(self, best: dict, row, line: bytes) -> list:
        old, self.paths = self.paths, {}
        before, rank, of, base = None, -1, None, ""
        for q in sorted(best, key=lambda s: best[s][1:3]):
            cost, was, tail, origin, edits = best[q]
            origin = 0 if origin is None else origin
            if was != of or not tail.startswith(base):
                rank, of, base = rank + 1, was, tail
            node = Node(old[origin][3], edits, row)
            node.held = True
            digest = old[origin][4]
            if digest is not None:
                digest = digest.after(self._lines(origin, edits, row, line))
            self.paths[q] = (cost, rank, tail[len(base) :], node, digest)
        for path in old.values():
            path[3].held = False
        for path in old.values():
            before = path[3]
            while before is not None and not before.held and not before.children and before.parent is not None:
                before.parent.children.discard(before)
                before = before.parent
        out = []
        while not self.root.held and len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.root.parent = None
            out += self._named(self.root)
        return out

    @staticmethod
    def _lines(q: int, edits: str, row, line: bytes) -> list[bytes]:
        out = []
        for edit in edits:
            if edit == "K":
                q = KEEP_TO[q][row[1][:1]]
                out.append(row[1].encode() + b":" + line)
            elif edit != "D":
                q = NEXT[q]
                out.append(ROLE[q].encode() + b":" + (line if edit == "R" else b""))
        return out

    def _named(self, node: Node) -> list:
        """(edit, the row it is made on or None, the role it leaves or None) of each edit of a node."""
        out = []
        for edit in node.edits:
            role = None
            if edit == "K":
                self.settled, role = KEEP_TO[self.settled][node.row[1][:1]], node.row[1]
            elif edit != "D":
                self.settled = NEXT[self.settled]
                role = ROLE[self.settled]
            out.append((edit, None if edit == "I" else node.row, role))
        return out

    def row(self, row, must_go: bool, short: bool, line: bytes = b"") -> list:
        """`row` is any tuple whose second element is the role."""
        initial, stays, best = row[1][:1], CUT_SHORT if short else 0, {}
        for q, (cost, rank, tail, _, _) in self.paths.items():
            options = [(q, DELETE, "D")]
            if not must_go:
                if initial in KEEP_TO[q]:
                    options.append((KEEP_TO[q][initial], stays, "K"))
                options.append((NEXT[q], RETAG + stays, "R"))
            for to, more, edit in options:
                new = (cost + more, rank, tail + edit, q, edit)
                if to not in best or new[:3] < best[to][:3]:
                    best[to] = new
        return self._take(self._with_inserts(best), row, line)

    def end(self) -> tuple[int, list, bytes]:
        """The cost of the best whole path, its edits not yet emitted, and its digest."""
        cost, _, _, node, digest = min((self.paths[q] for q in ACCEPTED if q in self.paths), key=lambda p: p[:3])
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        return cost, [x for n in reversed(rest) for x in self._named(n)], digest.sum.hexdigest() if digest else None


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column, gone: Column) -> DataFrame:
    """Rows and marks, one partition for each conversation's, in order. `copies` is how often a row stands there, `gone` whether it
    only says that its conversation exists."""
    shared = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), copies.cast("long").alias("copies"), gone.alias("gone"),
    )
    kept = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    full = shared.select(
        "conv", "turn", "role", F.when(~F.col("gone"), F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.when(F.col("gone"), 2).otherwise(1).alias("kind"), "copies", (kept == "").alias("blank"),
        (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("short"), F.when(~F.col("gone"), F.col("text")).alias("text"),
    )
    # a null turn comes first: the least (is not null, turn)
    first = full.where("kind = 1").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
    marks = first.select(
        "conv", F.col("at.turn").alias("turn"), "role", "digest", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"),
        F.lit(False).alias("blank"), F.lit(False).alias("short"), F.lit(None).cast("string").alias("text"),
    )
    return full.unionByName(marks).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")


def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches, the copies of a row one after another: (conv, turn, role, blank, seen, short, text), with None in place
    of the role for a row that is gone."""
    mark = None
    for batch in batches:
        for conv, turn, role, digest, kind, copies, blank, short, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                mark = (conv, turn, role, digest)
            elif kind == 2:
                yield conv, turn, None, False, False, False, ""
            else:
                for _ in range(copies):
                    yield conv, turn, role, blank, mark != (conv, turn, role, digest), short, text
                    mark = None


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kind = None

    def result(conv, seen, counts, paths, audit) -> tuple:
        cost, rest, digest = paths.end()
        first, last, turns = seen
        gaps = 0 if first is None else last - first + 1 - turns
        return conv, gaps, *counts, cost, "".join(audit) + "".join(e for e, _, _ in rest), digest

    def peeked() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    def sent() -> pa.RecordBatch:
        names = "conv gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    started, current, held = False, None, 0
    for conv, turn, role, blank, again, short, text in events(peeked()):
        if not started or conv != current:
            if started:
                out.append(result(current, seen, counts, paths, audit))
                held += len(out[-1][-2])
                if len(out) >= 5000 or held > 4 << 20:
                    yield sent()
                    held = 0
            started, current, seen, counts, paths, audit, before = True, conv, (None, None, 0), [0, 0, 0, 0], Survivors(True), [], None
        if role is None:
            continue
        if turn is not None:
            seen = (turn, turn, 1) if seen[0] is None else (seen[0], turn, seen[2] + (turn != seen[1]))
        fault = 0 if blank else 1 if again else 2 if short else None
        if fault is not None:
            counts[fault] += 1
        if before is not None and before + role[:1] not in ("su", "ua", "au"):
            counts[3] += 1
        before = role[:1]
        settled = paths.row((turn, role), fault in (0, 1), fault == 2, text.encode())
        if settled:
            audit.append("".join([e for e, _, _ in settled]))
    if started:
        out.append(result(current, seen, counts, paths, audit))
    if out:
        yield sent()


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kind = pa.int64()

    def peeked() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    def add(conv, at: int, settled: list) -> int:
        for edit, row, role in settled:
            turn, was, text = row or (None, None, None)
            out.append((conv, at, edit, turn, was, role, None if role is None else text or ""))
            at += 1
        return at

    def sent() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names="conv place edit turn role_before role text".split())

    started, current = False, None
    for conv, turn, role, blank, again, short, text in events(peeked()):
        if not started or conv != current:
            if started:
                add(current, at, paths.end()[1])
            started, current, paths, at = True, conv, Survivors(False), 0
        if role is not None:
            at = add(conv, at, paths.row((turn, role, text), blank or again, short))
        if len(out) >= 2000:
            yield sent()
    if started:
        add(current, at, paths.end()[1])
    if out:
        yield sent()


def _run(rows: DataFrame, made, columns: str, conv_col: str, turn_col: str, role_col: str, text_col: str, copies, gone) -> DataFrame:
    storage.bound_batches(rows.sparkSession)
    ready = prepared(
        rows, conv_col, turn_col, role_col, text_col, F.lit(1) if copies is None else copies, F.lit(False) if gone is None else gone
    )
    kind = dict(rows.dtypes)[conv_col]
    return ready.mapInArrow(made, f"conv {kind}, {columns}").withColumnRenamed("conv", conv_col)


def report(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None, gone: Column | None = None,
) -> DataFrame:
    """What is wrong with each conversation and the cheapest repair.

    gaps: turns missing between the least and the greatest; a row's first fault counts as blank, duplicate (role and text are those of
    an earlier row) or truncated (its last character other than white space is not one of . ! ?); illegal: neighbours whose roles
    do not follow. cost: keeping 0, a new role 3, deleting 4 (blank rows and duplicates must go), inserting an empty row 3, a truncated
    row that stays 3 more. audit: the initials of the cheapest edits, of equal ones the least in ASCII. repaired_sha256: of the
    repaired "role:text" lines.

    A null role or text is one space. Null turns come first; rows of one turn are ordered by role, then by the digest of their text.
    Rows with a null conversation are one conversation. Repeated rows are rows. `copies` and `gone`: see `prepared`; a conversation of
    rows that are gone has zeros and an empty audit. Other columns are not read; an empty table gives no rows.
    """
    columns = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _run(rows, _reports, columns, conv_col, turn_col, role_col, text_col, copies, gone)


def edits(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None, gone: Column | None = None,
) -> DataFrame:
    """The edits of the cheapest repair, one row each, in order of `place`: the edit's initial, the turn and role of the row it is
    made on (null for inserted rows), and the role and text it leaves (null for deleted rows; inserted texts are empty). The rows
    with a role are the repaired conversation. Edge cases as in `report`."""
    columns = "place long, edit string, turn long, role_before string, role string, text string"
    return _run(rows, _edits, columns, conv_col, turn_col, role_col, text_col, copies, gone)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
    """(rows, copies, gone): the rows damaged by the crc32 of "conversation:turn" modulo 20 (nulls: one space): 0 takes a row away, 1 its
    text, 2 the . ! ? of its text, 3 gives it twice, 4 makes its role user. Rows that are taken away stay, marked."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    out = rows.select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, F.lit("user")).otherwise(F.col(role_col)).alias(role_col),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(kind == 3, 2).otherwise(1).alias("_copies"), (kind == 0).alias("_gone"),
    )
    return out, F.col("_copies"), F.col("_gone")
