"""Conversation structure repair by a generalised LR parse over the role grammar.

The legal order of roles is a grammar over their initials, `(s?(ua)+)?`.  An LR(0)
automaton is built from its rules.  Rows are read in order; each may be kept,
reroled or deleted, and turns may be inserted before any of them.  All ways to go on
live in a graph-structured stack: a node is a state of the automaton on top of
another node, and stacks share what is below them.  Ways that lead to equal stack
tops are merged, and the one of smallest (cost, audit) stays; the audit is the
string of edit initials, compared in ASCII order.

Audits are not compared as strings, which would take the square of a conversation's
length.  The audits of all tops that have read the same rows end in the edit of the
last row, so none is a prefix of another; their order is kept as a rank, and after
the next row it follows from (rank, letters added).  A top also carries the digest
of its repaired turns so far, so texts are never held: the parse of a conversation
reads its rows as a stream, in constant memory but for the audit itself, which is
part of the result.

Spark deals rows by conversation, marks rows seen earlier in their conversation,
sorts by turn (spilling if needed) and streams them through the parser.

Defined results: a null conversation id is a conversation of its own; a null id or
turn in a damage key, a null role and a null text count as one space; null turns come
first, rows of one turn are ordered by role (before damage) and text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

# The costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Roles that rows can be given or inserted with, by initial.
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
DAMAGES = 20
DROP, EMPTY, STRIP, REPEAT, MISNAME = range(5)

#: The role grammar.  `chat` is the start symbol; single letters are role initials.
GRAMMAR = (("chat", ()), ("chat", ("body",)), ("chat", ("s", "body")),
           ("body", ("pair",)), ("body", ("body", "pair")), ("pair", ("u", "a")))

Item = tuple[int, int]  # a rule, and how much of it has been read
#: A state on top of the node below it; the bottom node has none below.
Node = tuple[int, "Node | None"]


class Automaton:
    """LR(0) states of a grammar, and the moves of stacks over them."""

    def __init__(self, grammar: tuple[tuple[str, tuple[str, ...]], ...] = GRAMMAR):
        self.grammar = grammar
        self.start = grammar[0][0]
        self.states: list[frozenset[Item]] = []
        self.goto: dict[tuple[int, str], int] = {}
        names = {n for _, body in grammar for n in body}
        todo = [self._closed({(r, 0) for r, (head, _) in enumerate(grammar) if head == self.start})]
        while todo:
            state = todo.pop(0)
            if state in self.states:
                continue
            self.states.append(state)
            todo += [self._moved(state, n) for n in sorted(names) if self._moved(state, n)]
        for k, state in enumerate(self.states):
            for name in names:
                if moved := self._moved(state, name):
                    self.goto[k, name] = self.states.index(moved)
        self.moves: dict[tuple[Node, str], list[Node]] = {}

    def _next(self, item: Item) -> str | None:
        rule, read = item
        body = self.grammar[rule][1]
        return body[read] if read < len(body) else None

    def _closed(self, items: set[Item]) -> frozenset[Item]:
        while True:
            heads = {self._next(i) for i in items}
            more = items | {(r, 0) for r, (head, _) in enumerate(self.grammar) if head in heads}
            if more == items:
                return frozenset(items)
            items = more

    def _moved(self, state: frozenset[Item], name: str) -> frozenset[Item]:
        return self._closed({(r, read + 1) for r, read in state if self._next((r, read)) == name})

    def _finished(self, node: Node) -> list[tuple[str, tuple[str, ...]]]:
        return [self.grammar[i[0]] for i in self.states[node[0]] if self._next(i) is None]

    def shift(self, node: Node, name: str) -> list[Node]:
        """Stacks after reading `name`; stacks of this grammar are few and remembered."""
        if (node[0], name) not in self.goto:
            return []
        if (node, name) not in self.moves:
            self.moves[node, name] = self._shifted(node, name)
        return self.moves[node, name]

    def _shifted(self, node: Node, name: str) -> list[Node]:
        """What is complete is reduced, but for the start symbol, which waits for the end."""
        out, todo = [], [(self.goto[node[0], name], node)]
        while todo:
            top = todo.pop()
            done = [rule for rule in self._finished(top) if rule[0] != self.start]
            if not done or any(self._next(i) for i in self.states[top[0]]):
                out.append(top)
            for head, body in done:
                below = top
                for _ in body:
                    below = below[1]
                todo.append((self.goto[below[0], head], below))
        return out

    def accepts(self, node: Node) -> bool:
        """Whether the input may end here."""
        return any(head == self.start for head, _ in self._finished(node))


AUTOMATON = Automaton()


class Way:
    """The best way to a stack top.  `rank` orders audits up to the last row read and
    `letters` are the edits since; `turns` (role, text) wait to join the digest."""

    __slots__ = ("cost", "rank", "letters", "turns", "digest", "back")

    def __init__(self, cost: int, rank: int, letters: str, turns: tuple, digest, back):
        self.cost, self.rank, self.letters = cost, rank, letters
        self.turns, self.digest, self.back = turns, digest, back

    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.letters

    def then(self, cost: int, letter: str, turn: tuple = ()) -> Way:
        return Way(self.cost + cost, self.rank, self.letters + letter, self.turns + turn,
                   self.digest, self.back)


class Repair:
    """Repair of one conversation whose rows come one by one."""

    def __init__(self, automaton: Automaton = AUTOMATON):
        self.automaton = automaton
        self.tops: dict[Node, Way] = {(0, None): Way(0, 0, "", (), None, None)}

    def _inserted(self) -> dict[Node, Way]:
        """The tops and all that inserted turns lead to; cheaper ways go first."""
        found = dict(self.tops)
        todo = list(found)
        while todo:
            node = todo.pop(0)
            for name, role in ROLES.items():
                way = found[node].then(INSERT, "I", ((role, ""),))
                for top in self.automaton.shift(node, name):
                    if top not in found or way.key() < found[top].key():
                        found[top] = way
                        todo.append(top)
        return found

    def read(self, role: str, text: str, initial: str, must_go: bool, truncated: bool) -> None:
        """All edits of the next row."""
        merged: dict[Node, Way] = {}

        def meet(top: Node, way: Way) -> None:
            if top not in merged or way.key() < merged[top].key():
                merged[top] = way

        more = TRUNCATED if truncated else 0
        for node, way in self._inserted().items():
            meet(node, way.then(DELETE, "D"))
            if must_go:
                continue
            for top in self.automaton.shift(node, initial):
                meet(top, way.then(KEEP + more, "K", ((role, text),)))
            for name, other in ROLES.items():
                for top in self.automaton.shift(node, name):
                    meet(top, way.then(REROLE + more, "R", ((other, text),)))
        audits = {a: k for k, a in enumerate(sorted({(w.rank, w.letters) for w in merged.values()}))}
        self.tops = {node: Way(w.cost, audits[w.rank, w.letters], "", (), _hashed(w.digest, w.turns),
                               (w.back, w.letters)) for node, w in merged.items()}

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, and digest of the repaired turns."""
        ends = [w for node, w in self._inserted().items() if self.automaton.accepts(node)]
        best = min(ends, key=Way.key)
        digest = _hashed(best.digest, best.turns) or hashlib.sha256()
        letters, back = [best.letters], best.back
        while back:
            letters.append(back[1])
            back = back[0]
        return best.cost, "".join(reversed(letters)), digest.hexdigest()


def _hashed(digest, turns: tuple):
    """The digest with some turns more, each `role:text` on a line of its own."""
    if not turns:
        return digest
    lines = "\n".join(f"{role}:{text}" for role, text in turns).encode("utf-8", "replace")
    if digest is None:
        return hashlib.sha256(lines)
    digest = digest.copy()
    digest.update(b"\n" + lines)
    return digest


# --- rows ---------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage by the hash of id and turn.  A dropped row keeps its id and has
    `gone` set; a repeated one has two copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % DAMAGES
    copies = F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    bare = F.when(kind == EMPTY, F.lit("")).when(
        kind == STRIP, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select(
        "conv_id", "turn", text("role").alias("_was"),
        F.when(kind == MISNAME, F.lit("user")).otherwise(text("role")).alias("role"),
        bare.alias("text"), (kind == DROP).alias("gone"), F.explode(copies).alias("_copy"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds the first fault of each row (`blank`, `duplicate`, `truncated` or null) and
    orders each conversation within its partition.

    Rows are dealt once, by conversation; the window that looks for earlier rows of the
    same role and text needs no other exchange.
    """
    order = ["turn", "_was", "text", "_copy"]
    dealt = rows.repartition("conv_id").withColumn("_hash", F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "gone", "role", "_hash").orderBy(*order)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    return (dealt.withColumn("fault", F.when(~F.col("gone"), fault))
            .sortWithinPartitions("conv_id", *order)
            .select("conv_id", "turn", "role", "text", "gone", "fault"))


REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string, repaired_sha256 string")


class Report:
    """What is told of one conversation, gathered row by row."""

    def __init__(self):
        self.repair = Repair()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL_PAIRS
        self.initial = initial
        self.repair.read(role, text, initial, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, *self.repair.result()


def repaired(rows: DataFrame) -> DataFrame:
    """One row of `REPORT` per conversation of `rows(conv_id, turn, role, text, gone,
    fault)`, which `marked` has put in order."""
    small_batches(rows.sparkSession)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {REPORT}"
    names = ["conv_id", *[part.split()[0] for part in REPORT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, report, out = None, None, []
        packed = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(c), None if k else kind) for k, c in enumerate(zip(*out))], names)
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if report is None or conv != key:
                    if report:
                        out.append((key, *report.row()))
                    key, report = conv, Report()
                if not gone:
                    report.read(turn, role, text, fault)
            if len(out) > 1000:
                yield packed()
                out = []
        if report:
            out.append((key, *report.row()))
            yield packed()

    return rows.mapInArrow(run, schema)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The damaged conversations, repaired."""
    return repaired(marked(damaged(conversations)))
