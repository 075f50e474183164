"""Repair of conversation structure: the cheapest edits that make turns alternate, of equally cheap ones the least in order.

Persistent audit DP: for each state (nothing yet, after system, after user, after assistant) the best edits of the rows so far are a linked node,
which shares its prefix with the others. A node knows its ancestors 1, 2, 4, ... steps up and a rolling hash of all its edits,
so two audits of equal cost are compared by a search for their longest common prefix; equal hashes are verified edit by edit.
An audit is a sequence of tokens, one for each row (the letters up to and with the row's own), and no token begins another, so the order of
audits is that of their tokens.

A long conversation is cut into blocks. A block's answer is a table from each state before it to each state behind it (cost, and the rank of the
audit among those of the block), and the same DP runs over the blocks; then each block writes the audit that was chosen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm.ordering import placed
from ward_analytics.llm.tables import cut

#: Rows of a conversation that are solved together.
BLOCK = 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The edits of a row in ASCII order: deleted, or kept or given another role, with or without a turn inserted before. Two turns
#: inserted before a row lead where none do, and one inserted before a deleted row is better inserted behind it.
TOKENS = ("D", "IK", "IR", "K", "R")
#: What a conversation needs at its end, by state: cost and letters.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("none", "blank", "duplicate", "truncated")
SPACE = " \t\n\x0b\x0c\r"
_BASE, _MODULUS = 0x1F3D5B79, (1 << 61) - 1


def _after(state: int) -> int:
    """The state behind the turn that must come next, user or assistant."""
    return ASSISTANT if state == USER else USER


def _edges(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """What may be done with a row: state before, state behind, cost, token."""
    found = [(p, p, DELETE, 0) for p in range(4)]
    if fault in ("blank", "duplicate"):
        return found
    extra = TRUNCATED if fault == "truncated" else 0
    for p in range(4):
        for insert in (0, 1):
            q = _after(p) if insert else p
            cost = insert * INSERT + extra
            keeps = {"s": q == START, "u": q != USER, "a": q == USER}.get(initial, False)
            if keeps:
                found.append((p, SYSTEM if initial == "s" else _after(q), cost + KEEP, 1 if insert else 3))
            found.append((p, _after(q), cost + REROLE, 2 if insert else 4))
    return found


#: By kind: 4 times the place of the role's initial among s, u, a, any other, plus the fault.
EDGES = [_edges(initial, fault) for initial in ("s", "u", "a", "") for fault in FAULTS]


class Audits:
    """Edit prefixes as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.token, self.state, self.hash, self.up = [-1], [-1], [0], [()]

    def add(self, parent: int, token: int, state: int) -> int:
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.token.append(token)
        self.state.append(state)
        self.hash.append((self.hash[parent] * _BASE + token + 1) % _MODULUS)
        self.up.append(tuple(up))
        return len(self.token) - 1

    def compare(self, a: int, b: int) -> int:
        """Below, at or above 0 as audit a comes before b, equals it or comes after; both have the same number of tokens."""
        if a == b:
            return 0
        if self.hash[a] != self.hash[b]:
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            return self._verify(self.up[a][0], self.up[b][0]) or self.token[a] - self.token[b]
        return self._verify(a, b)

    def _verify(self, a: int, b: int) -> int:
        """0 if the audits are equal token by token, else their order: equal hashes alone prove nothing."""
        order = 0
        while a != b:
            order = self.token[a] - self.token[b] or order
            a, b = self.up[a][0], self.up[b][0]
        return order

    def path(self, node: int) -> list[tuple[int, int]]:
        """Tokens with the states behind them, from the first."""
        found = []
        while node:
            found.append((self.token[node], self.state[node]))
            node = self.up[node][0]
        return found[::-1]


def solve(steps: list, start: int) -> tuple[Audits, dict[int, tuple[int, int]]]:
    """For each state that can be reached: the least cost, and the node of the least audit of that cost. A step is a list of edges (state before,
    state behind, cost, token)."""
    audits = Audits()
    live = {start: (0, 0)}
    for edges in steps:
        best: dict[int, tuple[int, int, int]] = {}
        for p, q, cost, token in edges:
            if p in live:
                total, parent = live[p][0] + cost, live[p][1]
                old = best.get(q)
                if old is None or total < old[0] or (
                    total == old[0] and (audits.compare(parent, old[1]) or token - old[2]) < 0
                ):
                    best[q] = (total, parent, token)
        live = {q: (total, audits.add(parent, token, q)) for q, (total, parent, token) in best.items()}
    return audits, live


def finish(audits: Audits, live: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the best way to end."""
    best = None
    for state, (cost, node) in live.items():
        total = cost + ENDS[state][0]
        if best is None or total < best[0] or (total == best[0] and audits.compare(node, best[2]) < 0):
            best = (total, state, node)
    return best[0], best[1]


def text_of(audits: Audits, node: int) -> str:
    return "".join(TOKENS[t] for t, _ in audits.path(node))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow one another with equal keys, across batches: the keys and the lists of values."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        value = zip(*(batch.column(v).to_pylist() for v in values), strict=True)
        for k, v in zip(key, value, strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(v)
    if held:
        yield now, held


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EDGE = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])
_SOLVED = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("letters", pa.string()), ("cost", pa.int64()),
    ("edges", pa.list_(_EDGE)), ("faults", pa.list_(pa.int64())),
])
_SOLVED_DDL = "conv string, block long, n long, letters string, cost long, edges array<struct<p:int,q:int,cost:long,rank:int>>, faults array<long>"


def _solver(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[tuple]:
            for (conv, block), rows in _runs(batches, ["conv", "block"], ["n", "kind"]):
                n, steps = rows[0][0], [EDGES[kind] for _, kind in rows]
                faults = [0] * len(FAULTS)
                for _, kind in rows:
                    faults[kind % 4] += 1
                if n <= block_rows:
                    audits, live = solve(steps, START)
                    cost, state = finish(audits, live)
                    yield conv, block, n, text_of(audits, live[state][1]) + ENDS[state][1], cost, None, faults
                    continue
                found = []
                for p in range(4) if block else (START,):
                    audits, live = solve(steps, p)
                    found += [(text_of(audits, node), p, q, cost) for q, (cost, node) in live.items()]
                ranks = {x: i for i, x in enumerate(sorted({x for x, *_ in found}))}
                edges = [{"p": p, "q": q, "cost": cost, "rank": ranks[x]} for x, p, q, cost in found]
                yield conv, block, n, None, None, edges, faults

        yield from _batched(answers(), _SOLVED)

    return run


_CHOSEN = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("last", pa.bool_())])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a long conversation the states before and behind it; the whole cost at the last one."""

    def answers() -> Iterator[tuple]:
        for (conv,), blocks in _runs(batches, ["conv"], ["block", "edges"]):
            audits, live = solve([[(e["p"], e["q"], e["cost"], e["rank"]) for e in edges] for _, edges in blocks], START)
            cost, state = finish(audits, live)
            p = START
            for i, ((block, _), (_, q)) in enumerate(zip(blocks, audits.path(live[state][1]), strict=True), 1):
                last = i == len(blocks)
                yield conv, block, p, q, cost if last else 0, last
                p = q

    yield from _batched(answers(), _CHOSEN)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each block between its chosen states."""

    def answers() -> Iterator[tuple]:
        for (conv, block), rows in _runs(batches, ["conv", "block"], ["kind", "p", "q", "cost", "last"]):
            _, p, q, cost, last = rows[0]
            audits, live = solve([EDGES[r[0]] for r in rows], p)
            yield conv, block, text_of(audits, live[q][1]) + (ENDS[q][1] if last else ""), cost

    yield from _batched(answers(), pa.schema([("conv", pa.string()), ("block", pa.int64()), ("letters", pa.string()), ("cost", pa.int64())]))


def _conv(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _text_key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _kinds(rows: DataFrame) -> DataFrame:
    """conv, place, n and kind of every row: a row is a duplicate if its role and text stand at an earlier place."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    shape = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = cut(rows.select(_conv().alias("conv"), "turn", "role", _text_key().alias("digest"), shape.alias("shape"), code.alias("code")))
    ranked = cut(placed(narrow, ["conv"], ["turn", "role", "digest"]).select("conv", "place", "n", "role", "digest", "shape", "code"))
    firsts = ranked.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("shape") == 1, 1).when(F.col("is_first").isNull(), 2).otherwise(F.col("shape"))
    return ranked.join(firsts, ["conv", "place"], "left").select("conv", "place", "n", (F.col("code") * 4 + fault).cast("int").alias("kind"))


def audits(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """For each block of each conversation: conv, block, letters, cost (summed over blocks it is the conversation's) and the number of rows by first fault."""
    kinds = _kinds(rows).withColumn("block", F.floor(F.col("place") / block_rows))
    ordered = kinds.repartition("conv", "block").sortWithinPartitions("conv", "block", "place").select("conv", "block", "n", "kind")
    solved = cut(ordered.mapInArrow(_solver(block_rows), _SOLVED_DDL))
    short = solved.where(F.col("n") <= block_rows).select("conv", "block", "letters", "cost", "faults")
    long = solved.where(F.col("n") > block_rows)
    if not long.take(1):
        return short
    chosen = (
        long.select("conv", "block", "edges").repartition("conv").sortWithinPartitions("conv", "block")
        .mapInArrow(_choose, "conv string, block long, p int, q int, cost long, last boolean")
    )
    again = kinds.join(cut(chosen), ["conv", "block"]).repartition("conv", "block").sortWithinPartitions("conv", "block", "place")
    letters = again.select("conv", "block", "kind", "p", "q", "cost", "last").mapInArrow(_write, "conv string, block long, letters string, cost long")
    return short.unionByName(letters.join(long.select("conv", "block", "faults"), ["conv", "block"]))


_PAIRS = ("su", "ua", "au")
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """One conversation as its sorted rows pass by: first the audit, then the turns."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.at, self.state = conv_id, [], 0, START
        self.cost, self.faults = 0, [0] * len(FAULTS)
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.illegal, self.initial = 0, None
        self.sha, self.seq = hashlib.sha256(), 0
        self.audit = None

    def answer(self, letters: str, cost: int, faults: list[int]) -> None:
        self.letters.append(letters)
        self.cost += cost
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]

    def _turn(self, edit: str, role: str, text: str) -> tuple:
        self.sha.update((("\n" if self.seq else "") + f"{role}:{text}").encode())
        self.seq += 1
        return self.conv_id, self.seq - 1, edit, role, text

    def _inserted(self) -> tuple:
        self.state = _after(self.state)
        return self._turn("Insert", ROLES[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> list[tuple]:
        """The turns of the repaired conversation up to and with this row."""
        if self.audit is None:
            self.audit = "".join(self.letters)
        if turn is not None:
            self.turns += self.last_turn != turn or self.low is None
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in _PAIRS
        self.initial = role[:1]
        found = []
        while self.audit[self.at] == "I":
            found.append(self._inserted())
            self.at += 1
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == "s" else _after(self.state)
            found.append(self._turn("Keep", role, text))
        elif edit == "R":
            self.state = _after(self.state)
            found.append(self._turn("Rerole", ROLES[self.state], text))
        return found

    def end(self) -> list[tuple]:
        self.audit = "".join(self.letters) if self.audit is None else self.audit
        return [self._inserted() for _ in self.audit[self.at :]]

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, self.audit, self.sha.hexdigest()


def _finisher(turns: bool, id_type: pa.DataType):
    names = ["conv_id", "turn", "role", "text", "letters", "cost", "faults"]
    if turns:
        schema = pa.schema([("conv_id", id_type), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    else:
        schema = pa.schema(
            [("conv_id", id_type)] + [(c, pa.int64()) for c in _COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[tuple]:
            now, c = None, None
            for batch in batches:
                conv = batch.column("conv").to_pylist()
                for k, (conv_id, turn, role, text, letters, cost, faults) in zip(
                    conv, zip(*(batch.column(x).to_pylist() for x in names), strict=True), strict=True
                ):
                    if k != now:
                        if c is not None:
                            last = c.end()
                            yield from last if turns else [c.summary()]
                        now, c = k, _Conversation(conv_id)
                    if letters is not None:
                        c.answer(letters, cost, faults)
                    elif role is not None:
                        found = c.row(turn, role, text)
                        if turns:
                            yield from found
            if c is not None:
                last = c.end()
                yield from last if turns else [c.summary()]

        yield from _batched(answers(), schema)

    return run


def repair(rows: DataFrame, known: DataFrame | None = None, turns: bool = False, block_rows: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; with ``turns`` the turns of the
    repaired conversations instead: conv_id, seq (from 0), edit, role and text.

    rows: conv_id, turn, role, text. Null roles and texts are one space; a null conv_id is a conversation of its own; rows go by turn, null first,
    and those of equal turn by role and the digest of their text. Conversations of ``known`` (conv_id) without rows get
    zeros, an empty audit and the hash of an empty string. Repeated rows are duplicates of the first; extra columns
    count for nothing; an empty table gives an empty table. ``rows`` is read twice, so it must not change between.

    Texts pass once more, sorted by conversation, and are hashed as they pass: a hash runs from a conversation's first byte to
    its last, so this much is one task's, in a memory of one batch and one letter a row.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = audits(rows, block_rows)
    columns = {
        "conv": "string", "conv_id": rows.schema["conv_id"].dataType, "kind": "int", "block": "long", "turn": rows.schema["turn"].dataType, "role": "string",
        "digest": "binary", "text": "string", "letters": "string", "cost": "long", "faults": "array<long>",
    }
    shape = lambda df, **given: df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    col = lambda *cs: {c: F.col(c) for c in cs}
    parts = shape(rows, conv=_conv(), kind=F.lit(2), digest=_text_key(), **col("conv_id", "turn", "role", "text"))
    parts = parts.unionByName(shape(found, kind=F.lit(1), **col("conv", "block", "letters", "cost", "faults")))
    named = rows.select("conv_id") if known is None else rows.select("conv_id").unionByName(known.select("conv_id"))
    parts = parts.unionByName(shape(named.distinct(), conv=_conv(), kind=F.lit(0), **col("conv_id")))
    ordered = parts.repartition("conv").sortWithinPartitions("conv", "kind", "block", "turn", "role", "digest")
    id_type = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ddl = f"conv_id {id_type.simpleString()}, " + (
        "seq long, edit string, role string, text string" if turns
        else ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    )
    return ordered.drop("kind", "block", "digest").mapInArrow(_finisher(turns, to_arrow_type(id_type)), ddl)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as a faulty recorder leaves them, by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties its text,
    2 takes the marks .!? out of it, 3 repeats the row, 4 makes it the user's; null roles and texts become one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).cast("int")
    text = F.when(case == 1, "").when(case == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(case == 4, "user").otherwise(part("role"))
    copies = F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
