"""Conversation structure repair: weighted CYK parsing of rows by a grammar of edits.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles (system, user, assistant). Each row is a terminal; the edits are its
productions: Keep (0), Rerole to user or assistant (1), Delete (2, the only one for blank and duplicate rows); user or assistant can be
inserted anywhere (5), and a truncated row that stays adds 5. What a span of rows can become is a nonterminal, by its first and last role:
nothing, ``ua``, ``au``, ``u``, ``a`` alternations, and the same after a system row. The grammar is in Chomsky normal form: X -> Y Z wherever the two
parts may stand side by side. A cell holds, for each nonterminal, the least (cost, audit), audit being the edits' initials; of two audits of one
span and cost none is the beginning of the other (it would lack an insertion), so the least parts make the least whole. Insertion closure: a cell
is combined with the cell of the empty span, from both sides.

Spans of up to ``SPAN`` rows are parsed by a full chart, by length, over all their splits. Since the nonterminals tell all that matters about a part, one split of
a longer span gives its least cells as well: longer conversations are cut into spans of ``SPAN`` rows, which are combined pairwise by length. Cells depend on the
rows' kinds only (initial and fault: nine), so a worker parses a span of the same kinds once.

Rows are dealt out by ranges of (conversation, turn, role, beginning of the text), so one conversation with a third of all rows lies in many tasks.
A task parses what it has of each conversation, holding a byte a row; texts are held up to ``HELD_BYTES`` a conversation. Only the first and the last conversation of a task
may go on elsewhere: their cells are combined along the conversation (one row a task), and their texts, in order, are hashed in a second pass.

Defined cases: nulls of role and text are a space, as are those of conv_id and turn in the key of the damage; rows of a null conv_id are one
conversation; rows of one turn stand by role and text, rows equal in all are repeats; a null turn comes first and counts for no gap. Roles of other
initials (and empty roles) cannot be kept. No rows after damage: zeros, empty audit, hash of the empty string. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stage_table

SPACE = " \t\n\x0b\x0c\r"
SPAN, HELD_BYTES = 16, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Nonterminals: "" is nothing, else first and last role of what a span becomes, after "s" if a system row leads.
ALTERNATING = ("uu", "ua", "au", "aa")
#: A row's kind is its initial (o: other), upper case if it is truncated, or - if it is blank or a duplicate.
Cell = dict[str, tuple[int, str]]


def joined(x: str, y: str) -> str | None:
    """The nonterminal of a part that became x before one that became y, if they may stand side by side."""
    if not x or not y:
        return x or y
    if y[0] == "s":
        return None
    if x == "s":
        return f"s{y}" if y[0] == "u" else None
    return x[:-1] + y[-1] if x[-1] != y[0] else None


#: X -> Y Z
RULES = {(y, z): x for y in ("", "s", *ALTERNATING, "suu", "sua") for z in ("", "s", *ALTERNATING, "suu", "sua") if (x := joined(y, z)) is not None}
EMPTY: Cell = {"": (0, ""), "uu": (INSERT, "I"), "aa": (INSERT, "I"), "ua": (2 * INSERT, "II"), "au": (2 * INSERT, "II")}


def into(cell: Cell, left: Cell, right: Cell) -> None:
    """Take up all that two parts side by side can become."""
    for y, (c, p) in left.items():
        for z, (d, q) in right.items():
            x = RULES.get((y, z))
            if x is not None:
                had = cell.get(x)
                if had is None or c + d <= had[0] and (c + d, p + q) < had:
                    cell[x] = (c + d, p + q)


def closed(cell: Cell) -> Cell:
    """With insertions before and after: more of them than the empty span's cell has never pay."""
    after, both = dict(cell), {}
    into(after, cell, EMPTY)
    both |= after
    into(both, EMPTY, after)
    return both


@lru_cache(maxsize=16)
def terminal(kind: str) -> Cell:
    """What one row can become."""
    cell: Cell = {"": (DELETE, "D")}
    if kind != "-":
        stays = TRUNCATED * kind.isupper()
        for role in "ua":
            cell[role * 2] = (KEEP + stays, "K") if kind.lower() == role else (REROLE + stays, "R")
        if kind.lower() == "s":
            cell["s"] = (KEEP + stays, "K")
    return closed(cell)


@lru_cache(maxsize=20_000)
def chart(kinds: str) -> Cell:
    """The cell of a span of at most SPAN rows: all spans by length, each from all its splits."""
    n = len(kinds)
    cells = {(i, i + 1): terminal(k) for i, k in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                into(cell, cells[i, k], cells[k, i + length])
            cells[i, i + length] = closed(cell)
    return cells[0, n] if n else EMPTY


def combined(cells: list[Cell]) -> Cell:
    """Neighbouring spans pairwise, the shortest first."""
    while len(cells) > 1:
        pairs = []
        for a, b in zip(cells[::2], cells[1::2], strict=False):
            cell: Cell = {}
            into(cell, a, b)
            pairs.append(closed(cell))
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else EMPTY


def parse(kinds: str) -> Cell:
    return combined([chart(kinds[k : k + SPAN]) for k in range(0, len(kinds), SPAN)])


def best(cell: Cell) -> tuple[int, str]:
    """The least cost and audit that give ``(s?(ua)+)?``; all rows can be deleted, so there is one."""
    return min(cell[x] for x in ("", "ua", "sua") if x in cell)


@dataclass
class Span:
    """What a task has of a conversation, or several neighbouring ones together."""

    n: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str = ""
    last: str = ""
    cell: Cell = field(default_factory=lambda: EMPTY)

    def then(self, other: Span, cell: Cell) -> Span:
        """Both, cell being theirs together."""
        if not self.n or not other.n:
            return other if not self.n else self
        between = (self.last + other.first) not in ("su", "ua", "au")
        known = self.last_turn is not None and other.first_turn is not None
        return Span(
            self.n + other.n, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + between,
            self.turns + other.turns - (known and self.last_turn == other.first_turn), self.first_turn if self.first_turn is not None else other.first_turn,
            other.last_turn if other.last_turn is not None else self.last_turn, self.first, other.last, cell,
        )

    def row(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit"""
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *best(self.cell))


class Reader:
    """Takes rows of a conversation in order."""

    def __init__(self):
        self.kinds, self.span, self.before, self.texts, self.bytes = [], Span(), None, [], 0

    def take(self, turn, role, text, h, first, copies, blank, truncated) -> None:
        for _ in range(copies):
            same = self.before == (turn, h)
            duplicate = not blank and first is not None and (same or turn != first[0])
            self.before = (turn, h)
            s = self.span
            s.blank, s.duplicate, s.truncated = s.blank + blank, s.duplicate + duplicate, s.truncated + (truncated and not blank and not duplicate)
            initial = role[:1]
            if s.n:
                s.illegal += s.last + initial not in ("su", "ua", "au")
            else:
                s.first = initial
            s.n, s.last = s.n + 1, initial
            if turn is not None:
                s.turns += s.last_turn != turn
                s.first_turn, s.last_turn = turn if s.first_turn is None else s.first_turn, turn
            kind = initial if initial and initial in "usa" else "o"
            self.kinds.append("-" if blank or duplicate else kind.upper() if truncated else kind)
            if self.texts is not None:
                self.texts.append((role, text))
                self.bytes += len(role) + len(text)
                if self.bytes > HELD_BYTES:
                    self.texts = None

    def done(self) -> Span:
        self.span.cell = parse("".join(self.kinds))
        return self.span


class Repaired:
    """The hash of a repaired conversation, from its audit and its rows in order; holds no text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.hash, self.rows = audit, 0, "", sha256(), 0

    def _put(self, role: str, text: str, initial: str) -> None:
        self.hash.update(("\n" * (self.rows > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows, self.last = self.rows + 1, initial

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._next(), "", self._next()[0])
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._put(role, text, role[0])
        elif edit == "R":
            self._put(self._next(), text, self._next()[0])

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): every row with what the damage left of it; 0 copies if it was dropped."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds blank, truncated, h (of role and text) and, where role and text stand in the conversation again, the turn where they stand first.

    First places are aggregated from hashes, without texts; only those that repeat meet the rows.
    """
    end = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({"blank": F.length(end) == 0, "truncated": ~F.right(end, F.lit(1)).isin(".", "!", "?"), "h": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("again"), "text", "role")})
    key = F.xxhash64(F.lit("conv"), "conv").alias("c")
    again = rows.where("copies > 0").groupBy(key, "h", "h2").agg(F.sum("copies").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("t"))).alias("f")).where("n > 1")
    return rows.withColumn("c", key).join(again.select("c", "h", "h2", F.array("f.t").alias("first")), ["c", "h", "h2"], "left")


def _values(b: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in b.columns), strict=True)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SPAN = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, cells array<struct<x: string, cost: long, audit: string>>"
_RESULT = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT)


def _span_row(s: Span) -> tuple:
    return (s.n, s.blank, s.duplicate, s.truncated, s.illegal, s.turns, s.first_turn, s.last_turn, s.first, s.last, [{"x": x, "cost": c, "audit": a} for x, (c, a) in s.cell.items()])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id and RESULT for each conversation of damaged rows."""
    return repair_rows(damaged(conversations)).withColumnRenamed("conv", "conv_id")


def repair_rows(rows: DataFrame) -> DataFrame:
    """conv and RESULT, of rows (conv, turn, role, text, copies)."""
    kind = rows.schema["conv"].dataType.simpleString()
    # ranges by what is short; rows that agree in it stay together, so the order within a range goes on in the next
    by = [F.col("conv"), F.col("turn"), F.substring("role", 1, 8), F.substring("text", 1, 32)]
    ordered = with_faults(rows).select("conv", "turn", "role", "text", "h", "first", "copies", "blank", "truncated").repartitionByRange(*by).sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, kept_type, out = TaskContext.get().partitionId(), None, []

        def row(conv, reader: Reader, edge: bool) -> tuple:
            span = reader.done()
            whole = not edge and reader.texts is not None
            if not whole:
                return (conv, pid, False, *_span_row(span), *[None] * len(RESULT))
            result = span.row()
            text = Repaired(result[-1])
            for role, t in reader.texts:
                text.take(role, t)
            return (conv, pid, True, *[None] * 11, *result, text.digest())

        def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int32(), pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.struct([("x", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])), *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        now, reader, seen = None, None, 0
        for b in pieces(batches):
            for conv, *values in _values(b):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(row(now, reader, seen == 0))
                        seen += 1
                    now, reader = conv, Reader()
                reader.take(*values)
            kept_type = b.column(0).type
            if len(out) > 2000:
                yield batch(out, kept_type)
                out = []
        if reader is not None:
            out.append(row(now, reader, True))  # the last of a task may go on in the next
            yield batch(out, kept_type)

    names = ["conv", "at", "whole", *[c.split()[0] for c in _SPAN.split(", ")[:10]], "cells", *[f"r_{c}" for c in RESULT]]
    schema = f"conv {kind}, at int, whole boolean, {_SPAN}, " + ", ".join(f"r_{x}" for x in _RESULT.split(", "))
    parsed = stage_table(ordered.mapInArrow(run, schema), "parsed")
    done = parsed.where("whole").select("conv", *[F.col(f"r_{c}").alias(c) for c in RESULT])

    def along(t: pa.Table) -> pa.Table:
        """The spans of a conversation, one a task, in order."""
        spans = []
        for r in sorted(t.to_pylist(), key=lambda r: r["at"]):
            cell = {c["x"]: (c["cost"], c["audit"]) for c in r["cells"]}
            spans.append(Span(r["n"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["turns"], r["first_turn"], r["last_turn"], r["first"], r["last"], cell))
        cell = combined([s.cell for s in spans])
        total = Span()
        for s in spans:
            total = total.then(s, cell)
        total.cell = cell
        return pa.table({"conv": t["conv"].slice(0, 1)} | {c: pa.array([v], pa.string() if c == "audit" else pa.int64()) for c, v in zip(RESULT[:-1], total.row(), strict=True)})

    edges = parsed.where("not whole").select("conv", "at", *[c.split()[0] for c in _SPAN.split(", ")[:10]], "cells")
    cut = stage_table(edges.groupBy("conv").applyInArrow(along, f"conv {kind}, " + ", ".join(_RESULT.split(", ")[:-1])), "cut")
    return done.unionByName(hashed(rows, cut, kind))


def hashed(rows: DataFrame, cut: DataFrame, kind: str) -> DataFrame:
    """cut (conv and RESULT without its hash) with the hash: each conversation's audit, then its rows in order, go through one task, which holds no text."""
    nothing = lambda t: F.lit(None).cast(t)
    head = cut.select("conv", F.lit(0).alias("part"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("int").alias("copies"), *RESULT[:-1])
    # as many keys as twice the tasks before
    own = rows.join(cut.select(F.col("conv").alias("__conv")).distinct(), F.col("conv").eqNullSafe(F.col("__conv")), "left_semi").where("copies > 0")
    body = own.select("conv", F.lit(1).alias("part"), "turn", "role", "text", "copies", *[nothing("string" if c == "audit" else "long").alias(c) for c in RESULT[:-1]])
    stream = head.unionByName(body).repartition(F.xxhash64("conv")).sortWithinPartitions(F.xxhash64("conv"), "conv", "part", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = text = None

        def out() -> pa.RecordBatch:
            values = (*held, text.digest())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["conv", *RESULT])

        for b in pieces(batches):
            types = [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, part, _, role, t, copies, *result in _values(b):
                if part == 0:
                    if held is not None:
                        yield out()
                    held, text = (conv, *result), Repaired(result[-1])
                else:
                    for _ in range(copies):
                        text.take(role, t)
        if held is not None:
            yield out()

    return stream.mapInArrow(run, f"conv {kind}, {_RESULT}")


SQL = r"""
with recursive d0 as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: ascii(x)) bytes from conversations),
d1 as (select *, xor(list_reduce(flatten([[4294967295::bigint], flatten(list_transform(bytes, lambda x: [x::bigint, 0, 0, 0, 0, 0, 0, 0]))]),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint) % 20 hit from d0),
d2 as (select conv_id, turn, case when hit = 4 then 'user' else role end role, case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end text, unnest(case hit when 0 then [] when 3 then [1, 2] else [1] end) copy from d1),
d3 as (select *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) last_char, row_number() over (partition by conv_id order by turn nulls first, role, text) i,
    left(role, 1) initial from d2),
d4 as (select *, case when last_char = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when last_char not in ('.', '!', '?') then 'truncated' else '' end fault,
    lag(initial) over (partition by conv_id order by i) before from d3),
e as (select unnest([{'st': '', 'c': 0, 'p': '', 'x': ''}, {'st': 'u', 'c': 5, 'p': 'I', 'x': chr(10) || 'user:'}, {'st': 'a', 'c': 10, 'p': 'II', 'x': chr(10) || 'user:' || chr(10) || 'assistant:'}], recursive := true)),
steps as (
    select conv_id, 0::bigint i, e.st, {'c': e.c::bigint, 'p': e.p, 'r': e.x} v from (select distinct conv_id from conversations), e
    union all
    select conv_id, i, st, min(v) v from (
        select conv_id, i, o.st st, {'c': c + o.c, 'p': p || o.p, 'r': r || o.x} v from (
            select conv_id, i, n.st st, n.c c, n.p p, n.x r from (
                select d.conv_id, d.i, unnest([
                    {'st': s.st, 'c': s.v.c + 2, 'p': s.v.p || 'D', 'x': s.v.r},
                    case when fault in ('', 'truncated') and (initial = 's' and st = '' or initial = 'u' and st <> 'u' or initial = 'a' and st = 'u')
                        then {'st': initial, 'c': s.v.c + case fault when '' then 0 else 5 end, 'p': s.v.p || 'K', 'x': s.v.r || chr(10) || role || ':' || text} end,
                    case when fault in ('', 'truncated') then {'st': case st when 'u' then 'a' else 'u' end, 'c': s.v.c + 1 + case fault when '' then 0 else 5 end, 'p': s.v.p || 'R',
                        'x': s.v.r || chr(10) || case st when 'u' then 'assistant' else 'user' end || ':' || text} end]) n
                from steps s join d4 d on s.conv_id is not distinct from d.conv_id and d.i = s.i + 1) where n is not null),
            lateral (select unnest([{'st': st, 'c': 0, 'p': '', 'x': ''}, {'st': case st when 'u' then 'a' else 'u' end, 'c': 5, 'p': 'I', 'x': chr(10) || case st when 'u' then 'assistant:' else 'user:' end}]) o))
    group by all),
n as (select conv_id, count(*) rows from d4 group by conv_id),
cheapest as (select s.conv_id, min(v) v from steps s left join n on s.conv_id is not distinct from n.conv_id where s.st in ('', 'a') and s.i = coalesce(n.rows, 0) group by s.conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
    count(*) filter (fault = 'truncated') truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal from d4 group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
    v.c::bigint as cost, v.p audit, sha256(substr(v.r, 2)) repaired_sha256 from cheapest c left join counts k on c.conv_id is not distinct from k.conv_id
"""
