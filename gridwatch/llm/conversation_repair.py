"""Conversation structure repair: cheapest edits of each conversation's turns, with faults counted and an audit.

Rows are range-partitioned and sorted by conv_id, turn (nulls first), role and text, which deals one large
conversation to many tasks. A conversation of at most ``BLOCK`` rows inside one partition is repaired there (see ``edit_lattice``).
What remains, at most two conversations at the edges of each partition and the large ones, goes on as blocks of ``BLOCK`` rows:
each block is searched from every state to every state, a scan over the blocks' costs and audits (not their texts)
picks the states between blocks, and a second scan hashes the repaired texts of the blocks in order without holding
them. Repeats of such rows are told by the first place of each role and text, an aggregation.

A null role or text counts as one space, and rows of a null conv_id as one conversation; a null turn sorts first and leaves no
gap. Rows with equal turns go by role, then text; equal rows stand side by side and all but the first are
repeats. Empty and very long texts are rows like others. A conversation without rows has zeros and an empty audit, and
the hash of nothing. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .edit_lattice import BLANK, DUPLICATE, ENDS, LEGAL, TRUNCATED, edited, fault, search, summary

#: Rows of a block, and of the largest conversation that one step repairs.
BLOCK = 256
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = "turns array<struct<role:string,text:string>>"
_PASS = f"conv_id bigint, block bigint, seq int, turn bigint, role string, text string, {_REPORT}, {_TURNS}"
_BLOCK = "block bigint, conv_id string, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, paths array<struct<before:int,after:int,cost:bigint,audit:string>>"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the CRC of ``conv_id:turn`` modulo 20: dropped, emptied, without end marks, repeated, given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _hashed(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles))


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(rows: list[tuple[int | None, str, str]]) -> tuple[list, list[tuple[str, str]]]:
    """The report of one conversation, and its repaired turns."""
    seen: set[tuple[str, str]] = set()
    kinds = []
    for _, role, text in rows:
        kind = fault(text)
        if kind != BLANK and (role, text) in seen:
            kind = DUPLICATE
        seen.add((role, text))
        kinds.append(kind)
    turns = [(r, t) for _, r, t in rows]
    cost, audit = search([(r[:1], k) for (r, _), k in zip(turns, kinds, strict=True)])
    after = edited(turns, audit)
    counts = [kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
    return [_gaps([t for t, _, _ in rows]), *counts, _illegal([r for r, _ in turns]), cost, audit, _hashed(after)], after


def _first_pass(rows: DataFrame, turns: bool) -> DataFrame:
    """A row for each repaired conversation, and the rows of all others with their block and place."""
    # equal rows are told apart by their place in the input, so that no value is too common to be split
    placed = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.monotonically_increasing_id().alias("at"))
    keys = ["conv_id", "turn", "role", "text", "at"]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at")
    names = [x.strip().split()[0] for x in f"conv_id, block, seq, turn, role, text, {_REPORT}, turns".split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), *([pa.int64()] * len(COUNTS)), pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, block, nothing = TaskContext.get().partitionId() << 32, 0, [None] * (len(COUNTS) + 3)
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out, size = [], 0
            return batch

        def passed_on(conv: int | None, rows: list) -> None:
            nonlocal block, size
            for seq, (turn, role, text) in enumerate(rows):
                out.append([conv, base + block, seq, turn, role, text, *nothing])
                size += len(text) + 100
            block += 1

        conv, held, inner = None, [], False  # inner: the conversation begins inside this partition and no row of it is passed on
        begun = False
        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if begun and c != conv:
                    if inner and len(held) <= BLOCK:
                        report, after = _whole(held)
                        out.append([conv, None, None, None, None, None, *report, [{"role": r, "text": t} for r, t in after] if turns else None])
                        size += len(report[-2]) + 200 + (sum(len(t) for _, t in after) if turns else 0)
                    elif held:
                        passed_on(conv, held)
                    held, inner = [], True
                elif len(held) >= BLOCK:
                    passed_on(conv, held)
                    held, inner = [], False
                conv, begun = c, True
                held.append(tuple(row))
                if size > 1 << 22:
                    yield flush()
        if held:
            passed_on(conv, held)  # the next partition may hold more of it
        if out:
            yield flush()

    return dealt.mapInArrow(run, _PASS)


def _blocks(rest: DataFrame) -> DataFrame:
    """Blocks of the conversations that the first pass left, with the cheapest edits between any two states."""
    first = rest.groupBy("conv_id", "role", "text").agg(F.min(F.struct("block", "seq")).alias("first"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.text") == F.col("f.text"))
    marked = rest.alias("r").join(first.alias("f"), same).select("r.block", "r.seq", "r.conv_id", "r.role", "r.text", (F.struct("r.block", "r.seq") > F.col("f.first")).alias("again"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        roles, texts = part["role"].tolist(), part["text"].tolist()
        kinds = [fault(t) for t in texts]
        kinds = [DUPLICATE if again and k != BLANK else k for k, again in zip(kinds, part["again"], strict=True)]
        paths = [{"before": p, "after": q, "cost": c, "audit": a} for p, q, c, a in summary([(r[:1], k) for r, k in zip(roles, kinds, strict=True)])]
        row = [part["block"].iloc[0], part["conv_id"].iloc[0], roles, texts, *(kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), _illegal(roles), roles[0], roles[-1], paths]
        return pd.DataFrame([row], columns=[x.split()[0] for x in _BLOCK.split(", ")])

    return marked.groupBy("block").applyInPandas(run, _BLOCK)  # at most BLOCK rows each


def _chosen(blocks: DataFrame) -> DataFrame:
    """``block, before, cost, audit``: each block's part of its conversation's cheapest edits, by a scan in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ended(states: dict) -> pd.DataFrame:
            _, _, at = min(states[q] for q in ENDS if q in states)
            out = []
            while at is not None:
                at, choice = at
                out.append(choice)
            return pd.DataFrame(out, columns=["block", "before", "cost", "audit"])

        conv, states = None, None
        for frame in frames:
            for block, c, paths in zip(frame["block"], frame["conv_id"], frame["paths"], strict=True):
                if states is not None and c != conv:
                    yield ended(states)
                    states = None
                if states is None:
                    conv, states = c, {0: (0, "", None)}
                after: dict = {}
                for x in paths:
                    if x["before"] in states:
                        cost, audit, at = states[x["before"]]
                        new = (cost + x["cost"], audit + x["audit"])
                        if x["after"] not in after or new < after[x["after"]][:2]:
                            after[x["after"]] = (*new, (at, (block, x["before"], x["cost"], x["audit"])))
                states = after
        if states is not None:
            yield ended(states)

    narrow = blocks.select("block", "conv_id", "paths").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return narrow.mapInPandas(run, "block bigint, before int, cost bigint, audit string")


_PIECE = "block bigint, conv_id string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, cost bigint, audit string, " + _TURNS


def _pieces(blocks: DataFrame) -> DataFrame:
    """Each block with the turns that its edits leave."""
    both = blocks.join(_chosen(blocks), "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            turns = [edited(list(zip(r, t, strict=True)), a, p) for r, t, a, p in zip(f["roles"], f["texts"], f["audit"], f["before"], strict=True)]
            f = f.assign(turns=[[{"role": r, "text": t} for r, t in x] for x in turns])
            yield f[[x.split()[0] for x in _PIECE.split(", ")]]

    return both.mapInPandas(run, _PIECE)


def _joined(pieces: DataFrame) -> DataFrame:
    """The report of each conversation from its blocks in order, without the gaps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        conv, begun, counts, audits, last, digest, any_ = None, False, [0] * 5, [], None, None, False

        def ended() -> pd.DataFrame:
            return pd.DataFrame([[conv, *counts, "".join(audits), digest.hexdigest()]], columns=columns)

        for f in frames:
            for row in f.itertuples(index=False):
                c = row.conv_id
                if begun and c != conv:
                    yield ended()
                    begun = False
                if not begun:
                    conv, begun, counts, audits, last, digest, any_ = c, True, [0] * 5, [], None, hashlib.sha256(), False
                counts = [x + y for x, y in zip(counts, (row.blank, row.duplicate, row.truncated, row.illegal, row.cost), strict=True)]
                counts[3] += last is not None and last[:1] + row.first[:1] not in LEGAL
                last = row.last
                audits.append(row.audit)
                for t in row.turns:
                    digest.update((("\n" if any_ else "") + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                    any_ = True
        if begun:
            yield ended()

    schema = "conv_id string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(run, schema)


def _parts(rows: DataFrame, turns: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations that the first pass repaired, rows that it left, and the repaired blocks of those."""
    passed = stored(_first_pass(rows, turns), "repair-rows")
    # as text: pandas makes floats of numbers with nulls
    rest = passed.where("block is not null").select(F.col("conv_id").cast("string").alias("conv_id"), "block", "seq", "turn", "role", "text")
    return passed.where("block is null"), rest, stored(_pieces(stored(_blocks(rest), "repair-blocks")), "repair-pieces")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns that the cheapest edits leave. Places rise along a conversation; they have holes between its blocks."""
    whole, _, pieces = _parts(rows, turns=True)
    both = whole.select("conv_id", F.lit(0).cast("bigint").alias("block"), "turns").unionByName(pieces.select(F.col("conv_id").cast("bigint").alias("conv_id"), "block", "turns"))
    out = both.select("conv_id", "block", F.posexplode("turns").alias("i", "t"))
    return out.select("conv_id", (F.col("block") * (4 * BLOCK) + F.col("i")).alias("place"), "t.role", "t.text")


def repair_report(rows: DataFrame) -> DataFrame:
    """``conv_id``, faults (``gaps, blank, duplicate, truncated, illegal``), ``cost, audit`` and ``repaired_sha256`` of every conversation with rows."""
    whole, rest, pieces = _parts(rows)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    slots = rest.groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))).alias("gaps"))
    late = _joined(pieces).alias("p").join(slots.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*", "s.gaps")
    late = late.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    return whole.select(*names).unionByName(late.select(*names))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged rows, with a row of zeros for each conversation that has none left."""
    none = rows.select(F.col("conv_id").cast("bigint")).distinct()
    nothing = none.select("conv_id", *(F.lit(0).cast("bigint").alias(c) for c in COUNTS), F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    both = repair_report(damaged(rows)).unionByName(nothing).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in [*COUNTS, "audit", "repaired_sha256"]))
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def _sql() -> str:
    """The same in SQL, row by row: for each state the least (cost, audit) and its turns, as one text."""
    add = lambda s, cost, edit, turn: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {turn}}}"
    none = "{'c': 1000000, 'a': '', 't': ''}"
    own, more = r"chr(10) || role || ':' || text", "case when fault = 3 then 5 else 0 end"
    said = {s: f"chr(10) || '{r}:' || text" for s, r in (("s2", "user"), ("s3", "assistant"))}
    into = {"s1": [("s0", "s")], "s2": [("s0", "u"), ("s1", "u"), ("s3", "u")], "s3": [("s2", "a")]}
    steps = {}
    for q in ("s0", "s1", "s2", "s3"):
        found = [add(q, 2, "D", "''")]
        for p, initial in into.get(q, []):
            found.append(f"case when fault in (0, 3) and left(role, 1) = '{initial}' then {add(p, more, 'K', own)} else {none} end")
            if q in said:
                found.append(f"case when fault in (0, 3) then {add(p, '1 + ' + more, 'R', said[q])} else {none} end")
        steps[q] = f"list_min([{', '.join(found)}])"
    user = "list_min([" + ", ".join(["s2", *(add(p, 5, "I", "chr(10) || 'user:'") for p in ("s0", "s1", "s3"))]) + "])"
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c >> 8, byte[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
    return f"""with recursive
tables as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as byte),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hit as (select given.*, {crc} % 20 as kind from given, tables),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from hit, range(2) as copy(n) where kind <> 0 and (n = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
ends as (select *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final, row_number() over (partition by conv_id, role, text order by i) as seen, lag(role) over (partition by conv_id order by i) as before from placed),
faults as (select *, case when final = '' then 1 when seen > 1 then 2 when final not in ('.', '!', '?') then 3 else 0 end as fault from ends),
walk(conv_id, i, s0, s1, s2, s3) as (
  select distinct conv_id, 0::bigint, {{'c': 0, 'a': '', 't': ''}}::struct(c bigint, a varchar, t varchar), {none}::struct(c bigint, a varchar, t varchar),
    {{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}}::struct(c bigint, a varchar, t varchar), {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::struct(c bigint, a varchar, t varchar) from given
  union all
  select conv_id, i, s0, s1, s2, list_min([s3, {add('s2', 5, 'I', "chr(10) || 'assistant:'")}]) from (
    select conv_id, i, s0, s1, {user} as s2, s3 from (
      select w.conv_id, f.i, {steps['s0']} as s0, {steps['s1']} as s1, {steps['s2']} as s2, {steps['s3']} as s3 from walk w join faults f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1))),
last as (select conv_id, max_by(list_min([s0, s3]), i) as s from walk group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (i > 1 and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from faults group by conv_id)
select l.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  (s).c as cost, (s).a as audit, sha256(substr((s).t, 2)) as repaired_sha256 from last l left join counts c on l.conv_id is not distinct from c.conv_id"""


SQL = _sql()
