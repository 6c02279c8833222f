"""Repair of damaged conversations: the cheapest edits that give system?, then user and assistant in turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE, crc32_sql

#: What edits cost, their letters, and the white space of the contract.
RETYPE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: The states of the grammar: nothing yet, behind a system, user or assistant turn. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State -> the state that a user or assistant turn leads to, and that turn's role.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: More inserted turns in a row than this lead back to a state already reached for less.
MOST_INSERTED = 3
#: Letters of the audit that all survivors share are put away once they have so many.
SHARED = 256


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) damaged by a hash of each row's key, with ``gone``.

    A null counts as one space. Of 20 rows one is dropped, one emptied, one loses its full stops, question
    and exclamation marks, one is repeated and one becomes the user's. A dropped row stays as a mark, so that
    its conversation is still named.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(d == 4, "user").otherwise(role).alias("role"),
        F.when(d.isin(0, 1), "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (d == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(1), F.when(d == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``seen`` and ``fault``, the first of blank, duplicate and truncated that holds for a row, else null."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    before = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    return rows.withColumn("seen", F.row_number().over(before) > 1).select(
        "conv_id", "turn", "role", "text", "gone", "seen",
        F.when(last == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
    )


class Survivor:
    """The cheapest way to a state: its cost, the audit behind what all share, and the digest of what it keeps."""

    __slots__ = ("cost", "audit", "sha", "empty")

    def __init__(self, cost: int, audit: str, sha, empty: bool):
        self.cost, self.audit, self.sha, self.empty = cost, audit, sha, empty

    def rank(self) -> tuple[int, str]:
        return self.cost, self.audit

    def then(self, cost: int, letter: str, role: str | None = None, text: str = "") -> Survivor:
        if role is None:
            return Survivor(self.cost + cost, self.audit + letter, self.sha, self.empty)
        sha = self.sha.copy()
        sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        return Survivor(self.cost + cost, self.audit + letter, sha, False)


class Conversation:
    """Takes a conversation's rows in order; holds four survivors whatever the number of rows.

    Audits of one layer have a letter for each row and further ones for inserted turns, and a
    letter's cost is the same in all, so of equally cheap audits none is the start of another:
    the least of (cost, audit) stays the least whatever follows.
    """

    def __init__(self):
        self.live: dict[int, Survivor] = {START: Survivor(0, "", hashlib.sha256(), True)}
        self.shared: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None
        self.last_role, self.last_turn = None, None
        self.close_layer()

    def close_layer(self) -> None:
        """Inserted turns lead on from every state, as far as they lead anywhere new."""
        for _ in range(MOST_INSERTED):
            offers = [(NEXT[s], p) for s, p in self.live.items()]
            changed = False
            for (to, role), p in offers:
                if to not in self.live or (p.cost + INSERT, p.audit + "I") < self.live[to].rank():
                    self.live[to], changed = p.then(INSERT, "I", role), True
            if not changed:
                break

    def take(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        layer = {s: [(p.cost + DELETE, p.audit + "D", p, None)] for s, p in self.live.items()}
        if fault not in ("blank", "duplicate"):
            more = UNFINISHED if fault == "truncated" else 0
            if role[:1] == "s" and START in self.live:
                p = self.live[START]
                layer.setdefault(SYSTEM, []).append((p.cost + more, p.audit + "K", p, role))
            for s, p in self.live.items():
                to, fitting = NEXT[s]
                if role[:1] == fitting[0]:
                    layer.setdefault(to, []).append((p.cost + more, p.audit + "K", p, role))
                layer.setdefault(to, []).append((p.cost + more + RETYPE, p.audit + "R", p, fitting))
        self.live = {}
        for s, offers in layer.items():
            cost, audit, p, kept = min(offers, key=lambda o: o[:2])
            self.live[s] = p.then(cost - p.cost, audit[-1], kept, text)
        self.close_layer()
        if min(len(p.audit) for p in self.live.values()) >= SHARED:
            shared = commonprefix([p.audit for p in self.live.values()])
            self.shared.append(shared)
            for p in {id(p): p for p in self.live.values()}.values():
                p.audit = p.audit[len(shared) :]

    def result(self) -> tuple:
        best = min((self.live[s] for s in ENDS if s in self.live), key=Survivor.rank)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.counts.values(), self.illegal, best.cost, "".join(self.shared) + best.audit, best.sha.hexdigest()


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KIND = pa.schema([*((n, pa.int64()) for n in NAMES[:-2]), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def plan_repairs(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation: its faults, cost, audit and the digest of the repaired turns.

    ``rows`` have conv_id, turn, role, text and maybe ``gone``; rows that are gone only name their conversation,
    and one that has no others gets zeros, an empty audit and the digest of the empty string. Rows stand by turn, nulls first,
    those of one turn by role and text. The null conv_id is a conversation of its own. Null roles and texts count as one
    space, so such a row is blank. A role without a first letter fits no state. Further columns are ignored, whatever
    their names; an empty table gives an empty result.

    One shuffle brings a conversation together; it's sorted there, with Spark's spilling, and read as a stream, so
    a very long conversation costs time in its task (its digest is one stream by definition), but no memory.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    plain = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current, told = None, None, []
        for batch in batches:
            for conv_id, turn, role, text, is_gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv_id != key:
                    if current is not None:
                        told.append((key, *current.result()))
                    key, current = conv_id, Conversation()
                if not is_gone:
                    current.take(turn, role, text, fault)
            if len(told) >= 1000:
                yield _told(told)
                told = []
        if current is not None:
            told.append((key, *current.result()))
        if told:
            yield _told(told)

    met = with_faults(plain.repartition("conv_id"))
    ordered = met.sortWithinPartitions("conv_id", "turn", "role", "text", "seen")
    return ordered.drop("seen").mapInArrow(walk, SCHEMA)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KIND.types)], schema=_KIND)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, turn (from 0), role, text, edit.

    The letters of an audit are taken apart and each meets the row it speaks of; an inserted turn has none. Edge
    cases as in :func:`plan_repairs`, whose result ``plans`` is.
    """
    present = rows.where(~F.col("gone")) if "gone" in rows.columns else rows
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = present.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = placed.withColumn("at", F.row_number().over(order)).select(F.col("conv_id").alias("c"), "at", F.col("role").alias("own"), "text")
    letters = plans.where("audit <> ''").select("conv_id", F.posexplode(F.split("audit", "")).alias("k", "edit"))
    so_far = Window.partitionBy("conv_id").orderBy("k")
    letters = letters.withColumns({"at": F.count_if(F.col("edit") != "I").over(so_far), "turn": F.count_if(F.col("edit") != "D").over(so_far) - 1})
    met = letters.where("edit <> 'D'").join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (letters["at"] == placed["at"]) & (F.col("edit") != "I"), "left")
    starts = F.max((F.col("turn") == 0) & (F.col("edit") == "K") & F.col("own").startswith("s")).over(Window.partitionBy("conv_id"))
    met = met.withColumn("shift", F.coalesce(starts, F.lit(False)).cast("int"))
    role: Column = F.when(F.col("edit") == "K", F.col("own")).when((F.col("turn") + F.col("shift")) % 2 == 0, "user").otherwise("assistant")
    return met.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def _after(state: str, cost: str, letter: str) -> str:
    """SQL: a survivor, written as its cost in nine digits and its audit, after one more edit."""
    return f"lpad((({state})[1:9]::int + {cost})::varchar, 9, '0') || ({state})[10:] || '{letter}'"


_FROM = "least(s0, s1, s3)"
#: DuckDB SQL for the rows of the query: the same four states, a row of every conversation at a time.
SQL = f"""
with recursive {CRC_TABLE},
source as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d from conversations, tab),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
    case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case d when 0 then []::int[] when 3 then [1, 2] else [1] end) as copy
  from source),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
numbered as (
  select *, dense_rank() over (order by conv_id) as g, row_number() over (partition by conv_id, role, text order by i) as k,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as z, lag(role[1:1]) over (partition by conv_id order by i) || role[1:1] as pair
  from placed),
faulted as (
  select *, case when z = '' then 'blank' when k > 1 then 'duplicate' when z not in ('.', '!', '?') then 'truncated' end as fault,
    z <> '' and k = 1 as stays, case when z not in ('.', '!', '?') then {UNFINISHED} else 0 end as more
  from numbered),
walk(g, i, s0, s1, s2, s3) as (
  select distinct g, 0::bigint, '000000000', null::varchar, {_after("'000000000'", str(INSERT), "I")}, {_after("'000000000'", str(2 * INSERT), "II")} from faulted
  union all
  select g, i, s0, s1, u, least(s3, {_after("u", str(INSERT), "I")}) from (
    select g, i, s0, s1, least(s2, {_after(_FROM, str(INSERT), "I")}) as u, s3 from (
      select w.g, f.i, {_after("s0", str(DELETE), "D")} as s0,
        least({_after("s1", str(DELETE), "D")}, case when stays and role[1:1] = 's' then {_after("s0", "more", "K")} end) as s1,
        least({_after("s2", str(DELETE), "D")}, case when stays and role[1:1] = 'u' then {_after(_FROM, "more", "K")} end,
          case when stays then {_after(_FROM, f"more + {RETYPE}", "R")} end) as s2,
        least({_after("s3", str(DELETE), "D")}, case when stays and role[1:1] = 'a' then {_after("s2", "more", "K")} end,
          case when stays then {_after("s2", f"more + {RETYPE}", "R")} end) as s3
      from walk w join faulted f on f.g = w.g and f.i = w.i + 1))),
best as (select g, arg_max(least(s0, s3), i) as found from walk group by g),
letters as (
  select *, sum((edit <> 'I')::int) over (partition by g order by p) as i, sum((edit <> 'D')::int) over (partition by g order by p) as e
  from (select g, unnest(string_split(found[10:], '')) as edit, generate_subscripts(string_split(found[10:], ''), 1)  as p from best where len(found) > 9)),
kept as (
  select l.g, l.p, l.e, l.edit, f.role as own, coalesce(f.text, '') as text,
    max((l.e = 1 and l.edit = 'K' and f.role[1:1] = 's')::int) over (partition by l.g) as shift
  from letters l left join faulted f on f.g = l.g and f.i = l.i and l.edit <> 'I' where l.edit <> 'D'),
repaired as (
  select g, string_agg(case when edit = 'K' then own when (e - coalesce(shift, 0)) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p) as whole from kept group by g),
facts as (
  select g, any_value(conv_id) as conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
    count_if(fault = 'truncated') as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal
  from faulted group by g)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(found[1:9]::bigint, 0) as cost, coalesce(found[10:], '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join facts on facts.conv_id is not distinct from o.conv_id and facts.g is not null left join best using (g) left join repaired using (g)
"""
