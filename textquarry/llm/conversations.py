"""Conversation structure repair by signature deduplication (operator 11).

A conversation's rows, in order of turn, become a signature of one letter a row:
its role's initial and its fault. Each distinct signature is solved once, by
memoised recursion over its halves: a table of the cheapest edits from each state
of the wanted form `(s?(ua)+)?` to each other one. Audits are joined back to the
conversations of the signature, and replaying one edits a conversation's rows.

Rows are sorted by ranges of (conv_id, turn, role, text), so a conversation that
holds a third of all rows is sorted by many tasks; what is gathered by conversation
is one letter a row, as long as the audit that is asked for. Only the replay takes
the rows of a conversation one after another, as a stream, in one task: the digest
of a text is a chain.

Defined cases: null roles and texts are one space, a null conv_id is a
conversation, null turns come first; rows of one turn follow each other by role,
then text, in byte order, and equal rows are duplicates of the first; roles whose
initial is none of s, u, a (the empty one too) are kept by no edit; very long texts
are taken whole; other columns are not used; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textquarry.llm.common import slices, staged, table

NO_SPACE = r"[^\x20\x09-\x0D]"
#: Share of a signature's conversations that one task joins: one in so many.
SALTS = 16

# The wanted form as an automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
ENDS = (0, 3)
ADDED = {0: 2, 1: 2, 2: 3, 3: 2}  # an inserted or re-roled row is the user's, or the assistant's after the user's
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ROLES = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


class Solver:
    """Cheapest audits of signatures: letters s, u, a, o (kept in capitals if truncated) and x (must go).

    Tables of halves are put together by cost, then audit. That is exact: the audits
    of a segment between two states hold one edit for each row and end with one, so
    none begins another, and the least of two is least whatever follows.
    """

    def __init__(self, longest: int = 64, most: int = 50_000):
        self.longest, self.most = longest, most
        self.known: dict[str, dict] = {}

    def letter(self, x: str) -> dict:
        """{(from, to): (cost, audit)} of a row, with the insertions before it; two lead to each state that any number leads to."""
        best: dict = {}
        for start in ADDED:
            state, cost, audit = start, 0, ""
            for _ in range(3):
                late = TRUNCATED * x.isupper()
                ways = [("D", state, DELETE)]
                if x != "x":
                    ways.append(("R", ADDED[state], REROLE + late))
                    if (x.lower(), state) in KEPT:
                        ways.append(("K", KEPT[x.lower(), state], KEEP + late))
                for edit, to, more in ways:
                    new = (cost + more, audit + edit)
                    best[start, to] = min(best.get((start, to), new), new)
                state, cost, audit = ADDED[state], cost + INSERT, audit + "I"
        return best

    def segment(self, x: str) -> dict:
        if x in self.known:
            return self.known[x]
        if len(x) == 1:
            best = self.letter(x)
        else:
            half = 1 << (len(x) - 1).bit_length() - 1  # powers of two, so that equal parts meet again
            best = {}
            left, right = self.segment(x[:half]), self.segment(x[half:])
            for (a, b), (cost, audit) in left.items():
                for c in range(4):
                    if (b, c) in right:
                        more, rest = right[b, c]
                        if (a, c) not in best or cost + more <= best[a, c][0]:
                            new = (cost + more, audit + rest)
                            best[a, c] = min(best.get((a, c), new), new)
        if len(x) <= self.longest:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[x] = best
        return best

    def solve(self, signature: str) -> tuple[int, str]:
        paths = {to: found for (start, to), found in self.segment(signature).items() if start == 0} if signature else {0: (0, "")}
        ends = []
        for state, (cost, audit) in paths.items():
            for _ in range(3):
                if state in ENDS:
                    ends.append((cost, audit))
                state, cost, audit = ADDED[state], cost + INSERT, audit + "I"
        return min(ends)


def solved(signatures: DataFrame) -> DataFrame:
    """cost and audit of each row's signature."""

    @F.arrow_udf("struct<cost: bigint, audit: string>")
    def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        solver = Solver()
        for batch in slices(batches):
            found = [solver.solve(x) for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["cost", "audit"])

    return signatures.withColumn("_found", solve("signature")).select("signature", "_found.cost", "_found.audit")


def ordered(rows: DataFrame) -> DataFrame:
    """Staged rows (conv_id, turn, role, text, place, part, code): place numbers them in order, code is the role's initial and the fault of the row alone."""
    whole = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    code = F.when(~F.col("text").rlike(NO_SPACE), "b").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.upper(initial)).otherwise(initial)
    return staged(whole.orderBy("conv_id", "turn", "role", "text").withColumns({"place": F.monotonically_increasing_id(), "part": F.spark_partition_id(), "code": code, "initial": initial, "digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))}))


def strings(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """codes and initials of each conversation, a letter a row; put together from the parts of each sorted range, whose rows are bounded."""
    one = F.struct("place", "code", "initial")
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("of"))
    parts = parts.select("conv_id", "part", *(F.array_join(F.col(f"of.{x}"), "").alias(x) for x in ("code", "initial")))
    parts = parts.unionByName(ids.select("conv_id", F.lit(-1).alias("part"), F.lit("").alias("code"), F.lit("").alias("initial")))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "code", "initial"))).alias("of"))
    return whole.select("conv_id", F.array_join("of.code", "").alias("codes"), F.array_join("of.initial", "").alias("initials"))


def audits(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: faults, illegal neighbours, and the cheapest audit; rows as `ordered` gives them."""
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = rows.select("conv_id", "part", "place", "code", "initial").join(firsts, "place", "left")
    marked = marked.withColumn("code", F.when((F.col("code") == "b") | F.col("first"), F.col("code")).otherwise("d"))
    whole = staged(strings(marked, conversations.select("conv_id").distinct()).withColumn("signature", F.translate("codes", "bd", "xx")))
    found = solved(whole.select("signature").distinct())
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    back = whole.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(found.withColumn("salt", salts), ["signature", "salt"])
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("conv_id", "_conv")

    def number(pattern: str, column: str = "codes") -> Column:
        return F.regexp_count(F.col(column), F.lit(pattern)).cast("long")

    illegal = F.greatest(F.length("initials") - 1, F.lit(0)) - number("(?=su|ua|au)", "initials")
    back = back.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return back.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), number("b").alias("blank"), number("d").alias("duplicate"), number("[SUAO]").alias("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) that an audit leaves and adds."""
    state = 0
    for edit in audit:
        if edit == "I":
            state = ADDED[state]
            yield ROLES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[role[0], state]
            yield role, text
        elif edit == "R":
            state = ADDED[state]
            yield ROLES[state], text


def _replayed(rows: DataFrame, found: DataFrame, run, fields: list[StructField]) -> DataFrame:
    """run(conv_id, repaired rows) for each conversation, streamed in order; the audit comes ahead of the rows it is for."""
    both = rows.select("conv_id", "place", "role", "text").unionByName(found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    schema = StructType([rows.schema["conv_id"], *fields])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the next conversation's audit
        kind = None

        def stream() -> Iterator[tuple]:
            nonlocal kind
            for batch in slices(batches):
                kind = batch.schema.field("conv_id").type
                yield from zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text")), strict=True)

        lines = stream()

        def own() -> Iterator[tuple[str, str]]:
            for line in lines:
                if line[1] < 0:
                    held.append(line)
                    return
                yield line[2], line[3]

        for _ in own():
            pass
        out, size = [], 0
        while held:
            conv, _, _, audit = held.pop()
            rest = own()
            for row in run(edited(audit, rest)):
                out.append((conv, *row))
                size += sum(len(x) for x in row if isinstance(x, str))
                if size > 4_000_000:
                    yield _batch(out, kind, fields)
                    out, size = [], 0
            for _ in rest:
                pass
        if out:
            yield _batch(out, kind, fields)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(replay, schema)


def _batch(rows: list, kind: pa.DataType, fields: list[StructField]) -> pa.RecordBatch:
    kinds = [kind, *(pa.string() if isinstance(x.dataType, StringType) else pa.int64() for x in fields)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", *(x.name for x in fields)])


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations' rows (conv_id, at, role, text); at counts from 0."""
    fields = [StructField("at", LongType()), StructField("role", StringType()), StructField("text", StringType())]
    return _replayed(rows, found, lambda lines: ((k, role, text) for k, (role, text) in enumerate(lines)), fields)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of `role:text` joined by newlines."""

    def digest(lines: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        chain, first = hashlib.sha256(), True
        for role, text in lines:
            chain.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield (chain.hexdigest(),)

    return _replayed(rows, found, digest, [StructField("repaired_sha256", StringType())])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) mod 20: 0 drops, 1 empties, 2 loses sentence ends, 3 repeats, 4 becomes the user's."""
    blank = {x: F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")}
    kind = (F.crc32(F.concat(blank["conv_id"], F.lit(":"), blank["turn"]).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", blank["role"].alias("role"), blank["text"].alias("text"), kind).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Audit and digest of each conversation of `conversations`, judged and repaired by `rows` (its own rows if none are given)."""
    sorted_rows = ordered(conversations if rows is None else rows)
    found = staged(audits(conversations, sorted_rows))
    ends = digests(sorted_rows, found).withColumnRenamed("conv_id", "_conv")
    return found.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))


#: Damage by a table-driven crc32 over the key's bytes, faults by windows, and the cheapest edits state by state in order.
REPAIR_SQL = r"""
with recursive bits(i, c) as (
  select i, i::bigint from range(256) t(i)
), table_1 as (
  select list(list_reduce([c, 0, 1, 2, 3, 4, 5, 6, 7], lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as crc from bits
), bytes as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), kinds as (
  select b.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])), 4294967295) % 20 as kind from bytes b, table_1
), damaged as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) r(copy) where kind != 0 and (copy = 0 or kind = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, left(role, 1) as initial from damaged
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by pos) as nth, lag(initial) over (partition by conv_id order by pos) as before from placed
), faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else 'none' end as fault from seen
), per_conv as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from faults group by conv_id
), moves as (
  select f.conv_id, f.pos, s.state as from_state, i.inserts, e.edit, case when i.inserts % 2 = 0 then s.state when s.state = 2 then 3 when i.inserts = 0 then s.state else case when s.state in (0, 1, 3) then 2 end end as at_state, f.initial, f.fault
  from faults f, (values (0), (1), (2), (3)) s(state), (values (0), (1), (2)) i(inserts), (values ('K'), ('R'), ('D')) e(edit)
), moves_2 as (
  select *, case when inserts = 2 and from_state in (0, 1) then 3 else at_state end as mid from moves
), steps as (
  select conv_id, pos, from_state, repeat('I', inserts::int) || edit as piece,
    inserts * 2 + case edit when 'D' then 3 when 'R' then 2 else 0 end + case when edit != 'D' and fault = 'truncated' then 1 else 0 end as price,
    case edit when 'D' then mid when 'R' then case mid when 2 then 3 else 2 end else case when initial = 's' and mid = 0 then 1 when initial = 'u' and mid in (0, 1, 3) then 2 when initial = 'a' and mid = 2 then 3 end end as to_state
  from moves_2 where edit = 'D' or fault in ('none', 'truncated')
), walk(conv_id, pos, state, found) as (
  select conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': ''} from per_conv
  union all
  select w.conv_id, s.pos, s.to_state, min({'cost': w.found.cost + s.price, 'audit': w.found.audit || s.piece})
  from walk w join steps s on w.conv_id is not distinct from s.conv_id and s.pos = w.pos + 1 and s.from_state = w.state and s.to_state is not null
  group by w.conv_id, s.pos, s.to_state
), best as (
  select w.conv_id, min({'cost': w.found.cost + 2 * e.inserts, 'audit': w.found.audit || repeat('I', e.inserts::int)}) as found
  from walk w join per_conv p on w.conv_id is not distinct from p.conv_id and w.pos = p.n join (values (0, 0), (3, 0), (2, 1), (1, 2), (0, 2), (3, 2)) e(state, inserts) on e.state = w.state group by w.conv_id
), letters as (
  select conv_id, unnest(range(1, length(found.audit) + 1)) as k, unnest(string_split(found.audit, '')) as edit from best where found.audit != ''
), at_rows as (
  select *, count(*) filter (edit != 'I') over (partition by conv_id order by k) as pos, count(*) filter (edit != 'D') over (partition by conv_id order by k) as kept from letters
), with_rows as (
  select a.*, f.role, f.text, max(case when a.edit = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by a.conv_id) as system from at_rows a left join faults f on a.conv_id is not distinct from f.conv_id and a.pos = f.pos and a.edit != 'I'
), repaired as (
  select conv_id, string_agg(case when edit = 'K' then role when (kept - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by k) as whole from with_rows where edit != 'D' group by conv_id
)
select i.conv_id, coalesce(p.gaps, 0)::bigint as gaps, coalesce(p.blank, 0)::bigint as blank, coalesce(p.duplicate, 0)::bigint as duplicate, coalesce(p.truncated, 0)::bigint as truncated, coalesce(p.illegal, 0)::bigint as illegal,
  coalesce(b.found.cost, 0)::bigint as cost, coalesce(b.found.audit, '') as audit, sha256(coalesce(r.whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join per_conv p on i.conv_id is not distinct from p.conv_id left join best b on i.conv_id is not distinct from b.conv_id left join repaired r on i.conv_id is not distinct from r.conv_id
"""
