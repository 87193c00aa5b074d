"""Repair of a conversation's structure as a lightest derivation.

Roles have to read system?, then user and assistant in turns. Items say how many rows are taken and which state that order
is in; deductions keep, rerole or delete the next row, or insert one. Knuth's agenda pops items by cost and audit string, so that the
first goal popped is the cheapest repair. A long conversation is cut into segments: each gives the lightest way from every state to every
other, and these ways are in turn the deductions that longer stretches are derived by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, join_measured, prepare, scratch, with_position

#: Rows that one group of the first derivations takes, and segments that one step puts together.
SEGMENT, FAN = 256, 16
#: Costs of edits, and what a truncated row adds unless it is deleted.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What follows each state by the initial of a role: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GOALS = frozenset((0, 3))
#: A row's first fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: The white space around texts, and what a whole text ends with.
SPACE = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")

Deduce = Callable[[int, int], Iterator[tuple[int, str, int, int]]]


def lightest(n: int, deduce: Deduce, entry: int, goals: frozenset[int], every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the states in ``goals`` after ``n`` steps: of the first one that is final, or of ``every`` one.

    ``deduce(i, state)`` gives (cost, audit, state, steps) of the deductions that an item (i, state) allows. Items are popped by (cost,
    steps taken, audit): what a deduction makes never comes before what it is made of, as it costs more or takes a step for nothing, so a popped item is final.
    Two derivations of an item at one cost take the same steps, so neither audit begins the other, and appending keeps their order.
    """
    agenda: list = [(0, 0, "", entry)]
    final, found = set(), {}
    while agenda:
        cost, i, audit, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for more, letters, onward, steps in deduce(i, state):
            if (i + steps, onward) not in final:
                heappush(agenda, (cost + more, i + steps, audit + letters, onward))
    return found


def edits_of(initials: list[str], faults: list[int]) -> Deduce:
    """The deductions over single rows."""
    n = len(initials)

    def deduce(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        ahead = NEXT[state]
        if i < n:
            yield DELETE, "D", state, 1
            if faults[i] in (SOUND, CUT):
                extra = TRUNCATED if faults[i] == CUT else 0
                if initials[i] in ahead:
                    yield extra, "K", ahead[initials[i]], 1
                for role in "ua":
                    if role in ahead:
                        yield REROLE + extra, "R", ahead[role], 1
        for role in "ua":
            if role in ahead:
                yield INSERT, "I", ahead[role], 0

    return deduce


def ways_over(segments: list[list[dict]]) -> Deduce:
    """The deductions over segments, whose ways are given as (p, q, cost, audit)."""

    def deduce(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        if i < len(segments):
            for way in segments[i]:
                if way["p"] == state:
                    yield way["cost"], way["audit"], way["q"], 1

    return deduce


def ways(n: int, deduce: Deduce, whole: bool) -> list[dict]:
    """Ways through ``n`` steps: of a whole conversation its repair, of a part those between all states."""
    found = [(0, lightest(n, deduce, 0, GOALS))] if whole else [(p, lightest(n, deduce, p, frozenset(range(4)), every=True)) for p in range(4)]
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for p, reached in found for q, (cost, audit) in reached.items()]


WAYS = "array<struct<p: int, q: int, cost: long, audit: string>>"
PART = f"conv string, part boolean, start long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways {WAYS}"
LEGAL = frozenset(("su", "ua", "au"))


def _parts(rows: list[dict]) -> pa.Table:
    ways_type = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    long = ("start", "blank", "duplicate", "truncated", "illegal")
    kinds = [(c, pa.int64() if c in long else pa.bool_() if c == "part" else ways_type if c == "ways" else pa.string()) for c in
             ("conv", "part", "start", "blank", "duplicate", "truncated", "illegal", "head", "tail", "ways")]
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


def _derive(block: pa.Table) -> pa.Table:
    """Parts of conversations in a block of consecutive rows; all but the first and the last are whole."""
    block = block.sort_by("position")
    conv, start, initial, fault = (block.column(c).to_pylist() for c in ("conv", "position", "initial", "fault"))
    n, found, at = len(conv), [], 0
    while at < n:
        end = at
        while end < n and conv[end] == conv[at]:
            end += 1
        mine, faults = initial[at:end], fault[at:end]
        whole = at > 0 and end < n
        found.append({
            "conv": conv[at], "part": not whole, "start": start[at], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(CUT), "illegal": sum(a + b not in LEGAL for a, b in zip(mine, mine[1:])), "head": mine[0], "tail": mine[-1],
            "ways": ways(end - at, edits_of(mine, faults), whole)})
        at = end
    return _parts(found)


def _compose(group: pa.Table) -> pa.Table:
    """Consecutive parts of a conversation as one."""
    parts = group.sort_by("start").to_pylist()
    total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
    return _parts([parts[0] | total | {"tail": parts[-1]["tail"], "ways": ways(len(parts), ways_over([p["ways"] for p in parts]), False)}])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with planted faults, by the CRC-32 of ``conv_id:turn``; nulls are written as one space.

    A twentieth of the rows each is dropped, emptied, loses its marks of sentence ends, is repeated, and is given to the user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), "".join(ENDS), "")).otherwise(said("text"))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
                                        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def conv_key(conv_id: Column) -> Column:
    """A string for any id, the empty one for null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def number(rows: DataFrame, path: str) -> DataFrame:
    """Rows with their position in the order of (conv_id, turn, role, MD5 of the text), nulls first; written to ``path`` with what their faults are told by."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    last = F.substr(F.rtrim("text", F.lit(SPACE)), F.lit(-1), F.lit(1))
    rows = rows.select(conv_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumns({"digest": F.md5(F.col("text").cast("binary")), "same": F.monotonically_increasing_id(),
                             "fault": F.when(last == "", BLANK).when(last.isin(*ENDS), SOUND).otherwise(CUT)})

    def kept(df: DataFrame) -> DataFrame:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return with_position(rows, [F.col(c) for c in ("conv_id", "turn", "role", "digest", "same")], keep=kept).drop("same")


def find_faults(numbered: DataFrame) -> DataFrame:
    """(conv, position, initial, fault): a row that is not blank and whose role and text stand earlier in its conversation is a duplicate."""
    rows = numbered.select("conv", "position", "role", "digest", "fault").checkpoint()
    again = rows.groupBy("conv", "role", "digest").agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1").checkpoint()
    repeats = join_hot(rows.where(F.col("fault") != BLANK), again, ["conv", "role", "digest"], "n", rows.count()).where("position > first")
    repeats = repeats.select("position", F.lit(True).alias("repeat")).checkpoint()
    fault = F.when(F.col("repeat"), DUPLICATE).otherwise(F.col("fault"))
    return join_measured(rows, repeats, "position", "left").select("conv", "position", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), fault.alias("fault"))


def derive(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(conv, start, blank, duplicate, truncated, illegal, cost, audit) of each conversation, from rows with their faults.

    Blocks of ``segment`` consecutive rows are derived first, and parts of conversations that reach over their ends are put together ``fan`` at a time,
    so no task takes a whole long conversation; only its audit string is as long as it is.
    """
    parts = rows.groupBy(F.expr(f"position DIV {segment}").alias("_block")).applyInArrow(_derive, PART).checkpoint()
    whole, open_ends = parts.where("NOT part"), parts.where("part")
    while open_ends.groupBy("conv").count().where("count > 1").limit(1).count():
        segment *= fan
        open_ends = open_ends.groupBy("conv", F.expr(f"start DIV {segment}").alias("_block")).applyInArrow(_compose, PART).checkpoint()
    goal = F.array_min(F.transform(F.filter("ways", lambda w: (w["p"] == 0) & w["q"].isin(*GOALS)), lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))
    return whole.unionByName(open_ends).withColumn("goal", goal).select(
        "conv", "start", "blank", "duplicate", "truncated", "illegal", F.col("goal.cost").alias("cost"), F.col("goal.audit").alias("audit"))


def edits(repairs: DataFrame) -> DataFrame:
    """(conv, nth, edit, position, role): each row of the repaired conversations in order, from (conv, start, audit).

    ``position`` is that of the row that was kept or reroled, null for an inserted one; ``role`` is the new one, null for a row that was kept.
    An odd number of rows begins with a system row, so the audit alone tells whose turn it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, start, audit in zip(*(b.column(c).to_pylist() for c in ("conv", "start", "audit"))):
                letters = np.frombuffer(audit.encode(), "S1")
                row = np.cumsum(letters != b"I") - 1 + start
                stays = letters != b"D"
                letters, row = letters[stays], row[stays]
                nth = np.arange(len(letters))
                role = np.where((nth - len(nth) % 2) % 2 == 0, "user", "assistant")
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv] * len(nth), pa.string()), pa.array(nth), pa.array(letters.astype("U1"), pa.string()), pa.array(row, mask=letters == b"I"),
                    pa.array(role, pa.string(), mask=letters == b"K")], ["conv", "nth", "edit", "position", "role"])

    return repairs.select("conv", "start", "audit").mapInArrow(run, "conv string, nth long, edit string, position long, role string")


def repaired_rows(numbered: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, nth, edit, turn, role, text): the rows of the repaired conversations; inserted ones have an empty text and no turn."""
    made = edits(repairs).checkpoint()
    told = made.where("position IS NOT NULL").join(numbered.select("position", "turn", F.col("role").alias("_role"), "text"), "position")
    told = told.select("conv", "nth", "edit", "turn", F.coalesce("role", "_role").alias("role"), "text")
    added = made.where("position IS NULL").select("conv", "nth", "edit", F.lit(None).cast(numbered.schema["turn"].dataType).alias("turn"), "role", F.lit("").alias("text"))
    return told.unionByName(added)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation. They are hashed as they come, in order, so memory does not grow with a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            done = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if conv != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["conv", "sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], ["conv", "sha256"])

    return rows.repartition("conv").sortWithinPartitions("conv", "nth").select("conv", "role", "text").mapInArrow(run, "conv string, sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns that are missing between a conversation's first and last one; null turns don't count."""
    turns = rows.select(conv_key(F.col("conv_id")).alias("conv"), "turn").distinct().groupBy("conv")
    return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null turn comes first; rows of one turn are ordered by role and by the MD5 of the text; rows with a null conv_id are one
    conversation. An empty role is no role, so its row cannot be kept. A conversation without rows has zeros, an empty audit and the hash of an empty string. Columns other than
    conv_id, turn, role and text are ignored. Each conversation's text is hashed in one task, row by row; all else is spread over blocks of rows.
    """
    spark = prepare(rows.sparkSession) or rows.sparkSession
    path = scratch(spark, "repair")
    numbered = number(rows, path)
    repairs = derive(find_faults(numbered)).checkpoint()
    hashed = digests(repaired_rows(numbered, repairs))
    asked = ids.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    all_of = asked.join(repairs, "conv", "left").join(gaps(rows), "conv", "left").join(hashed, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = all_of.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")).checkpoint()
    discard(spark, path)
    return found


SQL = rf"""
WITH RECURSIVE
tab AS MATERIALIZED (SELECT (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) FROM range(256) AS r(b)) AS t),
src AS (
  SELECT coalesce('=' || conv_id::VARCHAR, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS b FROM conversations),
hashed AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM src, tab),
dam AS (
  SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) AS v(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM dam),
f AS MATERIALIZED (
  SELECT conv, i, role, text, substr(role, 1, 1) AS x, substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS two,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM num),
step AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(p, x, q)),
ins AS (FROM (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', {INSERT}), (1, 2, 'I', {INSERT}), (2, 3, 'I', {INSERT}), (3, 2, 'I', {INSERT}),
  (0, 3, 'II', {2 * INSERT}), (1, 3, 'II', {2 * INSERT})) AS v(p, q, a, c)),
act AS (
  SELECT conv, i, q AS p, q, 'D' AS a, {DELETE} AS c FROM f, (VALUES (0), (1), (2), (3)) AS v(q)
  UNION ALL SELECT conv, i, p, q, 'K', CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END FROM f JOIN step USING (x) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv, i, p, q, 'R', {REROLE} + CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END FROM f, step WHERE fault NOT IN ('b', 'd') AND step.x <> 's'),
moves AS MATERIALIZED (SELECT conv, i, ins.p, act.q, ins.a || act.a AS a, ins.c + act.c AS c FROM ins JOIN act ON ins.q = act.p),
dp AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, 0 AS q, {{'c': 0, 'a': ''}} AS best FROM f
  UNION ALL
  SELECT dp.conv, dp.i + 1, m.q, min({{'c': best.c + m.c, 'a': best.a || m.a}}) FROM dp JOIN moves m ON m.conv = dp.conv AND m.i = dp.i + 1 AND m.p = dp.q GROUP BY dp.conv, dp.i, m.q),
size AS (SELECT conv, max(i) AS n FROM f GROUP BY conv),
goal AS (SELECT dp.conv, min({{'c': best.c + ins.c, 'a': best.a || ins.a}}) AS best FROM dp JOIN size ON size.conv = dp.conv AND n = i JOIN ins ON ins.p = dp.q WHERE ins.q IN (0, 3) GROUP BY dp.conv),
letters AS (SELECT conv, unnest(string_split(best.a, '')) AS l, unnest(range(1, length(best.a) + 1)) AS j FROM goal),
placed AS (
  SELECT conv, l, sum((l <> 'I')::INT) OVER (PARTITION BY conv ORDER BY j) AS i, sum((l <> 'D')::INT) OVER (PARTITION BY conv ORDER BY j) - 1 AS k,
         sum((l <> 'D')::INT) OVER (PARTITION BY conv) % 2 AS odd FROM letters),
told AS (
  SELECT placed.conv, string_agg(CASE WHEN l = 'K' THEN role WHEN (k - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM placed LEFT JOIN f ON f.conv = placed.conv AND f.i = placed.i WHERE l <> 'D' GROUP BY placed.conv),
stats AS (
  SELECT conv, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
gaps AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM dam GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM src) LEFT JOIN stats USING (conv) LEFT JOIN gaps USING (conv) LEFT JOIN goal USING (conv) LEFT JOIN told USING (conv)
"""
