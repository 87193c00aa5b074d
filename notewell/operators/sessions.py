"""Conversations and session counters: turn pairs, sections, running totals, repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship


def turn_pairs(turns: DataFrame, most: int = 1500) -> DataFrame:
    """(conv_id, pair, user_chars, assistant_chars, text): a user turn closes the pair before it; what an assistant says before any user is a pair too.

    Other roles are left out, and so are empty texts and pairs without any text; the others are numbered from 0. ``text`` names the
    sides that speak, without white space around it, cut to ``most`` characters.
    """
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    pair = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    lines = spoken.withColumn("_pair", pair).where("text <> ''").groupBy("conv_id", "_pair").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = lambda role: F.array_join(F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"]), "\n")
    lines = lines.select("conv_id", "_pair", said("user").alias("u"), said("assistant").alias("a"))
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{name}:\n"), F.col(c))) for c, name in (("u", "USER"), ("a", "ASSISTANT"))]
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("_pair")) - 1
    return lines.select(
        "conv_id", nth.cast("long").alias("pair"), F.length("u").cast("long").alias("user_chars"), F.length("a").cast("long").alias("assistant_chars"),
        F.substring(F.regexp_replace(F.concat_ws("\n", *parts), r"(?U)^\s+|\s+$", ""), 1, most).alias("text"))


def resume_hint(offsets: DataFrame) -> DataFrame:
    """(conv_id, hint): where reading of a session goes on, of ``offset_ranges`` rows with something new."""
    return offsets.where("new_lines > 0").select("conv_id", F.format_string("lines %d to %d are new; %d were read before", "from_line", "to_line", F.col("from_line") - 1).alias("hint"))


def fill_section(rows: DataFrame, group: str, order: str, is_header: Column, header: Column) -> DataFrame:
    """Each row with the last header at or before it."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(is_header, header), ignorenulls=True).over(upto))


def session_counters(events: DataFrame, session: str, tier: str, order: list[str], hit: Column) -> DataFrame:
    """(session, total, hits, hit_rate, last_tier) of each session."""
    return events.groupBy(session).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("hits"), F.max_by(tier, F.struct(*order)).alias("last_tier")).withColumn(
        "hit_rate", F.round(F.col("hits") / F.col("total"), 6))


def running_hits(events: DataFrame, session: str, order: list[str], hit: Column) -> DataFrame:
    upto = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running_total", F.count("*").over(upto)).withColumn("running_hits", F.count_if(hit).over(upto))


def drop_repeats(events: DataFrame, keys: list[str], ts: str, seconds: int, order: str) -> DataFrame:
    """Rows less than ``seconds`` after the last *kept* row of their key go, so a steady repeat comes through once in that time.

    A gap of ``seconds`` ends a run, as the row after it is kept whatever was before, and so are rows less than ``seconds`` after the first of their run gone. Only the later rows of long runs
    are folded, apart on (time, ``order``) alone, so a task holds the narrow rows of one run and not those of a key. Rows without a key value count as one key.
    """
    ship(events.sparkSession)
    w = Window.partitionBy(*keys).orderBy(ts, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce(us - F.lag(us).over(w) >= seconds * 1_000_000, F.lit(True))
    runs = events.select(*keys, order, ts, us.alias("_us"), fresh.alias("_fresh"))
    runs = runs.withColumn("_run", F.count_if("_fresh").over(upto)).withColumn("_first", F.last(F.when(F.col("_fresh"), F.col("_us")), ignorenulls=True).over(upto))
    schema = events.select(order).schema

    def fold(run: pa.Table) -> pa.Table:
        run = run.sort_by([("_us", "ascending"), (order, "ascending")])
        times, kept, at = run.column("_us").to_numpy(), [], 0
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + seconds * 1_000_000))
        return run.select([order]).take(kept)

    # the first row that is late for its run's first one is kept, as that was the last kept one before it
    late = runs.where(~F.col("_fresh") & (F.col("_us") - F.col("_first") >= seconds * 1_000_000))
    kept = runs.where("_fresh").select(order).union(late.select(*keys, "_run", order, "_us").groupBy(*keys, "_run").applyInArrow(fold, schema))
    return events.join(kept, order, "left_semi")


def sessions_by_gap(events: DataFrame, key: str, ts: str, minutes: int, order: str) -> DataFrame:
    """(key, session, started, ended, events): a gap longer than ``minutes`` starts a new session."""
    w = Window.partitionBy(key).orderBy(ts, order)
    fresh = F.coalesce((F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {minutes} MINUTES")).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
