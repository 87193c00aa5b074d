"""Incremental processing: snapshot differences, high-water marks, completeness gates, caps and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import ALONE, History


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, action): added, updated, removed or skipped, by comparing signatures."""
    old = before.select(key, F.col(signature).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(key, F.col(signature).alias("_new"), F.lit(True).alias("_is"))
    action = (F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
              .when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated"))
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def classify_deploy(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, state) from (key, raw, unix) hashes of both sides: new, same, eol-only, changed or missing-src."""
    a = source.select(key, F.col("raw").alias("_ra"), F.col("unix").alias("_ua"))
    b = target.select(key, F.col("raw").alias("_rb"), F.col("unix").alias("_ub"))
    state = (F.when(F.col("_ra").isNull(), "missing-src").when(F.col("_rb").isNull(), "new").when(F.col("_ra") == F.col("_rb"), "same")
             .when(F.col("_ua") == F.col("_ub"), "eol-only").otherwise("changed"))
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def advance(rows: DataFrame, keys: list[str], order: Column, mark: str, name: str = "hwm") -> DataFrame:
    """The mark of each key's latest row."""
    return rows.groupBy(*keys).agg(F.max_by(F.col(mark), F.struct(order, F.col(mark))).alias(name))


def window_start(installed: Column, today: Column, days: int = 7) -> Column:
    """A first run looks back no further than the installation, and at most ``days``."""
    return F.greatest(installed, F.date_sub(today, days))


def effective_since(branches: DataFrame, marks: DataFrame, examined: DataFrame, history: History, reach: DataFrame, installed: Column, today: Column, days: int = 7) -> DataFrame:
    """(origin, branch, kind, sha, since, source): from where each branch's commits are new.

    A mark counts if it is among the commits that the branch reaches (``reach``: origin, branch, chain, upto). Otherwise, after a rebase or
    without a mark, the date of the origin's last complete examination counts, and without that the first run's window.
    """
    alive = history.holds(reach, marks.select("origin", "branch", F.col("hwm").alias("sha")), ["branch"]).where("held").select("origin", "branch", F.col("sha").alias("hwm"))
    both = branches.select("origin", "branch").join(alive, ["origin", "branch"], "left").join(examined.select("origin", "last_examined"), "origin", "left")
    by_mark, dated = F.col("hwm").isNotNull(), F.col("last_examined").isNotNull()
    start = window_start(installed, today, days)
    first = F.when(F.date_sub(today, days) > installed, "capped").otherwise("bootstrap")
    return both.select(
        "origin", "branch", F.when(by_mark, "commit").otherwise("date").alias("kind"), F.col("hwm").alias("sha"),
        F.when(~by_mark, F.coalesce("last_examined", start)).alias("since"), F.when(by_mark, "mark").when(dated, "examined").otherwise(first).alias("source"))


def new_commits(history: History, reach: DataFrame, seen: DataFrame, commits: DataFrame | None, since: DataFrame, trunk: DataFrame | None = None) -> DataFrame:
    """(origin, branch, sha, day, source): what each branch reaches and has not been seen.

    After a mark: what the mark does not reach (``seen``, like ``reach``: origin, branch, chain, upto); only the new commits are written out. By date: what is of that day
    or later, and not in ``trunk`` where one is given. Identifiers are compared for equality only, as their order says nothing. ``commits`` is (origin, sha, day),
    or None where the places of the history have the day with them; commits that are not there, or that no line lists, are not new.
    """
    keys = ["origin", "branch"]
    marked, dated = (since.where(f"kind = '{kind}'").select(*keys, "since", "source") for kind in ("commit", "date"))
    of = lambda rows, which: rows.join(which.select(*keys), keys, "left_semi")
    # where the places have days, rows are not dealt out again to be given them
    marked_reach, dated_reach = (reach.join(x, keys) for x in (marked.drop("since"), dated))
    if commits is None:
        days, listed = history.commits, History(history.commits.where(~F.startswith("chain", F.lit(ALONE))), history.crossing)
        by_mark = listed.beyond(marked_reach, of(seen, marked), ["branch"])
    else:
        days = commits.select("origin", "sha", "day")
        by_mark = history.beyond(marked_reach, of(seen, marked), ["branch"]).select("origin", "branch", "sha", "source").join(days, ["origin", "sha"])
    # the earliest window is one value
    earliest = dated.agg(F.min("since")).first()[0]
    recent = days.where(F.col("day") >= F.lit(earliest)) if earliest is not None else days.limit(0)
    by_date = history.among(dated_reach, reach.limit(0) if trunk is None else of(trunk, dated), ["branch"], recent).where("day >= since")
    rows = [x.select("origin", "branch", "sha", "day", "source") for x in (by_mark, by_date)]
    return rows[0].union(rows[1])


def reach_and_seen(history: History, tips: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, branch, chain, upto) of what the branches' tips (origin, branch, tip) and what their marks (origin, branch, hwm) reach, in one walk."""
    starts = tips.select("origin", "branch", F.lit(True).alias("of_tip"), F.col("tip").alias("sha")).union(marks.select("origin", "branch", F.lit(False), "hwm"))
    found = history.reach(starts, ["branch", "of_tip"])
    return found.where("of_tip").drop("of_tip"), found.where("NOT of_tip").drop("of_tip")


def skippable(tips: DataFrame, marks: DataFrame, examined: DataFrame) -> DataFrame:
    """(origin, branch, skip) of (origin, branch, tip, day): is the tip the mark itself, or older than the origin's last examination?"""
    both = tips.join(marks, ["origin", "branch"], "left").join(examined, "origin", "left")
    skip = F.coalesce(F.col("tip") == F.col("hwm"), F.lit(False)) | F.coalesce(F.col("day") < F.col("last_examined"), F.lit(False))
    return both.select("origin", "branch", skip.alias("skip"))


def seal(fetched: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Partitions that may advance: fetched without error, and with nothing left over."""
    return fetched.distinct().exceptAll(incomplete.distinct().join(fetched.distinct(), fetched.columns, "left_semi"))


def cap_and_defer(rows: DataFrame, group: list[str], order: list[Column], caps: Column) -> DataFrame:
    """Rows with their number in the group, and whether they are deferred to the next run: nothing is dropped."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("nth", nth).withColumn("deferred", F.col("nth") > caps)


def canonical(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key by order, and every row without a key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.where(F.col(key).isNotNull()).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return first.unionByName(rows.where(F.col(key).isNull()))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def unambiguous(rows: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, owner) of the names that one owner has; the owner is null where several do."""
    return rows.groupBy(name).agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias("_one")).select(
        name, "owners", F.when(F.col("owners") == 1, F.col("_one")).alias(owner))


def offset_ranges(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, from, to, new, shrunk) from current and previous line counts; nothing new where the count fell."""
    both = current.join(previous.withColumnRenamed("lines", "_before"), key, "left")
    old = F.coalesce("_before", F.lit(0))
    fresh = F.greatest(F.col("lines") - old, F.lit(0)).cast("long")
    return both.select(key, (old + 1).cast("long").alias("from_line"), F.greatest(F.col("lines"), old).cast("long").alias("to_line"), fresh.alias("new_lines"), (F.col("lines") < old).alias("shrunk"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new row replaces an old one."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def merge_method(ancestor: Column, all_patches: Column, combined: Column) -> Column:
    """How a branch was merged: by ancestry, else patch by patch, else as one patch, else not."""
    return F.when(ancestor, "ancestor").when(all_patches, "cherry").when(combined, "patchid").otherwise("none")


def branch_state(merged: Column, alive: Column, manual: Column) -> Column:
    """Over all clones: merged anywhere, else alive anywhere, else closed by hand, else gone."""
    return F.when(merged, "merged").when(alive, "open").when(manual, "manual").otherwise("gone")


def prefer_ref(refs: DataFrame) -> DataFrame:
    """(origin, branch, ref) of (origin, ref) rows: of a branch's refs that of the remote (``origin/<branch>``), else the local one."""
    remote = F.col("ref").startswith("origin/")
    branch = F.when(remote, F.substr("ref", F.lit(8))).otherwise(F.col("ref"))
    return refs.groupBy("origin", branch.alias("branch")).agg(F.min_by("ref", F.struct((~remote).alias("local"), F.col("ref"))).alias("ref"))


def default_branch(refs: DataFrame, preferred: list[str]) -> DataFrame:
    """(origin, branch): the first of the preferred branches that an origin has, else its head (``head`` true)."""
    order = F.array_position(F.array(*map(F.lit, preferred)), F.col("branch"))
    usable = refs.where((order > 0) | F.col("head"))
    return usable.groupBy("origin").agg(F.min_by("branch", F.struct(F.when(order > 0, order).otherwise(len(preferred) + 1), F.col("branch"))).alias("branch"))


def touched_since(files: DataFrame, start: Column) -> DataFrame:
    """The notes that a run wrote: changed at its start or later, outside the editor's own folder."""
    return files.where((F.col("mtime") >= start) & F.col("path").endswith(".md") & ~F.array_contains(F.split("path", "/"), ".obsidian"))


def flagged(marks: DataFrame, flag: str) -> DataFrame:
    """(branch): the branches that some session marked with a flag."""
    return marks.where(F.col(flag) & (F.col("branch") != "")).select("branch").distinct()


def clear_flag(marks: DataFrame, applied: DataFrame, flag: str) -> DataFrame:
    """The marks with a flag taken back on the branches that it was applied to, so that it works once."""
    done = applied.select("branch", F.lit(True).alias("_done")).distinct()
    return marks.join(done, "branch", "left").withColumn(flag, F.when(F.col("_done"), F.lit(False)).otherwise(F.col(flag))).drop("_done").select(*marks.columns)


def audit_trace(notes: DataFrame, traces: DataFrame, section: str = "## Audit") -> DataFrame:
    """Notes with a line of (path, line) appended to a section at their end, which is made where there is none."""
    said = traces.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("_lines"))
    head = F.when(F.contains("body", F.lit(section)), F.lit("\n")).otherwise(F.lit(f"\n\n{section}\n"))
    return notes.join(said, "path", "left").withColumn("body", F.when(F.col("_lines").isNull(), F.col("body")).otherwise(
        F.concat(F.regexp_replace("body", r"\s+$", ""), head, F.col("_lines"), F.lit("\n")))).drop("_lines")
