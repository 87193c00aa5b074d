"""Tickets, branches and transcripts: lookups with preference, gates and merge evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import durable
from . import incremental as I
from .history import History
from .retrieval import tokens_within

# Statuses of tickets that still take captures, and of those that do not.
OPEN, SETTLED = ("open", "in-progress", "experimental", ""), ("resolved", "experimental", "discarded")


def open_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.coalesce("status", F.lit("")).isin(*OPEN))


def may_capture(status: Column) -> Column:
    """Null counts as open."""
    return ~F.coalesce(status, F.lit("")).isin(*SETTLED)


def shallowest(files: DataFrame, key: str) -> DataFrame:
    """(key, path): of a key's files the one least deep, then the first by path."""
    depth = F.size(F.split("path", "/"))
    return files.groupBy(key).agg(F.min_by("path", F.struct(depth, F.col("path"))).alias("path"))


def marked_transcripts(marks: DataFrame, logs: DataFrame) -> DataFrame:
    """(session_id, path): the first log that holds a mark's token and was changed no more than a day before the mark; null where none does.

    ``marks`` has session_id, mark_token and marked_at; ``logs`` path, text and mtime. Logs are read once for all tokens, and only paths and times leave them. A null or empty token
    stands in no log.
    """
    asked = durable(marks.select("session_id", F.col("mark_token").alias("token"), (F.col("marked_at") - F.expr("INTERVAL 1 DAY")).alias("at")))
    met = tokens_within(logs.select(F.struct("path", "mtime").alias("id"), "text"), asked.select("token"))
    # of a token and a time one log, and one mark; then the least path from a time on, by day and inside the day, and never mark by log
    first = met.groupBy("token", F.col("id.mtime").alias("at")).agg(F.min("id.path").alias("path"))
    times = durable(first.unionByName(asked.where("token <> ''").select("token", "at").distinct(), allowMissingColumns=True).withColumn("day", F.to_date("at")))
    inside = Window.partitionBy("token", "day").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("token").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = times.groupBy("token", "day").agg(F.min("path").alias("_day")).select("token", "day", F.min("_day").over(ahead).alias("later"))
    least = times.select("token", "at", "day", F.min("path").over(inside).alias("path")).join(days, ["token", "day"]).groupBy("token", "at").agg(F.min(F.least("path", "later")).alias("path"))
    found = asked.join(least, ["token", "at"]).where("path IS NOT NULL").groupBy("session_id").agg(F.min("path").alias("path"))
    return marks.select("session_id").join(found, "session_id", "left")


def session_transcripts(sessions: DataFrame, by_id: DataFrame, by_cwd: DataFrame) -> DataFrame:
    """(session_id, path): by session id, else by encoded working folder."""
    second = by_cwd.select(F.col("folder").alias("_folder"), F.col("path").alias("_path"))
    both = sessions.join(by_id, "session_id", "left").join(second, T.encode_cwd(F.col("cwd")) == F.col("_folder"), "left")
    return both.select("session_id", F.coalesce("path", "_path").alias("path"))


def folder_of_branch(asked: DataFrame, folders: DataFrame) -> DataFrame:
    """(branch, path): of the folders with a branch's name that in the project of the working folder, else the first."""
    project = F.element_at(F.split("cwd", r"[/\\]"), -1)
    met = asked.join(folders, "branch").withColumn("_other", (F.col("project") != project).cast("int"))
    nth = F.row_number().over(Window.partitionBy("branch").orderBy("_other", "path"))
    return met.withColumn("_nth", nth).where("_nth = 1").select("branch", "path")


def merged_by_parent(tips: DataFrame, commits: DataFrame) -> DataFrame:
    """Tips (branch, sha) that a merge commit names as a later parent."""
    merged = commits.select("origin", F.explode(F.slice("parents", F.lit(2), F.greatest(F.size("parents") - 1, F.lit(0)))).alias("sha"))
    return tips.join(merged, ["origin", "sha"], "left_semi")


def merged_by_patch(own: DataFrame, base: DataFrame) -> DataFrame:
    """(branch, commits, found, merged): whether each of a branch's patch ids stands in the base."""
    known = base.select("origin", "patch_id").distinct().withColumn("_in", F.lit(True))
    return own.join(known, ["origin", "patch_id"], "left").groupBy("branch").agg(
        F.count("*").alias("commits"), F.count("_in").alias("found")).withColumn("merged", F.col("commits") == F.col("found"))


def nothing_new(counts: Column, kind: Column) -> Column:
    """Examined without new knowledge: no adds, adjustments or refutations, and a capture that is still under way confirms something."""
    none = (counts["adds"] + counts["adjusts"] + counts["refutes"]) == 0
    return F.coalesce(none & ((kind == "finalize") | (counts["confirms"] > 0)), F.lit(False))


def landed(history: History, reach: DataFrame, seen: DataFrame, bases: DataFrame, since: DataFrame, commits: DataFrame | None) -> DataFrame:
    """(origin, branch, sha, day) of merged branches that are still to be captured; ``reach``, ``seen`` and ``commits`` as for ``new_commits``.

    After the branch's mark where it has one. Else what its tip reaches and the merge's first parent (``bases``: origin, branch, sha, where
    there was a merge commit) does not, from the window's day on.
    """
    dated = since.where("kind = 'date'").select("origin", "branch")
    trunk = history.reach(bases.join(dated, ["origin", "branch"], "left_semi").select("origin", "branch", "sha"), ["branch"])
    return I.new_commits(history, reach, seen, commits, since, trunk).drop("source")


def nearest_index(notes: DataFrame, indexes: DataFrame, levels: int = 3) -> DataFrame:
    """(path, index): the index of the nearest folder above a learning's own, ``levels`` folders up at most; null where there is none."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1)
    parts = F.split(folder, "/")
    above = notes.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/")))).alias("up", "folder"))
    known = indexes.select(F.regexp_replace("path", "/_index\\.md$", "").alias("folder"), F.col("path").alias("index"))
    return above.join(known, "folder", "left").groupBy("path").agg(F.min_by("index", F.when(F.col("index").isNotNull(), F.col("up"))).alias("index"))


def best_per_neighbour(hits: DataFrame) -> DataFrame:
    """(path, other, score) of chunk hits (path, other, score): the best chunk of each other learning; a note itself and indexes do not count."""
    usable = (F.col("path") != F.col("other")) & ~F.col("other").endswith("_index.md") & T.is_learning(F.col("other"))
    return hits.where(usable).groupBy("path", "other").agg(F.max("score").alias("score"))


def first_try_per_host(failures: DataFrame) -> DataFrame:
    """Failed fetches (run, origin, message) that ask for a new login: one attempt a host and run."""
    asked = failures.where(F.col("message").rlike(T.AUTH_FAILURE)).withColumn("host", T.url_host(F.col("origin"))).where("host <> ''")
    nth = F.row_number().over(Window.partitionBy("run", "host").orderBy("origin"))
    return asked.withColumn("_nth", nth).where("_nth = 1").select("run", "host", "origin")


def cited_reads(reads: DataFrame, cited: DataFrame) -> DataFrame:
    """(session_id, vault_reads, vault_tokens, cited_reads, cited_tokens): reads by path, of which cited in their session."""
    keys = cited.select("session_id", T.stem(F.col("cited")).alias("key")).distinct().withColumn("_cited", F.lit(True))
    met = reads.withColumn("key", T.stem(F.col("path"))).join(keys, ["session_id", "key"], "left")
    hit = F.col("_cited").isNotNull()
    return met.groupBy("session_id").agg(
        F.count("*").alias("vault_reads"), F.sum("tokens").alias("vault_tokens"), F.count_if(hit).alias("cited_reads"), F.coalesce(F.sum(F.when(hit, F.col("tokens"))), F.lit(0)).alias("cited_tokens"))


def ticket_block(tickets: DataFrame, learnings: DataFrame, fields: tuple[str, ...], most: int = 8) -> DataFrame:
    """(ticket_dir, block): a ticket's fields that are set, one a line, and its first ``most`` learnings by path."""
    lines = F.filter(F.array(*(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.concat(F.lit(f + ": "), F.col(f).cast("string"))) for f in fields)), lambda x: x.isNotNull())
    names = learnings.groupBy("ticket_dir").agg(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.col("path")))), 1, most).alias("_names"))
    both = tickets.join(names, "ticket_dir", "left")
    return both.select("ticket_dir", F.array_join(F.concat(lines, F.coalesce("_names", F.array().cast("array<string>"))), "\n").alias("block"))
