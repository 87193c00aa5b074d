"""The library in one object: search, context, reading, marks, index upkeep and the dashboard."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import incremental as I
from .operators import links as L
from .operators import retrieval as R
from .operators.history import History
from .sources.notes import context_block
from .sources.versions import write_table


@dataclass
class Vault:
    """Notes as ``read_notes`` gives them; vectors (path, v), marks and runs where there are any."""

    notes: DataFrame
    vectors: DataFrame | None = None
    marks: DataFrame | None = None
    runs: DataFrame | None = None
    _looked: float | None = None

    def lexical_text(self) -> Column:
        """What is indexed: name, tags, module, description and project, not the body."""
        return F.concat_ws(" ", "name", F.array_join("tags", " "), "module", "description", "project")

    def weights(self) -> DataFrame:
        w = R.weight_of(F.col("scope"), R.SCOPE_WEIGHT) * R.weight_of(F.col("status"), R.STATUS_WEIGHT)
        return self.notes.select(F.col("path").alias("id"), w.alias("weight"))

    def search(self, queries: DataFrame, k: int = R.SHOWN) -> DataFrame:
        """(query_id, id, score, rank, tier) of (query_id, query) texts, with a vector q where ``vectors`` is given; k from 1 to 25."""
        k = min(max(k, 1), 25)
        scored = R.bm25(self.notes, "path", self.lexical_text(), queries, "query_id", F.col("query"))
        weighed = scored.join(self.weights(), "id").select("query_id", "id", F.round(F.col("bm25") * F.col("weight"), 6).alias("bm25")).where("bm25 > 0")
        lexical = R.top_k(weighed, "bm25", R.CANDIDATES).select("query_id", "id", "bm25")
        mode = "lexical"
        if self.vectors is None:
            ranked = lexical.withColumnRenamed("bm25", "score")
        else:
            mode = "hybrid"
            rows = self.vectors.select(F.col("path").alias("id"), "v")
            near = R.nearest(rows, queries.select("query_id", "q"), R.CANDIDATES).where(F.col("score") >= R.FLOOR)
            ranked = R.fuse(near.select("query_id", "id", F.col("score").alias("cos")), lexical, self.weights()).select("query_id", "id", "score")
        top = R.top_k(ranked, "score", k)
        best = top.where("rank = 1").select("query_id", R.tier(F.col("score"), mode).alias("tier"))
        return top.join(best, "query_id").select("query_id", "id", "score", "rank", "tier")

    def links(self) -> DataFrame:
        """The first ten links of each note with the paths that they lead to."""
        edges = self.notes.select(F.col("path").alias("src"), F.posexplode("links").alias("pos", "target"))
        return L.resolve(edges, self.notes.select(F.col("path").alias("id"), "name"))

    def inbound(self) -> DataFrame:
        """(id, inbound): how many other notes mention each note in any of their links, by its file name."""
        named = self.notes.select(F.col("path").alias("id"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "body")
        return L.inbound(L.mentions(named, "body"), named)

    def context(self, queries: DataFrame, k: int = R.SHOWN) -> DataFrame:
        """(query_id, block): the text to show with each query, 15,000 bytes at most.

        Its matches; for a tier of high the best note's excerpt; what the best two link to. A tier of low shows none.
        """
        found = self.search(queries, k).where(F.col("tier").isin("high", "mid"))
        shown = found.join(self.notes.select(F.col("path").alias("id"), "description", "body"), "id")
        match = F.format_string("- [[%s]] (score=%.2f) %s", "id", "score", T.clip(F.col("description"), 120))
        lines = shown.select("query_id", F.col("rank").cast("int").alias("place"), match.alias("line"))
        excerpt = shown.where("rank = 1 AND tier = 'high'").select("query_id", F.lit(100).alias("place"), T.excerpt(F.col("body")).alias("line"))
        related = L.one_hop(found, self.links()).select("query_id", (F.col("place") + 200).alias("place"), F.format_string("- related [[%s]]", "dst").alias("line"))
        return context_block(lines.union(excerpt).union(related), "query_id", "place", "line")

    def read(self, paths: DataFrame, most: int = 64_000) -> DataFrame:
        """Notes by path, cut to ``most`` bytes; a path that is not a note gives no row."""
        cut = F.when(F.octet_length("body") <= most, F.col("body")).otherwise(F.make_valid_utf8(F.substring(F.col("body").cast("binary"), 1, most).cast("string")))
        return self.notes.join(paths.select("path").distinct(), "path", "left_semi").select("path", "name", "status", cut.alias("body"))

    def mark(self, rows: DataFrame) -> DataFrame:
        """Marks with new (session_id, branch, ...) rows put in; of a session the new one holds."""
        clean = rows.withColumn("session_id", T.clean_session_id(F.col("session_id")))
        self.marks = clean if self.marks is None else I.upsert(self.marks, clean, "session_id")
        return self.marks

    def reindex(self, indexed: DataFrame, path: str | None = None, version: str = "1") -> DataFrame:
        """(path, action) against an index of (path, sha, version); rows of another version are updated whatever their sha, and an index
        without that column is of this version. The new index is written to ``path`` where one is given."""
        current = self.notes.where(F.length("body") > 0).select("path", "sha", F.lit(version).alias("version"))
        if "version" not in indexed.columns:
            indexed = indexed.withColumn("version", F.lit(version))
        signed = lambda df: df.select("path", F.concat_ws(":", "version", "sha").alias("_sign"))
        diff = I.snapshot_diff(signed(indexed), signed(current), "path", "_sign")
        if path is not None:
            write_table(current, path)
        return diff

    def recheck(self, load: Callable[[], DataFrame], seconds: float = 30.0) -> bool:
        """Load and cache the notes anew if the last look is ``seconds`` or more ago, or there was none; was it done?

        After an index has changed, ``seconds=0`` lets a long-lived session see it.
        """
        now = time.monotonic()
        if self._looked is not None and now - self._looked < seconds:
            return False
        self.notes.unpersist()
        self.notes, self._looked = load().cache(), now
        return True

    def stats(self) -> DataFrame:
        """Notes by scope, by project and in all."""
        return self.notes.groupingSets([[F.col("scope")], [F.col("project")], []], F.col("scope"), F.col("project")).agg(F.count("*").alias("n"))

    def overview(self) -> DataFrame:
        """(kind, key, n): totals, tickets by status, learnings by project, month and tag."""
        learnings = self.notes.where(T.is_learning(F.col("path")))
        tickets = self.notes.where("scope = 'index'")
        month = F.date_format("authored", "yyyy-MM")
        part = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), key.alias("key")).agg(F.count("*").alias("n"))
        parts = [part(learnings, "learnings", F.lit("")), part(tickets, "tickets", F.lit("")),
                 part(tickets, "status", F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))), part(learnings, "project", F.coalesce("project", F.lit(""))),
                 part(learnings.where("authored IS NOT NULL"), "month", month), part(learnings.select(F.explode("tags").alias("t")), "tag", F.col("t"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def list(self, project: str | None = None, scope: str | None = None, tag: str | None = None, q: str | None = None, limit: int = 500) -> DataFrame:
        """Learnings that meet all filters given, newest first and dateless last."""
        rows = self.notes.where(T.is_learning(F.col("path")))
        if project:
            rows = rows.where(F.col("project") == project)
        if scope:
            rows = rows.where(F.col("scope") == scope)
        if tag:
            rows = rows.where(F.array_contains("tags", tag))
        if q:
            rows = rows.where(F.lower(F.concat_ws(" ", "name", "description", F.array_join("tags", " "))).contains(q.lower()))
        return rows.orderBy(F.desc_nulls_last("authored"), F.desc("path")).limit(limit)

    def history(self, n: int = 100) -> DataFrame:
        """The last n runs of (ts, ...) rows."""
        return self.runs.orderBy(F.desc("ts")).limit(n)

    def capture(self, tips: DataFrame, commits: DataFrame, edges: DataFrame, marks: DataFrame, examined: DataFrame, installed: Column, today: Column,
                include_resolved: bool = False, ignore_marks: bool = False) -> DataFrame:
        """Commits (origin, branch, sha, day, deferred) to capture now; ``deferred`` for branches above the cap of 25 a run.

        ``tips`` is (origin, branch, tip), ``commits`` (origin, sha, day), ``edges`` (origin, sha, parent), ``marks`` (origin, branch, hwm) and ``examined``
        (origin, last_examined). New is what a branch reaches and its mark does not, or what its window takes in; branches whose ticket is settled are left out.
        """
        if not include_resolved:
            settled = self.notes.where((F.col("scope") == "index") & F.col("status").isin("resolved", "experimental", "discarded"))
            settled = settled.select(F.regexp_extract("ticket_dir", r"^[^/]+/[^/]+/(.*)$", 1).alias("branch"))
            tips = tips.join(settled, "branch", "left_anti")
        marks = marks.limit(0) if ignore_marks else marks
        history = History.of(edges, tips.select("origin", F.col("tip").alias("sha")))
        reach, seen = I.reach_and_seen(history, tips, marks)
        since = I.effective_since(tips, marks, examined, history, reach, installed, today)
        fresh = I.new_commits(history, reach, seen, commits, since)
        last = fresh.groupBy("origin", "branch").agg(F.max("day").alias("_last")).withColumn("_run", F.lit(1))
        branches = I.cap_and_defer(last, ["_run"], [F.desc("_last"), F.col("branch"), F.col("origin")], F.lit(25))
        return fresh.join(branches.select("origin", "branch", "deferred"), ["origin", "branch"]).select("origin", "branch", "sha", "day", "deferred")
