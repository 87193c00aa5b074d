"""Keyed state of streams that lives and ends by event time: repeat suppression, and what each session was shown.

State is kept by Spark's RocksDB store; timers drop what can no longer matter. Results do not depend on how a stream is cut
into batches, as long as the rows of a session come in order of time from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Totals of a session's last prompts that are kept, and blocks that sessions are dealt to.
RECENT, BLOCKS = 5, 512


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class Repeats(StatefulProcessor):
    """Of each key of a session the time of the last row that was kept; a key that was silent for ``purge_ms`` is forgotten."""

    def __init__(self, ttl_us: int, purge_ms: int) -> None:
        self.ttl_us, self.purge_ms = ttl_us, purge_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each access of the store is a round trip of its own, and there are as many as keys of a map
        self.last = handle.getValueState("last", "keys array<string>, us array<long>")

    def _known(self) -> dict[str, int]:
        told = self.last.get()
        return dict(zip(*told)) if told else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        known, changed, kept = self._known(), {}, []
        batch = pd.concat(frames, ignore_index=True).sort_values(["us_", "order_"], kind="stable")
        for at, name, us in zip(batch.index, batch["key_"], batch["us_"]):
            if name not in known or us - known[name] >= self.ttl_us:
                known[name] = changed[name] = int(us)
                kept.append(at)
        if changed:
            self.last.update((list(known), list(known.values())))
            self.handle.registerTimer(max(changed.values()) // 1000 + self.purge_ms)
        yield batch.loc[kept].drop(columns=["key_", "us_"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known = {k: us for k, us in self._known().items() if us // 1000 + self.purge_ms > now}
        if known:
            self.last.update((list(known), list(known.values())))
        else:
            self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def suppress_repeats(events: DataFrame, session: str, key: str, order: str, seconds: int = 60, purge: int = 600, delay: str = "10 minutes") -> DataFrame:
    """(session, order) of the rows of a stream that come ``seconds`` or more after the last kept row of their key in their session.

    Rows that are not kept do not move that time. State of a key goes ``purge`` seconds after it was last kept, which is never before it could still matter. A row that is older than
    the last kept one is a repeat; one more than ``delay`` behind the stream is dropped by Spark. ``key`` may be null, which is a key of its own.
    """
    ship(events.sparkSession)
    rows = events.withWatermark("ts", delay).select(
        session, "ts", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key_"), F.unix_micros("ts").alias("us_"), F.col(order).alias("order_"))
    kinds = [f"{session} {events.schema[session].dataType.simpleString()}", "ts timestamp", f"order_ {events.schema[order].dataType.simpleString()}"]
    kept = rows.groupBy(session).transformWithStateInPandas(Repeats(seconds * 1_000_000, max(purge, seconds) * 1000), ", ".join(kinds), "Append", "EventTime")
    return kept.select(session, F.col("order_").alias(order))


class Shown(StatefulProcessor):
    """What sessions were shown: totals, tokens by tier and by section, cited keys, and the last few prompts.

    The key is a block of sessions (column ``session``; without it, the key is the session). Their state is one value, as each key and each access of the store is a round trip of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "sessions string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = self.state.get()
        known, changed = dict(json.loads(told[0])) if told else {}, {}
        for batch in rows:
            names = batch["session"] if "session" in batch else [key[0]] * len(batch)
            for session, us, order, name, tokens, sections, keys in zip(names, *(batch[c] for c in ("us", "ord", "tier", "tokens", "sections", "cited"))):
                if session not in changed:
                    *counts, by_tier, by_section, cited, recent = known.get(session) or (0, 0, None, -1, -1, "", (), (), (), ())
                    changed[session] = [*counts, dict(by_tier), dict(by_section), set(cited), [tuple(x) for x in recent]]
                seen, us, order, tokens = changed[session], int(us), int(order), int(tokens)
                _, _, first, last, last_order, _, by_tier, by_section, cited, recent = seen
                seen[0] += 1
                seen[1] += tokens
                seen[2] = us if first is None else min(first, us)
                if (us, order) > (last, last_order):
                    seen[3:6] = us, order, name
                by_tier[name] = by_tier.get(name, 0) + 1
                for section, n in sections.items():
                    by_section[section] = by_section.get(section, 0) + int(n)
                cited.update(keys)
                recent.append((us, order, tokens))
                if len(recent) > 4 * RECENT:
                    recent[:] = sorted(recent)[-RECENT:]
        if not changed:
            return
        for seen in changed.values():
            seen[9] = sorted(seen[9])[-RECENT:]
        known |= {s: [*x[:6], list(x[6].items()), list(x[7].items()), sorted(x[8]), x[9]] for s, x in changed.items()}
        self.state.update((json.dumps(list(known.items()), separators=(",", ":")),))
        said = lambda d: json.dumps(dict(sorted(d.items(), key=lambda x: (x[0] is not None, x[0] or ""))), separators=(",", ":"), ensure_ascii=False)
        of = list(zip(*changed.values()))
        yield pd.DataFrame({"session": list(changed), "prompts": of[0], "total": of[1], "by_tier": map(said, of[6]), "by_section": map(said, of[7]), "cited": [",".join(sorted(x)) for x in of[8]],
                            "last_tier": of[5], "first_us": of[2], "last_us": of[3], "recent": [",".join(str(t) for _, _, t in x) for x in of[9]]})

    def close(self) -> None:
        pass


def session_state(prompts: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(session, prompts, total, by_tier, by_section, cited, last_tier, first_us, last_us, recent), sent out whenever it changes.

    ``prompts`` is (session, ts, ord, tier, output): the text that was shown. Tokens are a quarter of its bytes; sections are told by their heads; cited keys are the names of linked
    notes. A null or empty output has no tokens and no sections. Sessions are dealt to ``blocks``, and a batch reads and writes the state of those blocks that it has rows of.
    """
    from ..functions import text as T

    ship(prompts.sparkSession)
    output, kind = F.coalesce("output", F.lit("")), prompts.schema["session"].dataType.simpleString()
    rows = prompts.select(F.pmod(F.xxhash64("session"), F.lit(blocks)).alias("block"), F.coalesce(F.concat(F.lit("="), F.col("session").cast("string")), F.lit("")).alias("session"),
                          F.unix_micros("ts").alias("us"), F.col("ord").cast("long").alias("ord"), "tier",
                          F.when(output == "", F.lit(0)).otherwise(T.token_estimate(output)).cast("long").alias("tokens"), T.section_tokens(output).alias("sections"), T.cited_keys(output).alias("cited"))
    schema = "session string, prompts long, total long, by_tier string, by_section string, cited string, last_tier string, first_us long, last_us long, recent string"
    shown = rows.groupBy("block").transformWithStateInPandas(Shown(), schema, "Update", "None")
    return shown.withColumn("session", F.when(F.col("session") != "", F.substr("session", F.lit(2))).cast(kind))
