"""Stateful processors over RocksDB: what is kept for a key lies in value, list and map states of its own.

A turn appends to a list instead of rewriting it, timers wake only conversations
that have gone quiet, and the newest sealed events of a conversation stay beside
its open text, so that nobody has to read the event table back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.config import DEFAULT, MemoryConfig

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
Rows = Iterator[pd.DataFrame]


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own choice comes back afterwards."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


# -- open fragments ----------------------------------------------------------
SEALED = ("conv_id bigint, session_no bigint, part int, turns bigint, start_us bigint, end_us bigint, content string, "
          "closed_by string, oversized boolean, accepted array<bigint>, newest array<string>")
ACCEPTED = "accepted"
_SEALED_ROW = Row(*_names(SEALED))


class Fragments(StatefulProcessor):
    """Open text of a conversation, and the newest of its sealed parts.

    States: `open` (counters of the open part), `texts` (one entry a turn), `sealed`
    (session and part to start time, the newest `keep`). One event-time timer a
    conversation stands at the end of its quiet time while text is open.
    """

    def __init__(self, gap_minutes: int, cfg: MemoryConfig, keep: int):
        self.gap_us, self.stale_ms, self.most, self.keep = gap_minutes * 60_000_000, cfg.stale_hours * 3_600_000, cfg.force_threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session_no bigint, part int, turns bigint, chars bigint, start_us bigint, end_us bigint")
        self.texts = handle.getListState("texts", "text string")
        self.sealed = handle.getMapState("sealed", "session_no bigint, part int", "start_us bigint")

    def _seal(self, key, no, part, texts, start, end, why) -> Row:
        content = "\n".join(texts)
        return _SEALED_ROW(key, no, part, len(texts), start, end, content, why, len(content) > self.most, [], [])

    def _newest(self, sealed: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
        return sorted(sealed, key=lambda k: (-sealed[k], -k[1], -k[0]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.open.get()   # each call of a state is a message to the JVM, so none is asked in vain
        no, part, turns, chars, start, end = was or (0, 0, 0, 0, 0, 0)
        held = [t[0] for t in self.texts.get()] if turns else []
        fresh: list[str] = []   # texts of the open part that are not in the list state yet
        cleared, out, taken, gone = False, [], [], {}
        for row in sorted(rows, key=lambda r: (r.ts is None, r.ts or 0, r.turn)):
            at, text = _micros(row.ts), row.text or ""
            taken.append(int(row.turn))
            texts = len(held) + len(fresh)
            force = texts and at - end <= self.gap_us and chars + 1 + len(text) > self.most
            if texts and (force or at - end > self.gap_us):
                out.append(self._seal(key[0], no, part, held + fresh, start, end, "force" if force else "gap"))
                gone[no, part] = start
                held, fresh, cleared = [], [], True
            if force:
                part += 1
            elif not held and not fresh:
                no, part = no + 1, 0
            if not held and not fresh:
                start, chars = at, -1
            fresh.append(text)
            chars += 1 + len(text)
            end = max(end, at)
        (self.texts.put if cleared and turns else self.texts.appendList)([(t,) for t in fresh])
        self.open.update((no, part, len(held) + len(fresh), chars, start, end))
        newest = self._remember(gone, was is None)
        out.append(_SEALED_ROW(key[0], no, part, 0, start, end, "", ACCEPTED, False, taken, [f"{s}.{p}" for s, p in newest]))
        for timer in list(self.handle.listTimers()) if was else ():
            self.handle.deleteTimer(timer)
        # the timer may not lie behind the watermark, as it would for a late but accepted turn
        self.handle.registerTimer(max(end // 1000 + self.stale_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from out

    def _remember(self, gone: dict[tuple[int, int], int], new: bool) -> list[tuple[int, int]]:
        """Keep the newest sealed parts, those just sealed among them; newest first."""
        known = {} if new else {(k[0], k[1]): v[0] for k, v in self.sealed.iterator()}
        both = {**known, **gone}
        newest = self._newest(both)[:self.keep]
        for k in set(known).difference(newest):
            self.sealed.removeKey(k)
        for k in set(gone).intersection(newest):
            self.sealed.updateValue(k, (gone[k],))
        return newest

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        no, part, turns, _, start, end = self.open.get()
        if turns:
            yield self._seal(key[0], no, part, [t[0] for t in self.texts.get()], start, end, "stale")
            self.texts.clear()
            self.open.update((no, part, 0, 0, start, end))

    def close(self) -> None:
        pass


def unclosed_fragments(turns: DataFrame, gap_minutes: int, cfg: MemoryConfig = DEFAULT, keep: int | None = None) -> DataFrame:
    """Seal a conversation's open text at an inactivity gap, or when a further turn would take it over the force threshold; report it as stale after 24 quiet hours.

    Input is a stream of turns (`conv_id`, `turn`, `ts`, `text`) with a watermark on `ts`.
    Parts of one session are numbered from 0; what follows a forced seal is the next part, and the earlier ones are
    its prefixes. Session numbers of a conversation are never used twice: only the text of a stale one leaves the
    state. Open text is at most the threshold and one turn. A row whose `closed_by` is `accepted` names
    the turns that a batch took in, and the conversation's `keep` newest sealed parts as session.part, those of this batch
    included; turns behind the watermark appear in none. Start the query inside `rocksdb(spark)`.
    """
    return turns.groupBy("conv_id").transformWithState(
        Fragments(gap_minutes, cfg, cfg.n_results if keep is None else keep), SEALED, "append", "EventTime")


# -- phase timings -----------------------------------------------------------
PERF = "phase string, last_seq bigint, mean_ms double, samples int"


class PhaseWindow(StatefulProcessor):
    """The newest samples of a phase in a map by sequence number."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getMapState("samples", "seq bigint", "ms double")

    def handleInputRows(self, key, rows: Rows, timerValues) -> Rows:
        known = {k[0]: v[0] for k, v in self.samples.iterator()}
        both = dict(known)
        for pdf in rows:
            both.update(zip(pdf.seq.tolist(), pdf.elapsed_ms.tolist()))
            both = {s: both[s] for s in sorted(both)[-self.size:]}
        for s in set(known).difference(both):
            self.samples.removeKey((s,))
        for s in set(both).difference(known):
            self.samples.updateValue((s,), (both[s],))
        yield pd.DataFrame([(key[0], max(both), sum(both.values()) / len(both), len(both))], columns=_names(PERF))

    def close(self) -> None:
        pass


def perf_window(samples: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Mean of the newest 32 samples of each phase; a batch writes only the samples that enter or leave the window."""
    return samples.groupBy("phase").transformWithStateInPandas(
        PhaseWindow(cfg.perf_window), PERF, "update", "None")
