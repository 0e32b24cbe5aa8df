"""File and change events: debouncing, coalescing, hash differences, storms and a generation guard,
in batch form and as Structured Streaming transformations that share their rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import merge_or_copy, write_round
from ..ship import ship_package


def merge_kind(before: str | None, now: str, mode: str = "watcher") -> str | None:
    """The kind that two events of one path make; None: they cancel out (only in 'scheduler' mode)."""
    if before == "created" and now == "modified":
        return "created"
    if before == "removed" and now == "created":
        return "modified"
    if before == "created" and now == "removed":
        return "removed" if mode == "watcher" else None
    return now


def _merge_column(before: Column, now: Column, mode: str) -> Column:
    gone = F.lit("removed") if mode == "watcher" else F.lit(None).cast("string")
    return (
        F.when((before == "created") & (now == "modified"), "created")
        .when((before == "removed") & (now == "created"), "modified")
        .when((before == "created") & (now == "removed"), gone)
        .otherwise(now)
    )


def coalesce_batch(events: DataFrame, key: str, order: list[str], kind: str, mode: str = "watcher") -> DataFrame:
    """key, kind, n: an ordered fold of each key's events; keys whose events cancel out are left out.

    A key's events meet in one row: call it on one quiet window at a time."""
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, kind))).alias("_e"))
    folded = F.aggregate("_e", F.lit(None).cast("string"), lambda s, x: F.coalesce(_merge_column(s, x[kind], mode), x[kind]) if mode == "watcher" else _merge_column(s, x[kind], mode))
    return rows.select(key, folded.alias(kind), F.size("_e").alias("n")).where(F.col(kind).isNotNull())


def debounced(events: DataFrame, ts: str, quiet: str) -> DataFrame:
    """started, ended, n of the groups of events with no quiet gap between them. Works on streams with a
    watermark too; a session needs all its events, so on a hot stream give session_window a key."""
    return events.groupBy(F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def debounced_by(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    return events.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def hash_diff(events: DataFrame, key: str, order: list[str], hash_: str) -> DataFrame:
    """Events whose content hash differs from the key's last one, with change: added, modified or, if the hash is
    null, removed; what comes after a removal is added."""
    before = F.lag(hash_).over(Window.partitionBy(key).orderBy(*order))
    marked = events.withColumn("_before", before)
    change = F.when(F.col(hash_).isNull(), "removed").when(F.col("_before").isNull(), "added").otherwise("modified")
    return marked.where(~F.col("_before").eqNullSafe(F.col(hash_))).withColumn("change", change).drop("_before")


def trailing_counts(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """events plus n: events in the trailing window, itself and ties included; of those without a time, their number.

    A range frame over all rows would run in one task, and one that slides counts its rows anew for each row. Distinct
    times with their counts are steps instead: up in their cell of the window's length, down in the next cell when
    the window has left them. A cell starts with the count of the one before, so cells are independent and a row
    costs the same however many are in its window. Events of one time get its count by a join."""
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cell = F.col("_t") - F.pmod("_t", F.lit(width))
    step = lambda later, down: F.struct((cell + later).alias("_cell"), (F.col("_t") + later).alias("_at"), F.lit(down).alias("_down"))
    times = events.groupBy(micros.alias("_t")).agg(F.count("*").alias("_n"))
    steps = times.select("_t", "_n", F.inline(F.array(step(0, False), step(width, True)))).where("_t is not null or not _down")
    down = F.when(F.col("_down"), F.col("_n")).otherwise(0)
    # Whoever is as old as the window is still in it: down comes after up.
    so_far = Window.partitionBy("_cell").orderBy("_at", "_down").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = steps.withColumn("n", F.sum(down).over(Window.partitionBy("_cell")) + F.sum(F.col("_n") - 2 * down).over(so_far))
    counts = merge_or_copy(write_round(counts.where("not _down").select("_t", "n"), "counts"), 100)
    return events.withColumn("_time", micros).join(counts, F.col("_time").eqNullSafe(F.col("_t"))).drop("_time", "_t")


def generation_guard(events: DataFrame, session: str, arrival: str, epoch: str = "epoch", seq: str = "seq") -> DataFrame:
    """events plus verdict against the largest (epoch, seq) that the session showed before: accept,
    duplicate or stale."""
    top = F.max(F.struct(epoch, seq)).over(Window.partitionBy(session).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    now = F.struct(epoch, seq)
    verdict = F.when(top.isNull() | (now > top), "accept").when(now == top, "duplicate").otherwise("stale")
    return events.withColumn("verdict", verdict)


def two_phase_guard(events: DataFrame, key: str, arrival: str, phase: str = "phase", epoch: str = "epoch", seq: str = "seq") -> DataFrame:
    """events plus verdict. phase 'seen' announces an (epoch, sequence) of the key: accept if it is above all seen
    before, duplicate if it is the last one, else stale. phase 'commit' confirms it: commit only if it is
    still the last one seen, else stale."""
    now = F.struct(epoch, seq)
    seen = F.col(phase) == "seen"
    top = F.max(F.when(seen, now)).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    announced = F.when(top.isNull() | (now > top), "accept").when(now == top, "duplicate").otherwise("stale")
    return events.withColumn("verdict", F.when(seen, announced).when(now == top, "commit").otherwise("stale"))


def latest_wins(events: DataFrame, key: str, ts: str, quiet_ms: int, most: int) -> DataFrame:
    """key, n, closed and the columns of the last row of each batch of a key: a batch ends before a gap of more than
    quiet_ms, or with its row number `most`. Rows of one time have the order of their columns."""
    own = Window.partitionBy(key).orderBy("at_ms", "row_text")
    rows = _as_rows(events, key, ts)
    gap = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(own) > quiet_ms, F.lit(True))
    rows = rows.withColumn("_s", F.sum(gap.cast("int")).over(own))
    nth = F.row_number().over(Window.partitionBy(key, "_s").orderBy("at_ms", "row_text"))
    rows = rows.withColumn("_b", F.floor((nth - 1) / most))
    last = rows.groupBy(key, "_s", "_b").agg(F.max(F.struct("at_ms", "row_text")).alias("m"), F.count("*").alias("n"))
    return _from_rows(last.select(key, F.col("m.row_text").alias("row_text"), "n", F.when(F.col("n") == most, "number").otherwise("quiet").alias("closed")), events, key)


#: Times in full.
_FULL = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _as_rows(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, at_ms, row_text: a row as text, whose state has one form for all columns."""
    return events.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.to_json(F.struct(*events.columns), _FULL).alias("row_text"), *[c for c in [ts] if c != key])


def _from_rows(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    read = rows.withColumn("_r", F.from_json("row_text", events.schema, _FULL))
    return read.select(key, "n", "closed", *[F.col("_r").getField(c).alias(c) for c in events.columns if c != key])


# Streams


def coalesce_stream(events: DataFrame, key: str, ts: str, kind: str, quiet_ms: int = 500, mode: str = "watcher") -> DataFrame:
    """key, kind, n, emitted once a key was quiet for quiet_ms of event time (behind the watermark that
    events has to have). The same transitions as the batch form; state is one kind and count a key."""
    import pandas as pd

    ship_package(events.sparkSession)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n, _ = state.get
            state.remove()
            if last:
                yield pd.DataFrame({key: [name[0]], kind: [last], "n": [n]})
            return
        last, n, newest = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        for x in rows[kind]:
            last, n = merge_kind(last or None, x, mode) or "", n + 1
        newest = max(newest, int(rows[ts].max().timestamp() * 1000))
        state.update((last, n, newest))
        state.setTimeoutTimestamp(max(newest + quiet_ms, state.getCurrentWatermarkMs() + 1))

    kind_of = events.schema[key].dataType.simpleString()
    slim = events.select(key, ts, kind)
    return slim.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind_of}, `{kind}` string, n long", "last string, n long, newest long", "append", "EventTimeTimeout")


def hash_diff_stream(events: DataFrame, key: str, ts: str, hash_: str) -> DataFrame:
    """key, hash, change of events whose hash is new for the key, null hashes being removals; state is the last hash."""
    import pandas as pd

    ship_package(events.sparkSession)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for x in pd.concat(list(frames)).sort_values(ts, kind="stable")[hash_]:
            x = None if pd.isna(x) else x
            if x != last:
                out.append((name[0], x, "removed" if x is None else "added" if last is None else "modified"))
                last = x
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, hash_, "change"])

    kind_of = events.schema[key].dataType.simpleString()
    return events.select(key, ts, hash_).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind_of}, `{hash_}` string, change string", "last string", "append", "NoTimeout")


#: transformWithState keeps its state and timers in this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def two_phase_guard_stream(events: DataFrame, key: str, arrival: str, phase: str = "phase", epoch: str = "epoch", seq: str = "seq") -> DataFrame:
    """key, arrival, phase, epoch, seq, verdict: as two_phase_guard, where rows of a key arrive in order. State is
    the pair last seen and the pair last committed of each key, and outlives restarts with the checkpoint."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    ship_package(events.sparkSession)
    events.sparkSession.conf.set(*STORE)
    slim = events.select(key, arrival, phase, epoch, seq)

    class Guard(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("guard", "seen_epoch long, seen_seq long, done_epoch long, done_seq long")

        def handleInputRows(self, name, frames, timers):
            held = self.state.get() if self.state.exists() else (None,) * 4
            seen, done = tuple(held[:2]), tuple(held[2:])
            rows = pd.concat(list(frames)).sort_values(arrival, kind="stable")
            verdicts = []
            for kind, now in zip(rows[phase], zip(rows[epoch].astype(int), rows[seq].astype(int), strict=True), strict=True):
                if kind == "seen":
                    verdicts.append("accept" if seen[0] is None or now > seen else "duplicate" if now == seen else "stale")
                    seen = now if verdicts[-1] == "accept" else seen
                else:
                    verdicts.append("commit" if now == seen else "stale")
                    done = now if now == seen else done
            self.state.update(tuple(int(x) if x is not None else None for x in (*seen, *done)))
            yield rows[[key, arrival, phase, epoch, seq]].assign(verdict=verdicts)

        def close(self) -> None:
            pass

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.groupBy(key).transformWithStateInPandas(Guard(), f"{fields}, verdict string", "Append", "None")


def latest_wins_stream(events: DataFrame, key: str, ts: str, quiet_ms: int = 500, most: int = 100) -> DataFrame:
    """As latest_wins: a batch closes when the watermark that events has to have is quiet_ms past its last row, when a
    row comes after such a gap, or by its number of rows. State is a batch's last row and number."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    ship_package(events.sparkSession)
    events.sparkSession.conf.set(*STORE)
    rows, column = _as_rows(events, key, ts), key

    class Latest(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("batch", "row string, n long, newest long")

        def out(self, name, row, n, closed):
            return pd.DataFrame({column: [name[0]], "row_text": [row], "n": [n], "closed": [closed]})

        def handleInputRows(self, name, frames, timers):
            last, n, newest = self.state.get() if self.state.exists() else (None, 0, 0)
            for x in pd.concat(list(frames)).sort_values(["at_ms", "row_text"], kind="stable").itertuples(index=False):
                ms, row = int(x.at_ms), x.row_text
                if n and ms - newest > quiet_ms:
                    yield self.out(name, last, n, "quiet")
                    n = 0
                last, n, newest = row, n + 1, ms
                if n == most:
                    yield self.out(name, last, n, "number")
                    n = 0
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if n:
                self.state.update((last, n, newest))
                self.handle.registerTimer(newest + quiet_ms + 1)
            else:
                self.state.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                last, n, newest = self.state.get()
                self.state.clear()
                yield self.out(key, last, n, "quiet")

        def close(self) -> None:
            pass

    kind = events.schema[key].dataType.simpleString()
    found = rows.groupBy(key).transformWithStateInPandas(Latest(), f"`{key}` {kind}, row_text string, n long, closed string", "Append", "EventTime")
    return _from_rows(found, events, key)


def storms(events: DataFrame, ts: str, window: str, slide: str, least: int) -> DataFrame:
    """started, n, reconcile of sliding windows with at least `least` events; for batches and streams."""
    grouped = events.groupBy(F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).select(F.col("w.start").alias("started"), "n", F.lit(True).alias("reconcile"))


def rolling(events: DataFrame, ts: str, labels: list[str], value: str, window: str) -> DataFrame:
    """Count, sum and maximum by label and tumbling window; for update mode."""
    return events.groupBy(F.window(ts, window).alias("w"), *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
