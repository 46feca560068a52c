"""Structured Streaming: change events, dirty state, log tails, session windows, incremental upkeep.

Every stream here has a batch twin with the same result, which the tests compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FS_EVENTS = "root string, ts timestamp, kind string, path string, is_dir boolean"
IGNORE_FILES = r"(^|/)(\.gitignore|\.ignore|\.opencodeignore)$"


def event_class(kind: Column | str = "kind", path: Column | str = "path", is_dir: Column | str = "is_dir") -> Column:
    """noop, paths or unknown: access is nothing, ignore files, folders and overflows need a full look, the rest names paths."""
    k, p, d = (F.col(c) if isinstance(c, str) else c for c in (kind, path, is_dir))
    return F.when(k.isin("access", "noop"), "noop").when(k.isin("overflow", "rescan") | p.isNull() | p.rlike(IGNORE_FILES) | d, "unknown").otherwise("paths")


def _marked(events: DataFrame, lateness: str) -> DataFrame:
    """Streams get a watermark on ``ts``, which has to be a timestamp with time zone for that; tables stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if events.isStreaming else events


def coalesced(events: DataFrame, window: str = "120 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """The last event of each (root, path) in each debounce window; works on streams and on tables.

    The aggregate keeps one row for each key, so state is bounded by the paths that change within the lateness.
    """
    marked = _marked(events, lateness)
    last = F.max_by(F.struct("kind", "is_dir"), "ts")
    return marked.groupBy(F.window("ts", window).alias("w"), "root", "path").agg(last.alias("e"), F.max("ts").alias("ts"), F.count("*").alias("events")).select("root", "path", F.col("w.end").alias("due"), "ts", "e.kind", "e.is_dir", "events")


def bounded(changes: DataFrame, capacity: int = 512) -> DataFrame:
    """``coalesced`` changes of one micro-batch (or table): where a root has more than ``capacity`` paths due at once, one row of kind ``rescan``.

    The queue that would have held the paths is full then, and only a full look finds them all.
    """
    n = changes.groupBy("root", "due").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"), F.sum("events").alias("_all"))
    full = n.filter(F.col("_n") > capacity)
    rescan = full.select("root", F.lit(None).cast("string").alias("path"), "due", F.col("_last").alias("ts"), F.lit("rescan").alias("kind"), F.lit(False).alias("is_dir"), F.col("_all").alias("events"))
    return changes.join(full.select("root", "due"), ["root", "due"], "left_anti").select(*rescan.columns).unionByName(rescan)


STATE = "mode string, paths string, epoch long"
DIRTY = "root string, mode string, paths array<string>, epoch long"


def dirty_step(mode: str, paths: list[str], epoch: int, rows: list[tuple], capacity: int) -> tuple[str, list[str], int]:
    """Clean, Paths or Unknown after some events in order; an acknowledgement clears only the epoch it saw."""
    known = dict.fromkeys(paths)
    for kind, path, is_dir, seen in rows:
        if kind == "ack":
            if seen == epoch:
                mode, known = "clean", {}
            continue
        if kind in ("access", "noop"):
            continue
        epoch += 1
        import re

        if mode == "unknown" or kind in ("overflow", "rescan") or path is None or is_dir or re.search(IGNORE_FILES, path):
            mode, known = "unknown", {}
            continue
        known[path] = None
        mode = "paths"
        if len(known) > capacity:
            mode, known = "unknown", {}
    return mode, list(known), epoch


def track_dirty(events: DataFrame, capacity: int = 512) -> DataFrame:
    """The dirty state of each root after each micro-batch; ``events`` has FS_EVENTS and ``seen`` (the epoch an ack refers to).

    State is the capacity's paths at most.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, joined, epoch = state.get if state.exists else ("clean", "", 0)
        paths = joined.split("\0") if joined else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rows = [(r.kind, None if pd.isna(r.path) else r.path, bool(r.is_dir), None if pd.isna(r.seen) else int(r.seen)) for r in rows.itertuples()]
        mode, paths, epoch = dirty_step(mode, paths, epoch, rows, capacity)
        state.update((mode, "\0".join(paths), epoch))
        yield pd.DataFrame({"root": [key[0]], "mode": [mode], "paths": [sorted(paths)], "epoch": [epoch]})

    return events.groupBy("root").applyInPandasWithState(update, DIRTY, STATE, "update", GroupStateTimeout.NoTimeout)


def access_mode(dirty: DataFrame, last_full: Column, now: Column, expires: int = 300) -> DataFrame:
    """skip, local or full for each root: what a reader has to do before it answers."""
    old = F.unix_timestamp(now) - F.unix_timestamp(last_full) > expires
    return dirty.withColumn("access", F.when((F.col("mode") == "unknown") | old, "full").when(F.col("mode") == "paths", "local").otherwise("skip"))


def tail_lines(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """New lines of log files as a stream of ``(source, line)``; files are picked up as they appear."""
    text = spark.readStream.format("text").option("pathGlobFilter", glob).load(folder)
    return text.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def session_log(events: DataFrame, window: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """The last event of each ``type:src:dest`` in each flush window: ``events(ts, type, src, dest)``."""
    marked = _marked(events, lateness)
    key = F.concat_ws(":", "type", "src", F.coalesce("dest", F.lit("")))
    return marked.groupBy(F.window("ts", window).alias("w"), key.alias("key")).agg(F.max("ts").alias("ts"), F.max_by("type", "ts").alias("type")).select(F.col("w.end").alias("flushed"), "key", "ts", "type")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, lateness: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts and sums with late data dropped beyond the watermark."""
    marked = _marked(events, lateness)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def session_counts(events: DataFrame, gap: str, lateness: str = "1 hour", by: str = "user_id") -> DataFrame:
    marked = _marked(events, lateness)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_join(left: DataFrame, right: DataFrame, key: str, within: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Pairs of events of two streams with one key and times within a bound; the bound and the watermarks limit state."""
    a, b = _marked(left, lateness), _marked(right, lateness)
    a, b = a.select(F.col(key).alias("k"), F.col("ts").alias("left_ts")), b.select(F.col(key).alias("rk"), F.col("ts").alias("right_ts"))
    return a.join(b, F.expr(f"k = rk AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")).select(F.col("k").alias(key), "left_ts", "right_ts")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, checkpoint: str, name: str | None = None, mode: str = "append"):
    """Processes what is there and stops. With ``sink`` each micro-batch goes to it (its number is the generation)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)
    query = writer.start()
    query.awaitTermination()
    return query


def maintain(publish: Callable[[dict[str, DataFrame], int], int], read: Callable[[str], DataFrame], parse: Callable[[DataFrame], dict[str, DataFrame]], full_share: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps file-keyed tables current: ``batch(path, language, content)``, null content deletes.

    Unchanged hashes are skipped before parsing. When more than ``full_share`` of the files change, edges are rebuilt, else only those
    of changed files and affected names. ``publish`` gets the batch's number, so that a batch which runs again after a failure is published once.
    """
    from ..operators import graph
    from ..sources.sinks import upsert_by_file

    def sink(batch: DataFrame, number: int) -> None:
        old = read("files")
        last = batch.groupBy("path").agg(F.max_by(F.struct("language", "content"), "seq").alias("x")).select("path", "x.*")
        fresh = last.join(old.select("path", F.col("content_hash").alias("h")), "path", "left").filter(~F.sha2("content", 256).eqNullSafe(F.col("h"))).drop("h").persist()
        changed = fresh.select(F.col("path").alias("file"))
        new = parse(fresh.filter("content is not null"))
        tables = {}
        for name in ("symbols", "refs", "imports"):
            tables[name] = upsert_by_file(read(name), new[name].select(*read(name).columns), changed)
        tables["files"] = upsert_by_file(old, new["files"].select(*old.columns), changed.withColumnRenamed("file", "path"), "path")
        n_old, n_new = old.count(), changed.count()
        if n_new > full_share * max(1, n_old):
            tables["edges"] = graph.resolve_edges(tables["refs"], tables["symbols"])
        else:
            names = graph.affected_names(read("symbols").join(changed, "file", "left_semi"), new["symbols"])
            tables["edges"] = graph.maintain_edges(read("edges"), tables["refs"], tables["symbols"], changed, names)
        publish(tables, number)
        fresh.unpersist()

    return sink
