"""Incremental state: change detection, caches with expiry and streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import is_text_file

STATE = "path string, sha256 string, size bigint, mtime_ns bigint"


def detect_changes(files: DataFrame, state: DataFrame, max_size: int = 2 << 20) -> DataFrame:
    """files (path, content, size, mtime_ns) with sha256 and changed.

    Equal size and time is unchanged without hashing; otherwise the hash decides; larger files count
    as unchanged.
    """
    old = state.select("path", F.col("sha256").alias("_h"), F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    j = files.join(old, "path", "left")
    same = F.coalesce((F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m")), F.lit(False))
    digest = F.when(same, F.col("_h")).otherwise(F.sha2(F.col("content"), 256))
    out = j.withColumn("sha256", digest)
    changed = (F.col("size") <= max_size) & ~same & (F.col("_h").isNull() | (F.col("_h") != F.col("sha256")))
    return out.withColumn("changed", changed).drop("_h", "_s", "_m")


def next_state(detected: DataFrame) -> DataFrame:
    """The new snapshot: hashes of all present files; paths that are gone fall away."""
    return detected.select("path", "sha256", "size", "mtime_ns")


def live_entries(cache: DataFrame, now: Column, hours: int = 24, stamp: str = "cached_at") -> DataFrame:
    """Entries of a cache that haven't expired; entries without a value (negative caching) count too."""
    return cache.where(F.col(stamp) > now - F.expr(f"interval {int(hours)} hours"))


def changed_files_stream(stream: DataFrame) -> DataFrame:
    """A stream of (path, content, size, mtime_ns) reduced to changed contents, with the last hash of each path as state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for r in b.sort_values("mtime_ns").itertuples(index=False):
                if r.sha256 != last:
                    out.append((r.path, r.sha256, r.size, r.mtime_ns))
                    last = r.sha256
        state.update((last,))
        yield pd.DataFrame(out, columns=["path", "sha256", "size", "mtime_ns"])

    hashed = stream.where(is_text_file(F.col("path"))).select("path", F.sha2("content", 256).alias("sha256"), "size", "mtime_ns")
    return hashed.groupBy("path").applyInPandasWithState(step, STATE, "sha256 string", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, stamp: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n): tumbling counts; rows later than the watermark are dropped in a stream and counted in a batch."""
    w = stream.withWatermark(stamp, late).groupBy(F.window(stamp, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, stamp: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session_start, session_end, key, n): session windows by a gap."""
    w = stream.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_reports(stream: DataFrame, stamp: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first report of each key within the watermark."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint_folder: str, mode: str = "append") -> None:
    """Processes what there is and ends; each gets every micro-batch."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start().awaitTermination()
