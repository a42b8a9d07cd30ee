"""Reconstruction of manifests from data files, recovery after a crash, and checks of shard state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The state's version and its greatest plausible write offset.
VERSION, MOST_OFFSET = 1, 1 << 40


def rebuild(files: DataFrame) -> DataFrame:
    """files (shard_id, path, entries, bytes) with start_entry and cumulative offsets, in the order of their paths."""
    w = Window.partitionBy("shard_id").orderBy("path")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "shard_id", "path", "entries", "bytes",
        F.coalesce(F.sum("entries").over(before), F.lit(0)).alias("start_entry"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start_offset"),
        F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end_offset"),
        F.lead("path").over(w).isNull().alias("is_current"),
    )


def validate(state: DataFrame) -> DataFrame:
    """state (shard_id, version, write_offset, last_entry) with valid, and the values after recovery."""
    ok = (F.col("version") == VERSION) & (F.col("write_offset") <= MOST_OFFSET) & (F.col("last_entry") >= -1)
    return state.select(
        "shard_id", ok.alias("valid"), F.lit(VERSION).alias("version_now"),
        F.when(ok, F.col("write_offset")).otherwise(0).alias("write_offset_now"), F.when(ok, F.col("last_entry")).otherwise(-1).alias("last_entry_now"),
    )


def needs_rebuild(manifest_heads: DataFrame, state: DataFrame, tolerance: int = 1000) -> DataFrame:
    """Shards whose manifest is empty though their state has entries, or is off by more than the tolerance."""
    joined = state.join(manifest_heads, "shard_id", "left").withColumn("durable_entry", F.coalesce("durable_entry", F.lit(0)))
    empty = (F.col("durable_entry") == 0) & (F.col("last_entry") >= 0)
    return joined.select("shard_id", (empty | (F.abs(F.col("last_entry") + 1 - F.col("durable_entry")) > tolerance)).alias("needs_rebuild"))


def choose(shards: DataFrame) -> DataFrame:
    """What opening a shard does: shards (shard_id, has_manifest, error, manifest_files, data_files, last_entry) with ``action``.

    load: the manifest as it is; rebuild: from the data files, where there are some and no manifest or an empty one, or where
    the state knows entries without a manifest; fail: a manifest that can't be read while no rebuild is due; new: nothing yet.
    """
    missing = ~F.col("has_manifest")
    rebuild = (missing & ((F.col("data_files") > 0) | (F.col("last_entry") >= 0))) | (F.col("error").isNull() & (F.col("manifest_files") == 0) & (F.col("data_files") > 0))
    action = F.when(rebuild, "rebuild").when(missing, "new").when(F.col("error").isNotNull(), "fail").otherwise("load")
    return shards.withColumn("action", action)


def recover(files: DataFrame, heads: DataFrame, found: DataFrame) -> DataFrame:
    """Each shard's head, next entry, write offset and last file after a crash, from what lies on disk.

    files: the manifest's, as ``rebuild`` names them (shard_id, path, entries, start_entry, start_offset, end_offset). heads:
    shard_id, head, write_offset. found: shard_id, path, size and the whole entries (scanned) of data files; a file that isn't
    there has no row. Only a shard's last file may differ:

    gone: it leaves the manifest, and the write offset is the end of the one before it; the head stays.
    shorter: what is left of it counts, and the head moves back to its last whole entry.
    longer: its entries count and the next entry follows them, but the head stays: what came after it was never durable.
    """
    w = Window.partitionBy("shard_id").orderBy("path")
    last = files.withColumn("__before", F.coalesce(F.lag("end_offset").over(w), F.lit(0))).withColumn("__last", F.lead("path").over(w).isNull()).where("__last")
    disk = found.select("shard_id", "path", "size", "scanned")
    own = heads.join(last.join(disk, ["shard_id", "path"], "left"), "shard_id", "left")
    end = F.col("end_offset") - F.col("start_offset")
    state = F.when(F.col("path").isNull(), "empty").when(F.col("size").isNull(), "gone").when(F.col("size") < end, "shorter").when(F.col("size") > end, "longer").otherwise("whole")
    own = own.withColumn("state", state)
    counted = F.col("start_entry") + F.col("scanned")
    is_ = lambda *names: F.col("state").isin(*names)
    return own.select(
        "shard_id", "state", F.when(is_("gone"), None).otherwise(F.col("path")).alias("last_path"),
        F.when(is_("shorter"), counted).otherwise(F.col("head")).alias("head"),
        F.when(is_("shorter", "longer"), counted).otherwise(F.col("head")).alias("next_entry"),
        F.when(is_("gone"), F.col("__before")).when(is_("shorter", "longer"), F.col("start_offset") + F.col("size")).otherwise(F.col("write_offset")).alias("write_offset"),
        F.when(is_("shorter", "longer"), F.col("scanned")).when(~is_("gone"), F.col("entries")).alias("last_entries"),
    )


def sync(states: DataFrame, heads: DataFrame) -> DataFrame:
    """The state follows the manifest: shard_id, last_entry and write_offset of heads (shard_id, head, write_offset), where the state says other."""
    joined = heads.join(states.select("shard_id", "last_entry", F.col("write_offset").alias("__offset")), "shard_id", "left")
    off = ~(F.col("last_entry").eqNullSafe(F.col("head") - 1) & F.col("__offset").eqNullSafe(F.col("write_offset")))
    return joined.select("shard_id", off.alias("moved"), (F.col("head") - 1).alias("last_entry"), "write_offset")
