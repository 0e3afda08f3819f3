"""Reading and writing packs: frames by episode chunk, small metadata tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHUNK = 1000  # fixed value: episodes per chunk directory


def scan_frames(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of every frame; pruning and filters reach the Parquet scan."""
    return spark.read.parquet(root).select(*columns)


def scan_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_pack(frames: DataFrame, root: str, key: str = "episode_index", index: str = "frame_index", rows_per_file: int = 1_000_000) -> None:
    """Frames under ``episode_chunk=<n>``, sorted so that row-group statistics prune episodes.

    Range partitioning on (chunk, episode, frame) keeps an episode's frames
    together and still splits a huge episode or chunk over several tasks.
    """
    t = frames.withColumn("episode_chunk", F.expr(f"{key} div {CHUNK}"))
    order = ["episode_chunk", key, index]
    t.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("episode_chunk").option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(root)


def write_meta(episodes: DataFrame, tasks: DataFrame, root: str) -> None:
    """Episode and task tables as JSON lines; one file each is fine only for tasks."""
    episodes.write.json(f"{root}/episodes")
    tasks.coalesce(1).write.json(f"{root}/tasks")


def pack_info(frames: DataFrame, fps: float, key: str = "episode_index", task: str = "task_index") -> DataFrame:
    per = frames.groupBy(key, task).agg(F.count(F.lit(1)).alias("_n"))
    eps = per.groupBy(key).agg(F.sum("_n").alias("_n")).agg(F.count(F.lit(1)).alias("total_episodes"), F.sum("_n").alias("total_frames"))
    tasks = per.select(task).distinct().agg(F.count(F.lit(1)).alias("total_tasks"))
    return eps.withColumn("total_tasks", tasks.scalar()).withColumns(
        {"total_chunks": F.ceil(F.col("total_episodes") / CHUNK), "fps": F.lit(float(fps))})


def not_yet_ingested(episodes: DataFrame, data: DataFrame, media: DataFrame, stats: DataFrame, key: str = "episode_index") -> DataFrame:
    """Episodes missing from at least one of the three outputs."""
    done = data.select(key).distinct().join(media.select(key).distinct(), key, "left_semi").join(stats.select(key).distinct(), key, "left_semi")
    return episodes.join(done, key, "left_anti")


def paired_files(spark: SparkSession, data_root: str, video_root: str, stem: str, every: int = 1) -> DataFrame:
    """Episode files that exist on both sides, every N-th in numeric order.

    Only the listing is read, never the contents.
    """
    from gaitworks.operators import ordering

    def listing(root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        n = F.regexp_extract("path", stem, 1)
        return files.where(n != "").select(n.cast("bigint").alias("episode"), "length").groupBy("episode").agg(F.count(F.lit(1)).alias("files"))

    both = listing(data_root).join(listing(video_root).select("episode"), "episode", "left_semi")
    t = ordering.global_index(both, ["episode"], "position")
    return t.where(F.col("position") % every == 0)


def upsert(base: DataFrame, inserts: DataFrame, updates: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Keyed merge: inserting an existing key is an error, updates override non-null cells, deletes drop."""
    cols = [c for c in base.columns if c != key]
    new = inserts.join(base.select(key).withColumn("_dup", F.lit(True)), key, "left")
    clash = F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast(dict(base.dtypes)[key])
    new = new.withColumn(key, F.when(F.col("_dup"), clash).otherwise(F.col(key))).drop("_dup")
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols if c in updates.columns])
    changed = base.join(u, key, "left").select(
        key, *[(F.coalesce(f"_u_{c}", c) if f"_u_{c}" in u.columns else F.col(c)).alias(c) for c in cols])
    return changed.unionByName(new.select(*base.columns)).join(deletes.select(key), key, "left_anti")


def append_chunk_log(chunks: DataFrame, root: str, run: str, keep: Column) -> Observation:
    """Append accepted chunks under ``run=<id>``; the observation counts written and dropped rows."""
    seen = Observation("chunk_log")
    t = chunks.observe(seen, F.count_if(keep).alias("written"), F.count_if(~keep).alias("dropped"))
    t.where(keep).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(root)
    return seen


def records_to_parquet(records: DataFrame, arrays: Mapping[str, str], root: str, rows_per_file: int) -> None:
    """Nested arrays flattened to one level, output parts of bounded size."""
    t = records.withColumns({out: F.flatten(src) for out, src in arrays.items()})
    t.write.option("maxRecordsPerFile", rows_per_file).parquet(root)


# --- raw captures, catalogue, evaluation logs ----------------------------------------------------

def ingest_raw(spark: SparkSession, path: str, frame_schema: str, fps: float, multiline: bool = True) -> DataFrame:
    """One document per episode (``episode_index`` and a ``data`` array) -> frame rows."""
    docs = spark.read.schema(f"episode_index bigint, data array<{frame_schema}>").option("multiLine", multiline).json(path)
    t = docs.select("episode_index", F.size("data").alias("_n"), F.posexplode("data").alias("_i", "_f"))
    return t.select(
        "episode_index", F.col("_i").cast("bigint").alias("frame_index"), (F.col("_i") / F.lit(float(fps))).alias("timestamp"),
        (F.col("_i") == F.col("_n") - 1).alias("done"), "_f.*",
    )


def scan_catalogue(spark: SparkSession, source: str | Mapping[str, str], robots: Sequence[str], robot: str, deleted: Column | None = None) -> DataFrame:
    """Catalogue rows of some robots, deleted ones left out; the filter is pushed to JDBC or Parquet."""
    df = spark.read.parquet(source) if isinstance(source, str) else spark.read.format("jdbc").options(**source).load()
    t = df.where(F.col(robot).isin(*robots))
    return t if deleted is None else t.where(~F.coalesce(deleted, F.lit(False)))


# Field names of a result line
LOG_FIELDS = {"room": "Room Idx", "episode": "Episode Label", "trial": "Trial Label", "result": "Result"}


def scan_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """``Task: ..., Result: ...`` header and the score line after it, as one row.

    The reader splits records on the header marker, so header and scores stay
    together wherever the file is split and no line order has to be rebuilt.
    """
    recs = spark.read.option("lineSep", "Task: ").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    head = F.get(lines, 0)
    cols = [F.regexp_extract(head, r"^([^,]*)", 1).alias("task")]
    cols += [F.regexp_extract(head, rf"{label}: ([^,\n]*)", 1).alias(n) for n, label in LOG_FIELDS.items()]
    scores = F.transform(F.filter(F.split(F.trim(F.get(lines, 1)), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    return recs.select(*cols, scores.alias("scores"))
