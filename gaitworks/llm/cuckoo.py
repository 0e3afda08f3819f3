"""Exact duplicates through a cuckoo-filter index of content digests."""

from __future__ import annotations

from array import array
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import spread, stored

SLOTS = 4  # fingerprints a bucket
KICKS = 64  # moves before a filter counts as full


class CuckooIndex:
    """Cuckoo filter over digests, with the entries kept in the buckets beside their fingerprints.

    A digest's hash gives a 16-bit fingerprint and two buckets; the second is the first xor a hash of the fingerprint. ``find`` answers most
    misses from the fingerprints and verifies each hit against the stored digest. ``add`` moves entries when both
    buckets are full; after ``KICKS`` moves the table doubles and is built anew from the stored digests. ``remove``
    frees the slot. Entries are lists that start with the digest; the rest is the caller's.
    """

    def __init__(self, buckets: int = 64):
        self.n = 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.entries: list[list | None] = [None] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(blake2b(digest, digest_size=12).digest(), "little")  # keys may differ in their last bytes only
        mark, first = h & 0xFFFF or 1, h >> 16 & self.buckets - 1
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 7 & self.buckets - 1)

    def find(self, digest: bytes) -> list | None:
        slot = self._slot(digest)
        return None if slot is None else self.entries[slot]

    def _slot(self, digest: bytes) -> int | None:
        mark, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            for k, m in enumerate(self.marks[bucket].tolist()):
                if m == mark and self.entries[bucket * SLOTS + k][0] == digest:
                    return bucket * SLOTS + k
        return None

    def add(self, entry: list) -> None:
        """Store an entry whose digest is not there yet."""
        waiting = [entry]
        while waiting:
            out = self._place(waiting[-1])
            if out is None:
                waiting.pop()
            else:  # full: whatever is in the table, and the one that found no room, wait for one twice as large
                waiting[-1] = out
                waiting += [e for e in self.entries if e is not None]
                self._make(self.buckets * 2)
        self.n += 1

    def _place(self, entry: list) -> list | None:
        """None, or the entry that found no room."""
        mark, a, b = self._places(entry[0])
        for bucket in (a, b):
            free = np.flatnonzero(self.marks[bucket] == 0)
            if len(free):
                self.marks[bucket, free[0]] = mark
                self.entries[bucket * SLOTS + int(free[0])] = entry
                return None
        bucket = b
        for k in range(KICKS):
            slot = bucket * SLOTS + (k * 7 + mark) % SLOTS
            was, self.entries[slot] = self.entries[slot], entry
            mark_was = int(self.marks.flat[slot])
            self.marks.flat[slot] = mark
            entry, mark = was, mark_was
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.marks[bucket] == 0)
            if len(free):
                self.marks[bucket, free[0]] = mark
                self.entries[bucket * SLOTS + int(free[0])] = entry
                return None
        return entry

    def remove(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot is None:
            return False
        self.marks.flat[slot] = 0
        self.entries[slot] = None
        self.n -= 1
        return True


def normalised(text: Column | str) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_duplicates(episodes: DataFrame, retired: DataFrame | None = None, salts: int = 64, task_rows: int = 1_000_000) -> DataFrame:
    """Equal instructions among ``episodes`` (episode_index, instruction).

    Texts are equal when the same after white-space normalisation; of equal ones the smallest episode_index stays.
    Returns one row per episode: episode_index, keep_index, group_size, kept, text_sha256. ``retired`` (episode_index)
    lists episodes that are withdrawn: their digests are deleted from the index, they count in no group, and they come
    back with null keep_index, group_size 0 and kept false.

    Only digests are shuffled. Each task holds a cuckoo index of its digests: first per (digest, salt), so that a text
    that a third of the rows share is spread over ``salts`` tasks' worth of groups, then over the partial groups per
    digest. A filter hit is verified against the full 256-bit digest in the bucket. Digests are stored in the shared
    folder between the passes.

    Null counts as empty text. A null episode_index takes part, loses to any other, and is kept only in a group of
    nulls. Repeated rows with one index are all marked kept if that index is. No rows: no rows. Further columns are
    ignored.
    """
    marked = episodes.select(F.col("episode_index").cast("long").alias("episode_index"), normalised("instruction").alias("t"))
    marked = marked.select("episode_index", F.unhex(F.sha2("t", 256)).alias("digest"))
    if retired is None:
        marked = marked.withColumn("live", F.lit(1))
    else:
        gone = retired.select(F.col("episode_index").cast("long").alias("episode_index")).distinct().withColumn("gone", F.lit(1))
        marked = marked.join(gone, "episode_index", "left").select("episode_index", "digest", F.when(F.col("gone").isNull(), 1).otherwise(0).alias("live"))
    marked = stored(marked.withColumn("salt", spread("episode_index", salts)), "digests")

    part = pa.schema([("digest", pa.binary()), ("salt", pa.int32()), ("keep_index", pa.int64()), ("group_size", pa.int64())])
    least = lambda a, b: b if a is None else a if b is None else min(a, b)

    def fold(tables):
        """Index live digests of (digest, salt); a withdrawn digest goes once no live row of this part holds it."""
        index = CuckooIndex()
        for t in tables:
            for digest, salt, episode, live in zip(*[c.to_pylist() for c in t.columns]):
                key = digest + salt.to_bytes(4, "little")
                entry = index.find(key)
                if entry is None:
                    index.add(entry := [key, None, 0, 0])
                entry[3] += 1
                if live:
                    entry[1], entry[2] = (episode if not entry[2] else least(entry[1], episode)), entry[2] + 1
        dead = [e[0] for e in index.entries if e is not None and not e[2]]
        for key in dead:
            index.remove(key)
        yield from _rows(([e[0][:-4], int.from_bytes(e[0][-4:], "little"), e[1], e[2]] for e in index.entries if e is not None), part)

    def merge(tables):
        index = CuckooIndex()
        for t in tables:
            for digest, salt, episode, n in zip(*[c.to_pylist() for c in t.columns]):
                entry = index.find(digest)
                if entry is None:
                    index.add([digest, episode, n, array("H", [salt])])
                else:
                    entry[1], entry[2] = least(entry[1], episode), entry[2] + n
                    entry[3].append(salt)
        yield from _rows(([e[0], s, e[1], e[2]] for e in index.entries if e is not None for s in e[3]), part)

    schema = "digest binary, salt int, keep_index long, group_size long"
    # an index is held in a task's memory: beyond ``task_rows`` rows a task there are more tasks than the session asks for
    tasks = -(-marked.count() // task_rows)
    many = (tasks,) if tasks > int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    partial = marked.select("digest", "salt", "episode_index", "live").repartition(*many, "digest", "salt").mapInArrow(fold, schema)
    groups = partial.repartition(*many, "digest").mapInArrow(merge, schema)
    return marked.join(groups, ["digest", "salt"], "left").select(
        "episode_index", F.when(F.col("live") == 1, F.col("keep_index")).alias("keep_index"),
        F.when(F.col("live") == 1, F.col("group_size")).otherwise(0).cast("long").alias("group_size"),
        ((F.col("live") == 1) & F.col("keep_index").eqNullSafe(F.col("episode_index"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _rows(rows, schema: pa.Schema, size: int = 20_000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
