"""Near-duplicate instructions: an inverted join over MinHash signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import components, spread, stored, text_rows

K = 32  # signature coordinates
BLOCK = 60_000  # shingles of the documents that are compared in one task
_MUL = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hash of each word met, up to a limit of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _Words()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer than ``width`` words make one shingle, none none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    v = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        v = (v ^ (v >> np.uint64(31))) * _MUL + h[i:len(h) - k + 1 + i]
    v ^= v >> np.uint64(32)
    v *= _MUL
    return np.unique(v ^ (v >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(K, ~np.uint64(0))
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[i:i + 4096, None] * _FACTORS).min(0))
    return out


def choose_matches(percent: int, miss: float = 2e-5) -> int:
    """The most coordinates of ``K`` of which a pair at ``percent`` shares fewer no more often than ``miss``; one at least."""
    p, matches, below = percent / 100, 0, 0.0
    while matches < K and (below := below + comb(K, matches) * p**matches * (1 - p) ** (K - matches)) <= miss:
        matches += 1
    return max(1, matches)


def _links(percent: int, matches: int):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links of side 0 with all rows: only pairs that nothing connects yet are confirmed."""
        # by side, the hub first, each row once; in numpy, as most groups are tiny
        no, side = rows["row_no"].to_numpy(np.int64), rows["side"].to_numpy(np.int64)
        order = np.lexsort((no, ~rows["first"].to_numpy(bool), side))
        order = order[np.sort(np.unique(no[order], return_index=True)[1])]
        no, left = no[order], int((side[order] == 0).sum())
        shingles, sigs = rows["shingles"].to_numpy(), rows["sig"].to_numpy()
        sets = [np.frombuffer(shingles[i], "<u8") for i in order]
        n = np.array([len(s) for s in sets])
        sig = np.stack([np.frombuffer(sigs[i], "<u8") for i in order]) if len(order) else np.empty((0, K), np.uint64)
        root = np.arange(len(order))
        a, b = [], []
        for i in range(left):
            other = np.flatnonzero(root != root[i])
            other = other[(other > i) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            other = other[(sig[other] == sig[i]).sum(1) >= matches]
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(n[other])[:-1]]))
            for j in other[100 * both >= percent * (n[other] + n[i] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    a.append(no[i])
                    b.append(no[j])
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return link


def near_duplicates(episodes: DataFrame, percent: int = 85, salts: int = 64) -> DataFrame:
    """Groups of near-equal instructions (episode_index, instruction): links at ``percent`` of Jaccard on 5-word shingles.

    1. Texts with the same shingle set form a class; one row stands for it.
    2. A class is posted under each of its ``K`` MinHash coordinates. A candidate pair shares ``matches`` of them, as
       many as ``choose_matches`` gives for ``percent``. A posting of one class is of no use, and a class with fewer
       than ``matches`` useful ones has no partner. Of the others the ``r - matches + 1`` rarest postings are enough:
       two classes that agree in ``matches`` coordinates meet in one of them. So a passage that many texts share,
       being frequent, is merged last and mostly skipped.
    3. Postings with the same hub (the member whose coordinates are the most frequent) become one group; a pair in it is
       kept if it agrees in ``matches`` coordinates and the full sets confirm it. Groups up to ``BLOCK`` shingles are
       compared in one task. A larger group is cut into blocks: first the hub against every block, then the members that
       the hub does not link, block by block, against all. Pairs that links already connect are left out, as the
       components cannot change; no pair list of a group is ever made.
    4. Components of the links by star rounds.

    Returns one row per episode: episode_index, n_shingles, component_index (smallest episode_index reachable), kept.

    Texts without words have no shingles, stand alone and are kept. Null counts as empty text. A null index takes part,
    is never the smallest beside others, and is kept only in a component of nulls. Repeated rows are equal texts. No
    rows: no rows. Further columns are ignored.
    """
    matches = choose_matches(percent)
    schema = pa.schema([("episode_index", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64()))])

    def sign(tables):
        for t in tables:
            rows = []
            for episode, text in zip(t.column(0).to_pylist(), t.column(1)):
                s = shingle_set(text.as_py())
                rows.append((episode, len(s), blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
                             signature(s).view(np.int64) if len(s) else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    rows = texts.mapInArrow(sign, "episode_index long, n long, key binary, sig array<long>")
    rows = stored(rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("salt", spread("row_no", salts)), "minhash")

    # classes; a set that very many rows share is folded per salt first, and joined back per salt
    folded = rows.where("n > 0").groupBy("key", "salt").agg(F.min("row_no").alias("r"))
    rep = folded.groupBy("key").agg(F.min("r").alias("rep"))
    classes = stored(folded.join(rep, "key").select("key", "salt", "rep"), "minhash-classes")
    reps = rows.join(classes, ["key", "salt"]).where("row_no = rep").select("row_no", "episode_index", "key", "n", "sig")

    posted = reps.select("row_no", "n", F.posexplode("sig")).select("row_no", "n", F.xxhash64("pos", "col").alias("post"))
    useful = posted.groupBy("post").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = posted.join(useful, "post").groupBy("row_no", "n").agg(F.sort_array(F.collect_list(F.struct("c", "post"))).alias("l"), F.sum("c").alias("weight"))
    listed = listed.where(F.size("l") >= matches)
    prefix = stored(listed.select("row_no", "n", "weight", F.explode(F.slice("l", F.lit(1), F.size("l") - (matches - 1))).alias("x")).select(
        "row_no", "n", "weight", "x.post"), "minhash-postings")
    hubs = prefix.groupBy("post").agg(F.max(F.struct("weight", (-F.col("row_no")).alias("no"))).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = prefix.join(hubs.select("post", (-F.col("h.no")).alias("hub")), "post").select("hub", "row_no", "n").distinct()
    members = stored(members, "minhash-members")
    groups = members.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(groups, "hub")

    # full sets of the members only
    wanted = members.select("row_no").distinct().join(reps.drop("n"), "row_no")
    found = texts.join(wanted.select("row_no", "key", "sig", F.col("episode_index").alias("e")), F.col("episode_index").eqNullSafe(F.col("e"))).select("row_no", "key", "sig", "instruction")
    set_schema = pa.schema([("row_no", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])

    def full(tables):
        for t in tables:
            out = []
            for no, key, sig, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2), t.column(3)):
                s = shingle_set(text.as_py())
                if blake2b(s.tobytes(), digest_size=16).digest() == key:
                    out.append({"row_no": no, "sig": np.array(sig.as_py(), np.int64).tobytes(), "shingles": s.astype("<u8").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, set_schema)

    sets = stored(found.mapInArrow(full, "row_no long, sig binary, shingles binary"), "minhash-sets")

    def compare(pairs: DataFrame, *by: str) -> DataFrame:
        """``pairs``: the columns ``by``, row_no, side, first."""
        return pairs.join(sets, "row_no").groupBy(*by).applyInPandas(_links(percent, matches), "a long, b long")

    no_side = F.lit(0).alias("side")
    is_hub = (F.col("hub") == F.col("row_no")).alias("first")
    small = members.where("blocks = 1").select("hub", F.lit(0).alias("block"), "row_no", no_side, is_hub)
    large = stored(members.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("row_no"), "blocks").cast("int")), "minhash-blocks")
    star = large.where("hub <> row_no").select("hub", "block", "row_no", F.lit(1).alias("side"), F.lit(False).alias("first"))
    star_hub = large.select("hub", "blocks").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("row_no"), no_side, F.lit(True).alias("first"))
    first = stored(compare(small, "hub", "block").withColumn("large", F.lit(False)).unionByName(
        compare(star.unionByName(star_hub), "hub", "block").withColumn("large", F.lit(True))), "minhash-links")

    done = first.where("large").select(F.col("a").alias("hub"), F.col("b").alias("row_no"))
    open_rows = large.where("hub <> row_no").join(done, ["hub", "row_no"], "left_anti")
    parts = open_rows.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    open_rows = stored(open_rows.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "row_no"), "parts").cast("int")), "minhash-open")
    left = open_rows.select("hub", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row_no", no_side, F.lit(False).alias("first"))
    right = large.join(parts, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "row_no", F.lit(1).alias("side"), F.lit(False).alias("first"))
    second = compare(left.unionByName(right), "hub", "part", "block")

    joined = components(first.select("a", "b").unionByName(second), "minhash-components")
    to = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "salt", F.coalesce("component", "rep").alias("component"))
    placed = stored(rows.where("n > 0").join(to, ["key", "salt"]).select("row_no", "episode_index", "n", "component", "salt"), "minhash-placed")
    # smallest index per component, folded and joined back per salt like the classes
    low = placed.groupBy("component", "salt").agg(F.min("episode_index").alias("low"))
    low = low.join(low.groupBy("component").agg(F.min("low").alias("component_index")), "component").select("component", "salt", "component_index")
    alone = rows.where("n = 0").select("episode_index", F.col("n").alias("n_shingles"), F.col("episode_index").alias("component_index"))
    out = placed.join(low, ["component", "salt"]).select("episode_index", F.col("n").alias("n_shingles"), "component_index").unionByName(alone)
    return out.withColumn("kept", F.col("episode_index").eqNullSafe(F.col("component_index")))
