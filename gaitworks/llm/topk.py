"""Exact top-k search over state vectors by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(vector: Column | str, scale: int = 1024) -> Column:
    """Each component x as floor(scale * x), x as double; null where the vector or a component is null or not finite."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))


def _matrix(vectors, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.stack(list(vectors)).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def exact_numbers(base: np.ndarray, queries: np.ndarray) -> np.dtype:
    """A type whose products and sums are exact here: doubles while every score stays below 2**53, else 64-bit integers."""
    top = float(np.abs(base).max(initial=0)) * float(np.abs(queries).max(initial=0)) * base.shape[1]
    return np.dtype(np.float64 if top < 2**53 else np.int64)


def threshold_search(base: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of one block's best ``k`` for a query, best first, ties to the smaller id.

    ``lists`` has each dimension's rows in rising order of their component; a query reads them from the top where its
    component is positive, else from the bottom, skipping dimensions in which it is 0. Each step reads every list
    further, scores the rows not seen yet, and stops once the sum of the query over the components read last is below
    the kth score (an equal bound could still hide a smaller id) or no row is unseen.
    """
    n = len(base)
    dims = np.flatnonzero(query)
    q = query[dims]
    down = q > 0
    seen = np.zeros(n, bool)
    rows, scores = np.empty(0, np.int64), np.empty(0, base.dtype)
    depth, step = 0, max(16, 2 * k)
    while depth < n:
        to = min(n, depth + step)
        met = seen.copy()
        if len(dims):
            met[lists[dims[~down], depth:to]] = True
            met[lists[dims[down], n - to:n - depth]] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~seen)
        seen = met
        fresh = fresh[ids[fresh] != own]
        found = base[fresh] @ query
        if len(rows) == k:
            fresh, found = fresh[found >= scores[-1]], found[found >= scores[-1]]
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, found])
        best = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
        depth, step = to, step * 3
        if seen.all():
            break
        if len(rows) == k:
            last = lists[dims, np.where(down, n - to, to - 1)]
            if q @ base[last, dims] < scores[-1]:
                break
    return rows, scores


def top_k(frames: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 16_384, query_block: int = 512) -> DataFrame:
    """The ``k`` frames of highest integer inner product for every query frame.

    ``frames`` and ``queries`` hold index and states. Components become floor(scale * x). A query's own index is no
    candidate. Frames are dealt into blocks of about ``block`` rows by a hash of their index, queries into blocks of
    about ``query_block``; a task holds one of each, sorts each dimension of the frame block and runs the threshold
    algorithm for each query. The block results, ``k`` a query, are merged by rank. Work is queries times blocks.

    Returns query_index, rank (from 1), index, score; all candidates if fewer than ``k``; ties go to the smaller index.
    Vectors that are null or hold null, NaN or infinite components take no part, and neither do null indexes. Shorter
    vectors count as filled up with 0. Scores are 64-bit integers: components must stay below 2**31 / sqrt(width) in
    size after scaling. Repeated frames are candidates each; repeated query rows are asked once per distinct vector. No
    frames or no queries: no rows. Further columns are ignored.
    """
    rows = frames.select(F.col("index").cast("long").alias("index"), scaled("states", scale).alias("v")).where("v is not null and index is not null")
    asked = queries.select(F.col("index").cast("long").alias("index"), scaled("states", scale).alias("v")).where("v is not null and index is not null").distinct()
    asked = asked.withColumn("query_no", F.xxhash64("index", "v"))
    (n, width), n_asked = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first(), asked.count()
    blocks, parts, width = max(1, -(-n // block)), max(1, -(-n_asked // query_block)), max(1, n and width or 1)
    deal = lambda c, m: F.pmod(F.xxhash64(F.lit(5), c), F.lit(m)).cast("int")
    # row numbers tell repeated frames apart in the merge
    left = rows.withColumn("b", deal("index", blocks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("p", deal("query_no", parts)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(base: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_index": [], "query_no": [], "index": [], "score": []}
        if len(base) and len(qs):
            ids = base["index"].to_numpy(np.int64)
            m = _matrix(base["v"], width)
            lists = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
            asked = _matrix(qs["v"], max(width, max(map(len, qs["v"]))))[:, :width]
            kind = exact_numbers(m, asked)
            m, asked = m.astype(kind), asked.astype(kind)
            for index, no, v in zip(qs["index"], qs["query_no"], asked):
                found, scores = threshold_search(m, ids, lists, v, index, k)
                out["query_index"] += [index] * len(found)
                out["query_no"] += [no] * len(found)
                out["index"] += ids[found].tolist()
                out["score"] += scores.astype(np.int64).tolist()
        return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in out.items()})

    near = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(search, "query_index long, query_no long, index long, score long")
    order = Window.partitionBy("query_index", "query_no").orderBy(F.desc("score"), "index")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_index", "rank", "index", "score")
