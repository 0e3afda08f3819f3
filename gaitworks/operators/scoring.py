"""Scoring of predictions: every report is one or two partial + final aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators.ordering import per_group
from gaitworks.session import stored


def segment_of(dim: Column, segments: Mapping[str, tuple[int, int]]) -> Column:
    """Name of the half-open span holding ``dim``; null outside all."""
    chain = None
    for name, (a, b) in segments.items():
        hit = (dim >= a) & (dim < b)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def success_rates(scores: DataFrame, task: str, score: str, order: Sequence[str], progress: str | None = None) -> DataFrame:
    """Mean score per task in a given order, then the mean over tasks; with ``progress`` its means as well."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(task))
    names = {"rate": score} | ({"progress_rate": progress} if progress else {})
    per = scores.groupBy(task).agg(*[F.avg(c).alias(n) for n, c in names.items()])
    both = per.rollup(task).agg(*[F.avg(n).alias(n) for n in names], F.grouping(task).alias("_all"))
    place = F.when(F.col("_all") == 1, F.lit(len(order) + 2)).otherwise(F.coalesce(F.nullif(rank, F.lit(0)), F.lit(len(order) + 1)))
    name = F.when(F.col("_all") == 1, F.lit("mean")).otherwise(F.col(task))
    return both.select(name.alias(task), place.cast("bigint").alias("place"), *names)


def subtask_progress(steps: Column, threshold: float = 0.5) -> Column:
    """Share of a trial's subtasks that have begun, by the scores ``steps`` (the first is the trial's success): all of
    them once the trial has succeeded."""
    begun = F.size(F.filter(steps, lambda x: x > 0)) / F.size(steps)
    return F.when(F.get(steps, 0) >= threshold, F.lit(1.0)).otherwise(begun)


def l1_by_group(errors: DataFrame, groups: Mapping[str, tuple[int, int]], dim: str = "dim", error: str = "err") -> DataFrame:
    """Mean abs error per dim, averaged over the dims of a group, with the maximum and an ``all`` row."""
    per = errors.groupBy(dim).agg(F.avg(error).alias("_m"), F.max(error).alias("_x"))
    named = per.withColumn("grp", segment_of(F.col(dim), groups)).where("grp is not null")
    t = named.rollup("grp").agg(F.avg("_m").alias("l1"), F.max("_x").alias("worst"), F.grouping("grp").alias("_g"))
    return t.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("grp")).alias("grp"), "l1", "worst")


def segment_norms(errors: DataFrame, keys: Sequence[str], segments: Mapping[str, tuple[int, int]], dim: str = "dim", error: str = "err") -> DataFrame:
    """Mean abs error per dim over frames, then the L2 norm per named segment."""
    per = errors.groupBy(*keys, dim).agg(F.avg(error).alias("_m"))
    named = per.withColumn("segment", segment_of(F.col(dim), segments)).where("segment is not null")
    return named.groupBy(*keys, "segment").agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("norm"))


def denormalised_l1(errors: DataFrame, bounds: DataFrame, segments: Mapping[str, tuple[int, int]], dim: str = "dim", error: str = "err", mask: str | None = None) -> DataFrame:
    """0.5 * err * (hi - lo), averaged over valid elements by segment; ``bounds`` has one row per dim."""
    real = 0.5 * F.col(error) * (F.col("hi") - F.col("lo"))
    if mask:
        real = F.when(F.col(mask), real)
    t = errors.join(F.broadcast(bounds), dim).withColumn("_r", real).withColumn("segment", segment_of(F.col(dim), segments))
    return t.where("segment is not null").groupBy("segment").agg(F.avg("_r").alias("l1"))


def token_accuracy(df: DataFrame, predicted: str, truth: str, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    counted = (F.col(truth) >= low) & (F.col(truth) < high)
    g = df.groupBy(*keys) if keys else df.groupBy()
    t = g.agg(F.count_if(counted & (F.col(predicted) == F.col(truth))).alias("correct"), F.count_if(counted).alias("counted"))
    return t.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("counted")))


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Boxes as x1, y1, x2, y2; empty union gives 0."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    inter = w * h
    return F.coalesce(F.try_divide(inter, F.nullif(area(a) + area(b) - inter, F.lit(0.0))), F.lit(0.0))


def action_distance(errors: DataFrame, batch: str, error: str = "err") -> DataFrame:
    """Frobenius norm over number of elements per batch, then the mean over batches."""
    per = errors.groupBy(batch).agg((F.sqrt(F.sum(F.col(error) * F.col(error))) / F.count(error)).alias("_d"))
    return per.agg(F.avg("_d").alias("distance"), F.count(F.lit(1)).alias("batches"))


def threshold_report(df: DataFrame, error: str, tokens: str, threshold: float = 0.1) -> DataFrame:
    return df.agg(
        F.count_if(F.col(error) > threshold).alias("above"), F.avg(error).alias("mean_error"),
        F.avg(tokens).alias("tokens_mean"), F.min(tokens).alias("tokens_min"), F.max(tokens).alias("tokens_max"),
    )


def chunk_report(frames: DataFrame, frame_keys: Sequence[str], modalities: Sequence[str]) -> DataFrame:
    """L1 by modality over the chunk and over its first step, by frame, by position, overall.

    ``frames`` has one row per frame and an array column of errors by step for each modality. The row is written once: the
    frame level is read inside it and never shuffled, the others keep a few sums a task. Null errors take no part.
    """
    rows = stored(frames.select(*frame_keys, *modalities), "chunk-errors")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).alias("err")) for m in modalities])).alias("z")
    per = rows.select(*frame_keys, each).select(*frame_keys, "z.modality", "z.err")
    there = F.filter("err", lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))
    framewise = per.select(F.lit("frame").alias("level"), *frame_keys, "modality", F.lit(None).cast("int").alias("step"), mean.alias("l1"), F.get("err", 0).alias("first_step_l1"))
    cells = per.select("modality", F.posexplode("err").alias("step", "err"))
    t = cells.groupingSets([[F.col("modality")], [F.col("step")], []], "modality", "step").agg(
        F.avg("err").alias("l1"), F.avg(F.when(F.col("step") == 0, F.col("err"))).alias("first_step_l1"), F.grouping("modality").alias("_m"), F.grouping("step").alias("_s"))
    level = F.when(F.col("_m") == 0, "modality").when(F.col("_s") == 0, "step").otherwise("all").alias("level")
    return framewise.unionByName(t.select(level, "modality", "step", "l1", "first_step_l1"), allowMissingColumns=True)


def warm_latency(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """First value apart; mean and population std of the rest, from sums so that no group is ordered in one task."""
    v = F.col(value)
    t = df.groupBy(key).agg(
        F.min_by(v, order).alias("first"), F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q")
    )
    n = F.col("_n") - 1
    mean = F.try_divide(F.col("_s") - F.col("first"), n)
    var = F.try_divide(F.col("_q") - F.col("first") * F.col("first"), n) - mean * mean
    return t.select(key, "first", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def mse_by_dataset(errors: DataFrame, dataset: str, sample: str, digits: int = 4) -> DataFrame:
    """Per-sample MSE and scaled L2, averaged per dataset and over all samples."""
    e = F.col("err")
    per = errors.groupBy(dataset, sample).agg(
        F.avg(e * e).alias("_mse"), F.avg(F.abs(e) / (F.col("norm") + 1e-3)).alias("_l2")
    )
    sums = per.groupBy(dataset).agg(F.sum("_mse").alias("_a"), F.sum("_l2").alias("_b"), F.count(F.lit(1)).alias("_n"))
    t = sums.rollup(dataset).agg(
        F.round(F.sum("_a") / F.sum("_n"), digits).alias("mse"), F.round(F.sum("_b") / F.sum("_n"), digits).alias("l2"),
        F.sum("_n").alias("samples"), F.grouping(dataset).alias("_g"),
    )
    return t.select(F.when(F.col("_g") == 0, F.col(dataset)).alias(dataset), "mse", "l2", "samples")


def frechet_moments(rows: DataFrame, keys: Sequence[str], predicted: Sequence[str], truth: Sequence[str]) -> DataFrame:
    """Means, traces and covariance gap over time; the matrix root term only on the diagonal.

    The covariance of an episode of one frame is zero.
    """
    aggs = []
    for i, (p, t) in enumerate(zip(predicted, truth)):
        aggs += [F.avg(p).alias(f"_mp{i}"), F.avg(t).alias(f"_mt{i}")]
        for j in range(i, len(predicted)):
            spread = lambda a, b: F.coalesce(F.nanvl(F.covar_samp(a, b), F.lit(None).cast("double")), F.lit(0.0))
            aggs += [spread(p, predicted[j]).alias(f"_cp{i}_{j}"), spread(t, truth[j]).alias(f"_ct{i}_{j}")]
    n = len(predicted)
    g = per_group(rows, keys, lambda r: r.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), *aggs))
    total = lambda cs: sum(cs[1:], cs[0])
    dist = total([(F.col(f"_mp{i}") - F.col(f"_mt{i}")) ** 2 for i in range(n)])
    tp, tt = (total([F.col(f"_{c}{i}_{i}") for i in range(n)]) for c in ("cp", "ct"))
    root = total([F.sqrt(F.greatest(F.col(f"_cp{i}_{i}") * F.col(f"_ct{i}_{i}"), F.lit(0.0))) for i in range(n)])
    gap = total([(F.col(f"_cp{i}_{j}") - F.col(f"_ct{i}_{j}")) ** 2 * (1 if i == j else 2) for i in range(n) for j in range(i, n)])
    return g.select(*keys, "steps", dist.alias("mean_sq"), tp.alias("trace_pred"), tt.alias("trace_true"),
                    F.sqrt(gap).alias("cov_gap"), (dist + tp + tt - 2 * root).alias("frechet_diag"))


def _cells(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _lower_root(m: Column, n: int) -> Column:
    """Rows of the lower triangle L with L L^T = m; a direction without spread gives a column of zeros."""
    largest = F.array_max(F.transform(_cells(n), lambda i: F.get(F.get(m, i), i)))

    def row(done: Column, i: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            mate = F.when(j == i, made).otherwise(F.get(done, j))
            left = F.get(F.get(m, i), j) - F.aggregate(
                F.zip_with(F.slice(made, 1, j), F.slice(mate, 1, j), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            pivot = F.get(F.get(done, j), j)
            value = F.when(j == i, F.when(left > largest * 1e-13, F.sqrt(left)).otherwise(0.0)).when(j > i, 0.0)
            return F.concat(made, F.array(value.otherwise(F.when(pivot > 0, left / pivot).otherwise(0.0))))

        return F.concat(done, F.array(F.aggregate(_cells(n), F.array().cast("array<double>"), cell)))

    return F.aggregate(_cells(n), F.array().cast("array<array<double>>"), row)


def _product(a: Column, b: Column, n: int) -> Column:
    """a b of two n x n matrices held as rows."""
    at = lambda row, j: F.aggregate(_cells(n), F.lit(0.0), lambda s, k: s + F.get(row, k) * F.get(F.get(b, k), j))
    return F.transform(a, lambda row: F.transform(_cells(n), lambda j: at(row, j)))


def _transposed(a: Column, n: int) -> Column:
    return F.transform(_cells(n), lambda j: F.transform(a, lambda row: F.get(row, j)))


def symmetric_eigenvalues(m: Column, n: int, sweeps: int = 12) -> Column:
    """Eigenvalues, in no order, of a symmetric n x n matrix held as rows: cyclic Jacobi rotations.

    A rotation whose off-diagonal cell is below 1e-15 of its diagonal pair is passed over, so settled matrices cost little.
    """
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(n) for q in range(p + 1, n)])

    def turned(row: Column, p: Column, q: Column, c: Column, s: Column) -> Column:
        return F.transform(row, lambda x, k: F.when(k == p, c * x - s * F.get(row, q)).when(k == q, s * F.get(row, p) + c * x).otherwise(x))

    def rotate(a: Column, pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        pp, qq, pq = (F.get(F.get(a, i), j) for i, j in ((p, p), (q, q), (p, q)))
        tau = (qq - pp) / (2.0 * pq)
        t = F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1.0 + tau * tau))
        tan = F.when(F.abs(pq) > 1e-15 * F.sqrt(F.abs(pp * qq)), t)

        def go(t: Column) -> Column:
            c = 1.0 / F.sqrt(1.0 + t * t)
            s = t * c
            side = F.transform(a, lambda row: turned(row, p, q, c, s))

            def rows(b: Column) -> Column:
                mix = lambda f, g: F.zip_with(F.get(b, p), F.get(b, q), lambda x, y: f * x + g * y)
                return F.transform(b, lambda row, k: F.when(k == p, mix(c, -s)).when(k == q, mix(s, c)).otherwise(row))

            return V.let(side, rows)

        return V.let(tan, lambda t: F.when(t.isNull(), a).otherwise(go(t)))

    done = F.aggregate(F.flatten(F.array_repeat(pairs, sweeps)), m, rotate)
    return V.let(done, lambda a: F.transform(_cells(n), lambda i: F.get(F.get(a, i), i)))


def frechet_distance(rows: DataFrame, keys: Sequence[str], predicted: Sequence[str], truth: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Squared Frechet distance between the normal fits of predicted and true actions of each group.

    |m1 - m2|^2 + tr(C1) + tr(C2) - 2 tr((C2^(1/2) C1 C2^(1/2))^(1/2)), with ``eps`` on both diagonals and as the least
    eigenvalue. The root's trace needs eigenvalues only, and with C2 = L L^T those of L^T C1 L are the same. Moments are one
    aggregate; each group's matrices are n x n. One row has no spread. Rows with a null in any column take no part.
    """
    n = len(predicted)
    whole = rows.dropna(subset=[*predicted, *truth])
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    aggs = [F.avg(c).alias(f"_m{k}{i}") for k, cs in (("p", predicted), ("t", truth)) for i, c in enumerate(cs)]
    spread = lambda a, b: F.coalesce(F.nanvl(F.covar_samp(a, b), F.lit(None).cast("double")), F.lit(0.0))
    aggs += [spread(cs[i], cs[j]).alias(f"_c{k}{i}_{j}") for k, cs in (("p", predicted), ("t", truth)) for i, j in pairs]
    g = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), *aggs)

    def matrix(k: str) -> Column:
        cell = lambda i, j: F.col(f"_c{k}{min(i, j)}_{max(i, j)}") + (eps if i == j else 0.0)
        return F.array(*[F.array(*[cell(i, j) for j in range(n)]) for i in range(n)])

    total = lambda cs: sum(cs[1:], cs[0])
    mean_sq = total([(F.col(f"_mp{i}") - F.col(f"_mt{i}")) ** 2 for i in range(n)])
    trace = total([F.col(f"_cp{i}_{i}") + F.col(f"_ct{i}_{i}") for i in range(n)]) + 2 * n * eps
    inner = V.let(F.struct(_lower_root(matrix("t"), n).alias("l"), matrix("p").alias("c")),
                  lambda x: _product(_transposed(x["l"], n), _product(x["c"], x["l"], n), n))
    root = F.aggregate(symmetric_eigenvalues(inner, n), F.lit(0.0), lambda s, x: s + F.sqrt(F.greatest(x, F.lit(float(eps)))))
    return g.select(*keys, "steps", F.greatest(mean_sq + trace - 2 * root, F.lit(0.0)).alias("frechet"))


def density_kl(samples: Column, target: Column) -> Column:
    """Reverse-KL estimate of one row holding its own sample vectors.

    The pairs exist only inside the row's array expression; no rows are paired.
    """
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    def log_mean_exp(xs):
        top = F.array_max(xs)
        return top + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top)) / F.size(xs))

    def one(a):
        near = F.transform(samples, lambda b: -0.5 * sq(a, b))
        return log_mean_exp(near) + 0.5 * sq(a, target)

    return F.aggregate(F.transform(samples, one), F.lit(0.0), lambda s, x: s + x) / F.size(samples)
