"""Named chains of DataFrame steps with inverses, and the registries that they are configured from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Apply = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """One DataFrame step; ``undo`` inverts it, and a step for training only is skipped elsewhere, both ways."""

    name: str
    apply: Apply
    undo: Apply | None = None
    training_only: bool = False


@dataclass(frozen=True)
class Chain:
    """Steps in order. ``then`` joins chains, ``apply`` runs one, ``undo`` runs the inverses from the last step to the first."""

    steps: tuple[Step, ...] = ()

    def __post_init__(self):
        names = [s.name for s in self.steps]
        if len(set(names)) != len(names):
            raise ValueError(f"step names repeat: {names}")

    def then(self, *more: Step | Chain) -> Chain:
        return Chain(self.steps + tuple(s for m in more for s in (m.steps if isinstance(m, Chain) else (m,))))

    def apply(self, df: DataFrame, training: bool = True) -> DataFrame:
        for s in self.steps:
            if training or not s.training_only:
                df = df.transform(s.apply)
        return df

    def undo(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            if s.training_only:
                continue
            if s.undo is None:
                raise ValueError(f"step {s.name} has no inverse")
            df = df.transform(s.undo)
        return df


@dataclass(frozen=True)
class Group:
    """What goes before a model and what goes behind it: a pair's inverse stands first behind the model."""

    inputs: Chain = field(default_factory=Chain)
    outputs: Chain = field(default_factory=Chain)

    def with_steps(self, inputs: Chain = Chain(), outputs: Chain = Chain()) -> Group:
        return Group(self.inputs.then(inputs), outputs.then(self.outputs))


def column_step(name: str, column: str, apply: Callable[[Column], Column], undo: Callable[[Column], Column] | None = None, training_only: bool = False) -> Step:
    """A step that rewrites one column by an expression."""
    make = lambda fn: lambda df: df.withColumn(column, fn(F.col(column)))
    return Step(name, make(apply), make(undo) if undo else None, training_only)


def mixture_ratios(mixtures: DataFrame) -> DataFrame:
    """A table (mixture, dataset, weight, embodiment) with each dataset's share of its mixture.

    A negative weight, a dataset named twice in a mixture, or a mixture that weighs nothing is an error.
    """
    inside = Window.partitionBy("mixture")
    twice = F.count(F.lit(1)).over(Window.partitionBy("mixture", "dataset")) > 1
    total = F.sum("weight").over(inside)
    wrong = (
        F.when(F.col("weight").isNull() | (F.col("weight") < 0), F.lit("negative or no weight"))
        .when(twice, F.lit("dataset named twice")).when(total <= 0, F.lit("mixture weighs nothing"))
    )
    told = F.raise_error(F.concat_ws(": ", wrong, "mixture", "dataset")).cast("double")
    return mixtures.select("mixture", "dataset", "embodiment", F.when(wrong.isNotNull(), told).otherwise(F.col("weight") / total).alias("ratio"))


def slot_sources(modality_config: DataFrame, width: int) -> DataFrame:
    """One row per embodiment of a table (embodiment, source_start, source_stop, slot_start): the source position of each
    slot, null where none. Spans that overlap or leave the width are an error."""
    c = modality_config.select(
        "embodiment", F.explode(F.sequence(F.lit(0), F.col("source_stop") - F.col("source_start") - 1)).alias("k"), "source_start", "slot_start")
    pairs = c.select("embodiment", (F.col("slot_start") + F.col("k")).alias("slot"), (F.col("source_start") + F.col("k")).alias("source"))
    g = pairs.groupBy("embodiment").agg(F.map_from_entries(F.collect_list(F.struct("slot", "source"))).alias("m"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.try_element_at("m", s.cast("long")))
    wrong = (F.col("lo") < 0) | (F.col("hi") >= width)
    return g.select("embodiment", F.when(wrong, F.raise_error(F.lit("slots leave the width")).cast("array<bigint>")).otherwise(slots).alias("sources"))


def place_by_registry(frames: DataFrame, modality_config: DataFrame, column: str, embodiment: str, width: int, name: str) -> DataFrame:
    """Each body's vector in slot order by the registry; slots without a source are zero, an unknown body is an error.

    The joined side has one row per embodiment; Catalyst decides how to join it.
    """
    at = slot_sources(modality_config, width).withColumnRenamed("embodiment", "_e")
    joined = frames.join(at, F.col(embodiment) == F.col("_e"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown embodiment "), F.col(embodiment).cast("string"))).cast("array<double>")
    placed = F.transform("sources", lambda i: F.coalesce(F.get(F.col(column), i.cast("int")), F.lit(0.0)))
    return joined.withColumn(name, F.when(F.col("_e").isNull(), unknown).otherwise(placed)).drop("_e", "sources")
