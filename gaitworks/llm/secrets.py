"""Secrets in instructions: exact patterns, and bare credentials told from examples by who holds them. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import stored

KINDS = ("assign", "access", "hex", "value")
BASE = 3  # kinds before this one are the exact patterns
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# runs that are too short hold no match, and what a run lacks no part of it has: the least length can stand in the pattern
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "[0-9a-f]{32,}+"
VALUE = "[A-Za-z0-9+/_=-]{16,}+"
SHOWN = "(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test|fake|123456|abcdef"


def pieces(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern in order: kind, number, code points from the end of the match before to the end of this one, match."""
    walk = f"\\G([\\s\\S]*?)({pattern})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(walk), F.lit(0)).alias("upto"), F.regexp_extract_all(text, F.lit(walk), F.lit(2)).alias("match"))
    cut = F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.length(x["upto"]).cast("long").alias("step"), x["match"].alias("match")))
    return F.when(F.rlike(text, F.lit(pattern)), cut)


def entropy(value: Column) -> Column:
    """Bits a character."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "(?<=[\\s\\S])(?=[\\s\\S])")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def looks_live(value: Column, least_bits: float) -> Column:
    """Letters and digits in no pattern of words: drawn, not written."""
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & ~F.rlike(value, F.lit(SHOWN)) & (F.round(entropy(value), 6) >= least_bits)


def find_secrets(episodes: DataFrame, most_owners: int = 1, many_owners: int = 3, least_bits: float = 3.0, salts: int = 16) -> DataFrame:
    """Secrets in whole instructions of ``episodes`` (episode_index, instruction, source_dataset, lab).

    Exact patterns give the base spans: assignments to secret names, access keys and long hexadecimal strings. Every
    other unbroken run of 16 characters or more that could be a credential is a candidate. Over the whole corpus each
    value, known by its SHA-256, is counted by distinct datasets and by the labs that own them. A value that at most
    ``most_owners`` labs hold is somebody's own; one that ``many_owners`` or more hold is an example that is copied
    around. A candidate beside the base spans becomes a span of kind ``value`` when it is somebody's own and either
    looks live (letters, digits, no example words, ``least_bits`` bits a character) or is a value that an exact pattern
    names elsewhere. Base spans always stay.

    Returns one row per episode: episode_index, n_assign, n_access, n_hex, base_spans, spans (``kind:start:end`` by
    start, then kind; code points, end exclusive), n_live (spans that look live and are somebody's own), n_copied (spans
    of widely copied values).

    Texts are scanned once, by built-in functions; what is stored has a row per episode with its few matches. Counts go
    through distinct (value, lab, dataset) rows, folded map-side, so that a value which a third of the rows hold is a
    few rows before any group. Counts are copied to ``salts`` salts to meet the candidates, so such a value is spread.

    Null text counts as empty; null dataset and lab are a dataset and a lab of their own. A null or repeated index is
    kept: rows are scanned each. Very long texts are scanned whole; their matches are numbered by a window over the
    matches of one text. No rows: no rows. Further columns are ignored.
    """
    text = F.coalesce(F.col("instruction"), F.lit(""))
    read = episodes.select(
        F.col("episode_index").cast("long").alias("episode_index"), F.col("source_dataset").cast("string").alias("source_dataset"),
        F.col("lab").cast("string").alias("lab"),
        F.array_compact(F.array(*[pieces(text, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, VALUE))])).alias("found"))
    read = stored(read.withColumn("row_no", F.monotonically_increasing_id()), "secret-matches")

    slot = read.where(F.size("found") > 0).select("row_no", "source_dataset", "lab", F.explode(F.flatten("found")).alias("m"))
    slot = slot.select("row_no", "source_dataset", "lab", "m.*")
    slot = slot.withColumn("end", F.sum("step").over(Window.partitionBy("row_no", "kind").orderBy("no")))
    slot = slot.withColumn("start", F.col("end") - F.length("match"))
    slot = slot.withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 1)).otherwise(F.col("match")))
    slot = slot.where((F.col("kind") != 0) | (F.length("value") >= 8))
    # candidates that touch a base span are part of it
    near = Window.partitionBy("row_no").orderBy("start")
    is_base = F.col("kind") < BASE
    slot = slot.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(near.rangeBetween(Window.unboundedPreceding, 0)))
    slot = slot.withColumn("next", F.min(F.when(is_base, F.col("start"))).over(near.rangeBetween(0, Window.unboundedFollowing)))
    free = (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    slot = slot.where(is_base | (free & F.rlike("value", F.lit("[0-9]")))).withColumn("key", F.unhex(F.sha2("value", 256)))
    slot = stored(slot.select("row_no", "source_dataset", "lab", "kind", "start", "end", "value", "key"), "secret-slots")

    held = slot.groupBy("key", "lab", "source_dataset").agg(F.max(is_base).alias("named"))
    labs = held.groupBy("key", "lab").agg(F.count(F.lit(1)).alias("datasets"), F.max("named").alias("named"))
    keys = labs.groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.sum("datasets").alias("datasets"), F.max("named").alias("named"))
    keys = keys.select(F.col("key").alias("k"), "owners", "datasets", "named", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    met = slot.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(salts)).cast("int"))
    met = met.join(keys, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")))
    met = met.withColumn("own", F.col("owners") <= most_owners).withColumn("live", F.col("own") & looks_live(F.col("value"), least_bits))
    met = met.where(is_base | F.col("live") | (F.col("own") & F.col("named")))

    label = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    item = F.struct("start", "kind", F.concat_ws(":", label, F.col("start"), F.col("end")).alias("span"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["span"]), ",")
    count = lambda c: F.count(F.when(c, F.lit(1)))
    by_row = met.groupBy("row_no").agg(
        *[count(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        joined(F.when(is_base, item)).alias("base_spans"), joined(item).alias("spans"),
        count(F.col("live")).alias("n_live"), count(F.col("owners") >= many_owners).alias("n_copied"))
    out = read.select("row_no", "episode_index").join(by_row, "row_no", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "episode_index", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))
