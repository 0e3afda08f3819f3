"""Instruction text, catalogue hashes and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_instruction(text: Column) -> Column:
    """Drop a leading ``role: `` part, lower case, ``_`` and ``-`` to blanks, runs of blanks to one."""
    tail = F.element_at(F.split(text, ": "), -1)
    return F.regexp_replace(F.translate(F.lower(F.trim(tail)), "_-", "  "), r"\s+", " ")


def pick_description(forward: Column, reverse: Column, is_reverse: Column) -> Column:
    return F.when(is_reverse & reverse.isNotNull(), reverse).otherwise(forward)


def folder_description(name: Column) -> Column:
    """``Pick_up_cup_12`` -> ``pick up cup``."""
    return F.regexp_replace(F.translate(F.lower(name), "_", " "), r"\s+\d+$", "")


def timestamp_hash(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH-mm-ss-SSSSSS")


def hash_millis(h: Column) -> Column:
    """UTC milliseconds of ``YYYY-MM-DD-HH-MM-SS-ffffff``, whatever the session zone."""
    ts = F.to_timestamp_ntz(h, F.lit("yyyy-MM-dd-HH-mm-ss-SSSSSS"))
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
