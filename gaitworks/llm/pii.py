"""Personal data in instructions: exact patterns, and what bootstrapped contexts find beside them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import stored, text_rows

KINDS = ("email", "ip", "card", "phone")
# possessive runs and look-behinds only keep the scan linear; the matches are those of the plain patterns
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,64}")
_WORD = re.compile(r"[^\s]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def plausible(value: str) -> list[int]:
    """Kinds that an identifier outside the exact patterns may be of, from its shape alone."""
    if "@" in value:
        return [0]
    n, parts = len(_digits(value)), re.split(r"\.", value)
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts):
        return [1]
    return [2] * (13 <= n <= 19) + [3] * (7 <= n <= 15)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a slot: the two words before it, and one word on either side. Digits count as #."""
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 60):start])[-2:]]
    right = [w.lower() for w in _WORD.findall(text[end:end + 30])[:1]]
    found = []
    if len(left) == 2:
        found.append("L " + " ".join(left))
    if left and right:
        found.append(f"M {left[-1]} _ {right[0]}")
    return [re.sub(r"[0-9]", "#", x) for x in found]


def slots(text: str, base: list[tuple[int, int, int]]):
    """(value, kind number of an exact match or None, start, end) of identifier-shaped slots, without overlaps."""
    taken = sorted((s, e, k) for k, s, e in base)
    for s, e, k in taken:
        yield text[s:e].lower() if k == 0 else _digits(text[s:e]) if k != 1 else text[s:e], k, s, e
    spare = [(m.start(), m.end()) for p in (_HANDLE, _NUMBER) for m in p.finditer(text)] if _DIGIT.search(text) or "@" in text else []
    last, j, top = 0, 0, 0
    for s, e in sorted(spare):
        while j < len(taken) and taken[j][0] < e:
            top = max(top, taken[j][1])
            j += 1
        if s < last or top > s:
            continue
        last = e
        yield text[s:e].lower() if "@" in text[s:e] else text[s:e] if len(plausible(text[s:e])) == 1 and 1 in plausible(text[s:e]) else _digits(text[s:e]), None, s, e


def find_pii(episodes: DataFrame, rounds: int = 3, support: float = 3.0, confidence: float = 0.5, salts: int = 16) -> DataFrame:
    """Personal data in whole instructions (episode_index, instruction).

    Exact matches of the four patterns are the seeds. Their surroundings give lexical patterns. Over the graph of
    patterns and the identifiers seen in them, each of ``rounds`` rounds scores a pattern for a kind by the known
    identifiers of that kind it holds: against those of other kinds in full, against unknown ones by a quarter. Patterns
    with ``support`` known identifiers and ``confidence`` score the unknown identifiers of fitting shape; those that
    reach ``confidence`` are known in the next round, and all their occurrences become spans. Exact matches always stay,
    and other spellings of them (the same digits) become spans wherever they stand.

    Returns one row per episode: episode_index, n_email, n_ip, n_card, n_phone (exact matches), base_spans and spans
    (``kind:start:end`` by kind and start, comma-joined; code points, end exclusive). ``spans`` holds all of them.

    Texts are scanned once; what is stored has a row per episode with its few slots. Sums over patterns and identifiers
    combine map-side; accepted patterns and found identifiers are copied to ``salts`` salts for their joins, so that a
    pattern or identifier of very many rows is split. Null counts as empty text. Repeated rows are scanned each; no
    rows give no rows. Further columns are ignored.
    """
    span = pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])
    slot = pa.struct([("value", pa.string()), ("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("contexts", pa.list_(pa.string())), ("may", pa.list_(pa.int32()))])
    schema = pa.schema([("episode_index", pa.int64()), ("base", pa.list_(span)), ("slots", pa.list_(slot))])

    def scan(tables):
        for t in tables:
            rows = []
            for episode, text in zip(t.column(0).to_pylist(), t.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                rows.append({"episode_index": episode, "base": [dict(zip("kse", b)) for b in base], "slots": [
                    {"value": v, "k": k, "s": s, "e": e, "contexts": contexts(text, s, e), "may": plausible(text[s:e]) if k is None else []}
                    for v, k, s, e in slots(text, base)]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    found = texts.mapInArrow(scan, "episode_index long, base array<struct<k:int,s:long,e:long>>, "
                                   "slots array<struct<value:string,k:int,s:long,e:long,contexts:array<string>,may:array<int>>>")
    found = stored(found.withColumn("row_no", F.monotonically_increasing_id()), "pii-scan")
    added = _discovered(found, rounds, support, confidence, salts)
    return _joined_spans(found, added)


def _discovered(found: DataFrame, rounds: int, support: float, confidence: float, salts: int) -> DataFrame:
    """(row_no, more: spans) that the contexts add."""
    seen = found.select("row_no", F.explode("slots").alias("x")).select("row_no", "x.*")
    edges = stored(seen.select("value", "k", "may", F.explode("contexts").alias("pattern")).distinct(), "pii-edges")
    seeds = edges.where("k is not null").select("value", "k").distinct().withColumn("score", F.lit(1.0))
    size = edges.groupBy("pattern").agg(F.countDistinct("value").alias("size"))
    pairs = edges.select("pattern", "value").distinct()
    open_edges = edges.where("k is null").select("pattern", "value", F.explode("may").alias("k")).distinct()
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = seeds
    more = None
    for _ in range(rounds):
        held = pairs.join(known, "value").groupBy("pattern", "k").agg(F.sum("score").alias("pos"))
        rest = held.groupBy("pattern").agg(F.sum("pos").alias("all_pos"))
        open_n = F.greatest(F.col("size") - F.col("all_pos"), F.lit(0.0))
        conf = F.col("pos") / (F.col("all_pos") + F.lit(0.25) * open_n)
        good = held.where(F.col("pos") >= support).join(rest, "pattern").join(size, "pattern").select("pattern", "k", conf.alias("conf")).where(F.col("conf") >= confidence)
        reached = open_edges.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")).join(good.select("*", copies), ["pattern", "k", "salt"])
        miss = F.exp(F.sum(F.log(F.lit(1.000001) - F.col("conf"))))
        more = stored(reached.groupBy("value", "k").agg((1 - miss).alias("score")).where(F.col("score") >= confidence), "pii-found")
        # an identifier that is known from an exact match stays with its kind
        more = more.join(seeds.select("value"), "value", "left_anti")
        known = seeds.unionByName(more)
    # exact matches are known too, best of all; of them only those that an open slot repeats are copied
    open_values = seen.where("k is null").select("value").distinct()
    exact = seen.where("k is not null").select("value", "k").distinct().join(open_values, "value", "left_semi")
    best = more.unionByName(exact.withColumn("score", F.lit(1.0))).groupBy("value").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k")).select("*", copies)
    hits = seen.where("k is null").drop("k").withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(salts)).cast("int")).join(best, ["value", "salt"])
    return hits.groupBy("row_no").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), line), ",")


def _joined_spans(found: DataFrame, added: DataFrame) -> DataFrame:
    rows = found.select("row_no", "episode_index", "base").join(added, "row_no", "left")
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:long,e:long>>")))
    return rows.select("episode_index", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], _written(F.col("base")).alias("base_spans"), _written(every).alias("spans"))
