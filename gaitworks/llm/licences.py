"""Licence notices in instructions and file texts: a positional index of rare licence words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import text_rows

# ASCII letters in lower case, digits and everything beyond ASCII are word characters; the rest separates words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# phrase: label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label: (notice, phrases that must stand in it)
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use", "source and binary forms")),
    "cc-by-4.0": ("Licensed under CC BY 4.0", ("cc by 4 0",)),
    "cc-by-4.0-long": ("licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    "gpl-2.0": ("licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    "lgpl-3.0": ("licensed under the GNU Lesser General Public License, version 3", ("lesser general public license version 3",)),
    "mit": ("Released under the MIT License", ("mit license",)),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def places(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase, from the positions of its last word."""
    n = len(phrase)
    return [p - n + 1 for p in at.get(phrase[-1], ()) if p >= n - 1 and words[p - n + 1:p + 1] == phrase]


class TemplateIndex:
    """Postings (template, place in the notice) of each template's rarest words."""

    def __init__(self, document_frequency: dict[bytes, int], n: int, templates=TEMPLATES, base=BASE, rare: int = 5):
        self.idf = lambda w: math.log((n + 1) / (document_frequency.get(w, 0) + 1))
        self.base = {label: [p.encode() for p in phrase.split()] for phrase, label in base.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.notices, self.keys, self.rare = {}, {}, {}
        for label, (notice, keys) in templates.items():
            words = words_of(notice)
            self.notices[label] = words
            self.keys[label] = [words_of(k) for k in keys]
            best = sorted(set(words), key=lambda w: (-self.idf(w), w))[:rare]
            self.rare[label] = len(best)
            for k, w in enumerate(words):
                if w in best:
                    self.postings[w].append((label, k))
        self.wanted = frozenset(self.postings) | {p[-1] for p in self.base.values()} | {k[-1] for ks in self.keys.values() for k in ks}

    def scan(self, text: str | None):
        words = words_of(text)
        if self.wanted.isdisjoint(words):
            return len(words), [], [], [], 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.wanted:
                at[w].append(p)
        base = {label: places(words, at, phrase) for label, phrase in self.base.items()}
        starts = sorted(p for found in base.values() for p in found)
        labels = {label for label, found in base.items() if found}
        score, method = 0.8 if starts else 0.0, set()
        votes: Counter = Counter()
        for w in self.postings.keys() & at.keys():
            votes.update({(label, p - k) for p in at[w] for label, k in self.postings[w]})
        for (label, start), v in sorted(votes.items()):
            if v < max(1, math.ceil(0.6 * self.rare[label])):
                continue
            lo, hi = start - 1, start + len(self.notices[label]) + 1
            if all(any(lo <= p and p + len(k) <= hi for p in places(words, at, k)) for k in self.keys[label]):
                method.add(label.removesuffix("-long").removesuffix("-grant"))
                score = max(score, min(1.0, v / self.rare[label]))
        return len(words), starts, sorted(labels), sorted(labels | method), score


def scan_licences(files: DataFrame, rare: int = 5) -> DataFrame:
    """Licence notices in whole texts of ``files`` (episode_index, instruction).

    One pass counts in how many texts each notice word occurs. Each template's ``rare`` words of highest IDF are posted
    with their places. The second pass looks up a text's words in the postings; an occurrence votes for a template at a
    start, and a start at which three fifths of the rare words agree is accepted if the template's key phrases stand
    there. Fixed phrases are found at every place, whatever the postings say. The postings are as large as the list of
    templates.

    Returns one row per text: episode_index, n_words, n_base (places of fixed phrases), first_word, last_word (smallest
    and largest start), base_labels, labels (fixed and template labels; distinct, sorted, comma-joined), score (0: no
    sign; 0.8: a fixed phrase; else the share of rare words in place). Null text counts as empty. Repeated rows and null
    indexes are scanned as any others; no rows, no result. Further columns are ignored.
    """
    texts = text_rows(files, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    vocabulary = frozenset(w for notice, _ in TEMPLATES.values() for w in words_of(notice))

    def frequencies(tables):
        n, df = 0, Counter()
        for t in tables:
            for text in t.column(0):
                n += 1
                df.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": [b"", *df], "n": [n, *df.values()]}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counted = texts.select("instruction").mapInArrow(frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in counted}  # a row per notice word, and one for the number of texts
    index_of = (df, df.pop(b"", 0))
    schema = pa.schema([
        ("episode_index", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scan(tables):
        index = TemplateIndex(*index_of, rare=rare)
        for t in tables:
            rows = []
            for episode, text in zip(t.column(0).to_pylist(), t.column(1)):
                n, starts, base, labels, score = index.scan(text.as_py())
                rows.append((episode, n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(labels), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(scan, "episode_index long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
