"""Captures as the recorder leaves them: one indented JSON document per episode, of any length."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES, FILE_BYTES = 128 << 20, 4 << 20  # what a task reads, and what opening a file counts for
SPACE = " \t\r\n"


class Values:
    """JSON values one after another from a stream; what is held is one value and what was read with it."""

    def __init__(self, stream: TextIO, step: int = 1 << 16):
        self.stream, self.step, self.text, self.at, self.ended = stream, step, "", 0, False
        self.decoder = json.JSONDecoder()

    def _more(self) -> bool:
        # a value that does not fit doubles what is read next, so it is parsed a logarithmic number of times
        piece = self.stream.read(max(self.step, len(self.text) - self.at))
        self.ended = not piece
        self.text, self.at = self.text[self.at :] + piece, 0
        return bool(piece)

    def peek(self) -> str:
        """The next character that is not blank; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                return ""

    def take(self, *wanted: str) -> str:
        c = self.peek()
        if c not in wanted or not c:
            raise ValueError(f"expected one of {wanted}, found {c!r}")
        self.at += 1
        return c

    def value(self) -> object:
        self.peek()
        while True:
            try:
                got, end = self.decoder.raw_decode(self.text, self.at)
                # a number may go on behind the buffer, or look whole before its point
                if self.ended or (end < len(self.text) and self.text[end] in SPACE + ",]}:"):
                    self.at = end
                    return got
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._more()

    def items(self) -> Iterator[object]:
        """Items of the array that starts here."""
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",", "]") == "]":
                return


def frames_of(stream: TextIO, field: str = "data", step: int = 1 << 16) -> Iterator[object]:
    """Frames of a document: the document's items if it is an array, else those of its array ``field``.

    A document without the field, or with null in its place, has no frames; one that breaks off raises.
    """
    values = Values(stream, step)
    if values.peek() == "[":
        yield from values.items()
        return
    values.take("{")
    if values.peek() == "}":
        return
    while True:
        name = values.value()
        values.take(":")
        if name == field and values.peek() == "[":
            yield from values.items()
        else:
            values.value()
        if values.take(",", "}") == "}":
            return


@dataclass
class Files(InputPartition):
    paths: list[str]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.field, self.suffix = options["path"], options.get("field", "data"), options.get("suffix", ".json")
        self.room = int(options.get("task_bytes", TASK_BYTES))

    def _filesystem(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        """Files in order of path, packed by size; a file is never cut."""
        from pyarrow import fs

        system, root = self._filesystem()
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(self.suffix)]
        tasks, room = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not tasks or room < f.size + FILE_BYTES:
                tasks.append(Files([]))
                room = self.room
            tasks[-1].paths.append(f.path)
            room -= f.size + FILE_BYTES
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        import io

        system, _ = self._filesystem()
        for path in partition.paths:
            with io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8") as stream:
                held = None
                for i, frame in enumerate(frames_of(stream, self.field)):
                    if held is not None:
                        yield path, i - 1, False, held
                    held, last = json.dumps(frame), i
                if held is not None:
                    yield path, last, True, held


class CaptureSource(DataSource):
    """``capture``: path, frame_index, done and the frame as JSON text, read item by item.

    Options: ``path`` (a folder, searched in depth), ``field`` (the array's name), ``suffix`` of the files, ``task_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return "path string, frame_index bigint, done boolean, frame string"

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def scan_captures(spark: SparkSession, path: str, frame_schema: str, fps: float, episode: Column | None = None, **options: str) -> DataFrame:
    """Frame rows of every capture under ``path``: episode_index, frame_index, timestamp, done and the frame's fields.

    ``episode`` finds the episode's number in the column ``path``; by default it is what stands behind ``episode_`` there,
    null without one. A field that a frame lacks, or whose type differs, is null; an empty capture gives no rows.
    """
    spark.dataSource.register(CaptureSource)
    number = F.nullif(F.regexp_extract("path", r".*episode[_=](\d+)", 1), F.lit("")).cast("bigint")
    t = spark.read.format("capture").options(**options).load(path)
    t = t.withColumn("frame", F.from_json("frame", frame_schema))
    return t.select((number if episode is None else episode).alias("episode_index"), "frame_index",
                    (F.col("frame_index") / F.lit(float(fps))).alias("timestamp"), "done", "frame.*")
