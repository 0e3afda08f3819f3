"""Token files: ids in fixed-size blocks, cut into byte or bit planes, each plane compressed with zstandard."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import text_rows
from gaitworks.llm.tokens import batches, encoder

MAGIC = b"GWPLANE1"
ENCODER = {"limit": 250_000, "segment": 4 << 20}  # a worker's memory beside open files and planes
_TAIL = struct.Struct("<QQ8s")  # length of the chunk index, length of the episode table, magic


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (lowest byte first) of a block of unsigned 32-bit ids, or its 32 bit planes."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [cells[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        cells = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        cells = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)


class Writer:
    """Streams ids into one file; holds one block and the table of episodes."""

    def __init__(self, out, block: int, bits: bool, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.chunks: list[list[int]] = []  # per chunk: first byte, ids, bytes of each plane
        self.episodes: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, episode: int | None, ids: np.ndarray) -> None:
        self.episodes.append((episode, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            take = min(self.block - self.n_held, len(ids))
            self.held.append(ids[:take])
            self.n_held += take
            ids = ids[take:]
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        if not self.n_held:
            return
        planes = [self.zip.compress(p) for p in to_planes(np.concatenate(self.held), self.bits)]
        self.chunks.append([self.at, self.n_held, *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        width = 2 + (32 if self.bits else 4)
        index = np.array(self.chunks, "<u8").reshape(-1, width)
        head = struct.pack("<QQ", *index.shape) + index.tobytes()
        table = pa.table({"episode": pa.array([e for e, _ in self.episodes], pa.int64()), "n": pa.array([n for _, n in self.episodes], pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        head, rows = self.zip.compress(head), self.zip.compress(sink.getvalue())
        self.out.write(head + rows + _TAIL.pack(len(head), len(rows), MAGIC))


def read_file(f):
    """(episode, offset in the file, ids) in file order; at most one chunk and one episode are in memory."""
    size = f.size()
    f.seek(size - _TAIL.size)
    n_head, n_rows, magic = _TAIL.unpack(f.read(_TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    f.seek(size - _TAIL.size - n_head - n_rows)
    unzip = zstandard.ZstdDecompressor()
    head = unzip.decompress(f.read(n_head))
    index = np.frombuffer(head, "<u8", offset=16).reshape(struct.unpack_from("<QQ", head))
    table = pa.ipc.open_stream(io.BytesIO(unzip.decompress(f.read(n_rows)))).read_all()

    def chunks():
        for at, n, *lengths in index.tolist():
            f.seek(at)
            yield from_planes([unzip.decompress(f.read(k)) for k in lengths], n)

    more, left, start = chunks(), np.empty(0, "<u4"), 0
    for episode, n in zip(table["episode"].to_pylist(), table["n"].to_pylist()):
        parts, need = [], n
        while need:
            if not len(left):
                left = next(more)
            parts.append(left[:need])
            left = left[len(parts[-1]):]
            need -= len(parts[-1])
        yield episode, start, np.concatenate(parts) if parts else left[:0]
        start += n


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def write_token_files(episodes: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 65_536, planes: str = "byte") -> DataFrame:
    """Write the instructions of ``episodes`` (episode_index, instruction) as token files under ``path``.

    Rows are range-partitioned by episode_index and each task streams one file: blocks of ``block`` ids are cut into
    4 byte planes (``planes="bit"``: 32 bit planes), each plane is compressed with zstandard, and the chunk index and the
    episode table close the file. Every episode's ids end with ``end_id``. Files go through pyarrow's file systems, so
    ``path`` may be on any store that all executors share. A task's attempt writes under a name of its own; the file
    index under ``path/index`` lists the files of the attempts that counted, so a lost executor leaves at most an
    unlisted file. Returns that index: file, first_episode, n_episodes, n_ids.

    Null instructions count as empty (one id, the end). Episodes with null index come first. Repeated indexes are
    separate rows in order of their text. No rows: an empty index. Further columns are ignored.
    """
    spark = episodes.sparkSession
    bits = {"byte": False, "bit": True}[planes]
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    schema = pa.schema([("file", pa.string()), ("first_episode", pa.int64()), ("n_episodes", pa.int64()), ("n_ids", pa.int64())])

    def write(tables):
        out = name = writer = None
        enc = encoder(tokenizer, **ENCODER)
        end = np.array([end_id], "<u4")
        for t in tables:
            ids, border = enc.column(t.column(1))
            for k, episode in enumerate(t.column(0).to_pylist()):
                if writer is None:
                    system, base = filesystem(path)
                    name = f"{base}/tokens-{uuid.uuid4().hex}.planes"
                    out = system.open_output_stream(name)
                    writer = Writer(out, block, bits)
                writer.add(episode, np.concatenate([ids[border[k]:border[k + 1]].astype("<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "file": name, "first_episode": writer.episodes[0][0], "n_episodes": len(writer.episodes), "n_ids": writer.n_ids}], schema)

    rows = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    rows = rows.repartitionByRange("episode_index").sortWithinPartitions("episode_index", "instruction")
    rows.mapInArrow(write, "file string, first_episode long, n_episodes long, n_ids long").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of token files: episode_index, start (ids of all episodes before), n_tokens, input_ids.

    ``input_ids`` holds little-endian unsigned 32-bit ids. The running offset of the files is a window over the file
    index, which has one row per written partition.
    """
    def read(tables):
        schema = pa.schema([("episode_index", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("input_ids", pa.binary())])
        for t in tables:
            for name, base in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                with filesystem(path)[0].open_input_file(name) as f:
                    yield from batches((((e, base + s, len(ids), ids.tobytes()), 4 * len(ids)) for e, s, ids in read_file(f)), schema)

    index = spark.read.parquet(f"{path}/index")
    before = Window.orderBy(F.col("first_episode").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = index.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    # a task per file: the rows are small and would be coalesced, the files are not
    return files.repartition(max(1, index.count()), "file").mapInArrow(read, "episode_index long, start long, n_tokens long, input_ids binary")
