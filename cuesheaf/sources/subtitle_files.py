"""Subtitle and transcript files as a Spark data source, `spark.read.format("subtitles")`.

A folder holds one file a media, named by its percent-encoded media_id. Option `kind` is srt, txt or json. Reading plans partitions of whole files by
their bytes and parses a file as a stream of lines. Writing streams the rows of a media, in order, into one file below a staging
folder; only the commit moves the files of successful tasks to their place, and an abort deletes the staging folder. Paths may be of any
file system that Arrow opens by its address, or plain paths.

The driver reads folders as streams and keeps a packed name of each file to read and a key of 16 bytes of each file written. Arrow lists a folder
that is not local at once, with some 400 bytes a file.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .transcripts import HEADERS, WEAK_MARK

READ = {
    "srt": "media_id string, at long, index int, timestamp string, text string",
    "txt": "media_id string, number long, start string, end string, text string",
    "json": "media_id string, seq long, start_ms long, end_ms long, text string, confidence double",
}
WRITE = {
    "srt": ("timestamp", "text"),
    "txt": ("start_ms", "end_ms", "text", "is_weak", "original", "filtered", "deduplicated"),
    "json": ("seq", "start_ms", "end_ms", "text", "confidence"),
}
#: Columns that put the rows of a media in order.
ORDER = {"srt": ("at",), "txt": ("start_ms", "seq"), "json": ("start_ms", "seq")}
PARTITION_BYTES, ROWS_AT_ONCE = 32 * 1024 * 1024, 5000
_APART = "the rows of a media are in several tasks or out of order: write with write_subtitles"
_TIMED = re.compile(r"\[([^\]]*?) - ([^\]]*)\](.*)\Z", re.S)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(system: fs.FileSystem, folder: str, kind: str) -> Iterator[tuple[str, int]]:
    """Name and size of each file of a kind in a folder, in any order; a missing folder has none."""
    if isinstance(system, fs.LocalFileSystem):
        if os.path.isdir(folder):
            with os.scandir(folder) as found:
                yield from ((f.name, f.stat().st_size) for f in found if f.name.endswith(f".{kind}") and f.is_file())
        return
    for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.type == fs.FileType.File and f.path.endswith(f".{kind}"):
            yield f.path.rsplit("/", 1)[1], f.size


def clock(ms: int) -> str:
    s = ms // 1000
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def subtitle_clock(text: str) -> str:
    """A clock with a comma stays; a fraction after a point is cut and padded to three digits; else none."""
    if "," in text:
        return text
    whole, *fraction = text.split(".")
    return f"{whole},{fraction[0][:3].ljust(3, '0') if fraction else '000'}"


def srt_rows(lines: Callable[[], Iterable[str]]) -> Iterator[tuple]:
    """(at, index, timestamp, text) of the well-formed blocks between blank lines."""
    at, block = 0, []

    def row() -> list[tuple]:
        index = block[0].strip() if len(block) >= 3 else ""  # not int(): it takes 1_0 and other digits
        if not re.fullmatch(r"[+-]?[0-9]+", index) or not -(2**31) <= int(index) < 2**31:
            return []
        return [(at, int(index), block[1].strip(), "\n".join(block[2:]).strip())]

    for line in lines():
        if line.strip():
            block.append(line if block else line.lstrip())
        elif block:
            yield from row()
            at, block = at + 1, []
    if block:
        block[-1] = block[-1].rstrip()
        yield from row()


def txt_rows(lines: Callable[[], Iterable[str]]) -> Iterator[tuple]:
    """(number, start, end, text) of timed lines; of a file without any, its lines a second each."""
    number = 0
    for line in map(str.strip, lines()):
        if line.startswith(HEADERS) or not (m := _TIMED.match(line)):
            continue
        text = m[3].strip()
        if text.startswith(WEAK_MARK):
            text = text[len(WEAK_MARK) :].strip()
        if text:
            number += 1
            yield number, subtitle_clock(m[1].strip()), subtitle_clock(m[2].strip()), text
    if not number:
        for i, line in enumerate(map(str.strip, lines())):
            if line and not line.startswith(HEADERS[:6]):
                yield i + 1, f"{clock(i * 1000)},000", f"{clock((i + 1) * 1000)},000", line


def json_rows(lines: Callable[[], Iterable[str]]) -> Iterator[tuple]:
    """The segments of a document; a broken one has none."""
    try:
        segments = json.loads("\n".join(lines()))["segments"]
    except (ValueError, KeyError, TypeError):
        return
    for s in segments:
        yield s.get("seq"), s.get("start_ms"), s.get("end_ms"), s.get("text"), s.get("confidence")


ROWS = {"srt": srt_rows, "txt": txt_rows, "json": json_rows}


class Files(InputPartition):
    """Names of files, packed."""

    def __init__(self, names: list[str]):
        super().__init__(zlib.compress("/".join(names).encode("utf-8", "surrogateescape")))

    def names(self) -> list[str]:
        return [x for x in zlib.decompress(self.value).decode("utf-8", "surrogateescape").split("/") if x]


class SubtitleReader(DataSourceReader):
    def __init__(self, path: str, kind: str, partition_bytes: int, schema: pa.Schema):
        self.path, self.kind, self.partition_bytes, self.schema = path, kind, partition_bytes, schema

    def partitions(self) -> list[Files]:
        out, names, size = [], [], 0
        for name, n in listed(*opened(self.path), self.kind):
            if names and size + n > self.partition_bytes:
                out.append(Files(names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, Files(names)] if names else [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        rows: list[tuple] = []
        for name in partition.names():
            media = unquote(name[: -len(self.kind) - 1])

            def lines(name: str = name) -> Iterator[str]:
                with io.TextIOWrapper(system.open_input_stream(f"{root}/{name}"), "utf-8", newline="\n") as f:
                    for line in f:
                        yield line.removesuffix("\n")

            for row in ROWS[self.kind](lines):
                rows.append((media, *row))
                if len(rows) >= ROWS_AT_ONCE:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class _Sink:
    """One open file; `add` takes the rows of its media in order."""

    def __init__(self, system: fs.FileSystem, path: str, kind: str):
        self.kind, self.n, self.texts, self.last = kind, 0, [], None
        self.out = io.TextIOWrapper(system.open_output_stream(path), "utf-8", newline="\n", write_through=True)

    def add(self, row: dict) -> None:
        self.n += 1
        if self.kind == "srt":
            lines = [x for x in (str(self.n), row["timestamp"], row["text"]) if x is not None]
            self.out.write(("\n" if self.n > 1 else "") + "\n".join([*lines, ""]))
        elif self.kind == "txt":
            if self.n == 1:
                counts = zip(HEADERS[6:9], (row["original"], row["filtered"], row["deduplicated"]), strict=True)
                self.out.write("".join(f"{name} {n}\n" for name, n in counts) + "=" * 50)
            weak = f"{WEAK_MARK} " if row["is_weak"] else ""
            self.out.write(f"\n[{clock(abs(row['start_ms']))} - {clock(abs(row['end_ms']))}] {weak}{row['text']}")
        else:
            self.texts.append(row["text"] or "")
            self.last = row["end_ms"]
            self.out.write((', ' if self.n > 1 else '{"segments": [') + json.dumps({k: row[k] for k in WRITE["json"]}, ensure_ascii=False))

    def close(self) -> None:
        if self.kind == "json":
            self.out.write(f'], "text": {json.dumps(" ".join(self.texts).strip(" "), ensure_ascii=False)}, "info": {json.dumps({"segments": self.n, "last_end_ms": self.last})}}}')
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    """The staging folder of a task; its files have their last names."""

    folder: str


class Keys:
    """Names as keys of 128 bits."""

    def __init__(self, names: Iterable[str]):
        keys = array("Q")
        for name in names:
            keys.frombytes(self._key(name))
        k = np.frombuffer(keys, np.uint64).reshape(-1, 2)
        k = k[np.lexsort((k[:, 1], k[:, 0]))]
        self.high, self.low = np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1])

    @staticmethod
    def _key(name: str) -> bytes:
        return blake2b(name.encode("utf-8", "surrogateescape"), digest_size=16).digest()

    def repeated(self) -> bool:
        return bool(((self.high[1:] == self.high[:-1]) & (self.low[1:] == self.low[:-1])).any())

    def __contains__(self, name: str) -> bool:
        high, low = np.frombuffer(self._key(name), np.uint64)
        i, j = np.searchsorted(self.high, high), np.searchsorted(self.high, high, "right")
        return bool((self.low[i:j] == low).any())


class SubtitleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # one of this try alone
        system.create_dir(folder)
        sink, now, names = None, object(), set()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["media_id"] != now:
                        if sink:
                            sink.close()
                        now = row["media_id"]
                        name = f"{quote(str(now), safe='')}.{self.kind}"
                        if name in names:
                            raise ValueError(_APART)
                        names.add(name)
                        sink = _Sink(system, f"{folder}/{name}", self.kind)
                    sink.add(row)
            if sink:
                sink.close()
        except BaseException:
            system.delete_dir(folder)
            raise
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        folders = [m.folder for m in messages if m]
        keys = Keys(name for folder in folders for name, _ in listed(system, folder, self.kind))
        if keys.repeated():
            self.abort(messages)
            raise ValueError(_APART)
        if self.overwrite:
            for name, _ in listed(system, root, self.kind):
                if name not in keys:
                    system.delete_file(f"{root}/{name}")
        for folder in folders:
            for name, _ in list(listed(system, folder, self.kind)):  # of one task
                system.move(f"{folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class SubtitleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def _kind(self) -> str:
        kind = self.options.get("kind", "srt")
        if kind not in READ:
            raise ValueError(f"kind is one of {', '.join(READ)}")
        return kind

    def schema(self) -> str:
        return READ[self._kind()]

    def reader(self, schema) -> SubtitleReader:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        fields = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in READ[self._kind()].split(", "))])
        return SubtitleReader(self.options["path"], self._kind(), int(self.options.get("partitionBytes", PARTITION_BYTES)), fields)

    def writer(self, schema, overwrite: bool) -> SubtitleWriter:
        missing = {"media_id", *WRITE[self._kind()]} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return SubtitleWriter(self.options["path"], self._kind(), overwrite)


def read_subtitles(spark: SparkSession, path: str, kind: str = "srt", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of all files of a kind in a folder, as READ has them."""
    spark.dataSource.register(SubtitleFiles)
    return spark.read.format("subtitles").option("kind", kind).option("partitionBytes", partition_bytes).load(path)


def write_subtitles(rows: DataFrame, path: str, kind: str = "srt") -> None:
    """Write the rows of each media as its file in a folder, in place of all files of the kind there; rows have media_id, the columns of WRITE and those of ORDER."""
    rows.sparkSession.dataSource.register(SubtitleFiles)
    laid = rows.repartition("media_id").sortWithinPartitions("media_id", *ORDER[kind]).select("media_id", *WRITE[kind])
    laid.write.format("subtitles").option("kind", kind).mode("overwrite").save(path)
