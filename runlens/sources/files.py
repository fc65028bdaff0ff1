"""Files of any size as rows: listed by Spark, hashed and copied in blocks by the executors, never whole in a row.

Paths are URIs or local paths that every executor reaches (local or shared folders, HDFS, S3 through Arrow's file systems).
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def blocks(path: str) -> Iterator[bytes]:
    fs, at = opened(path)
    with fs.open_input_stream(at) as stream:
        while part := stream.read(BLOCK):
            yield part


def exists(path: str) -> bool:
    fs, at = opened(path)
    return fs.get_file_info(at).type == pafs.FileType.File


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in columns.items())])


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, rel, n_bytes) of the files below root, empty ones too, whose names fit the pattern; their contents are not read."""
    found = walked(spark.createDataFrame([(root,)], "folder string"))
    return found.where(F.substring_index("rel", "/", -1).rlike(fnmatch.translate(pattern).replace(r"\Z", r"\z"))).select("path", "rel", "n_bytes")


def contents(files: DataFrame) -> DataFrame:
    """files (path, …): adds content, the bytes of each file (2 GB at most), null where there is no such file."""
    keep = files.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                data = b"".join(blocks(path)) if path is not None and exists(path) else None
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary())], [*keep, "content"])

    return files.repartition("path").mapInArrow(step, _with(files, content=T.BinaryType()))


def digested(files: DataFrame) -> DataFrame:
    """files (path, …): adds sha256 of each file's bytes, null where there is no such file. Large files are dealt out one by one."""
    keep = files.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256() if path is not None and exists(path) else None
                for part in blocks(path) if digest else ():
                    digest.update(part)
                found.append(digest.hexdigest() if digest else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*keep, "sha256"])

    return files.repartition("path").mapInArrow(step, _with(files, sha256=T.StringType()))


def copied(files: DataFrame) -> DataFrame:
    """files (source, target, …): copies each and adds n_bytes, null for a source that is not there. A retried task writes the same file again."""
    keep = files.columns

    def one(source: str, target: str) -> int | None:
        if not exists(source):
            return None
        fs, at = opened(target)
        fs.create_dir(at.rpartition("/")[0])
        n = 0
        with fs.open_output_stream(at) as out:
            for part in blocks(source):
                out.write(part)
                n += len(part)
        return n

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [one(s, t) for s, t in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*keep, "n_bytes"])

    return files.repartition("target").mapInArrow(step, _with(files, n_bytes=T.LongType()))


def moved(folders: DataFrame) -> DataFrame:
    """folders (source, target): each source takes its target's place by a rename, and what stood there goes; adds `moved`.

    A target is always either the old folder or the new one, but for the moment between two renames. Done again, it
    finds nothing left to do.
    """

    def one(source: str, target: str) -> bool:
        fs, new = opened(source)
        _, to = opened(target)
        aside = f"{new}.old"
        if fs.get_file_info(new).type != pafs.FileType.Directory:
            return False
        fs.create_dir(to.rpartition("/")[0])
        if fs.get_file_info(to).type != pafs.FileType.NotFound:
            fs.move(to, aside)
        fs.move(new, to)
        if fs.get_file_info(aside).type != pafs.FileType.NotFound:
            fs.delete_dir(aside)
        return True

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(s, t) for s, t in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("target"), pa.array(done)], ["source", "target", "moved"])

    return folders.select("source", "target").mapInArrow(step, "source string, target string, moved boolean")


def written(texts: DataFrame) -> DataFrame:
    """texts (target, text): writes each text to its file."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, text in zip(batch.column("target").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fs, at = opened(target)
                fs.create_dir(at.rpartition("/")[0])
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("target")], ["target"])

    return texts.select("target", "text").mapInArrow(step, "target string")


def removed(folder: str) -> None:
    fs, at = opened(folder)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def walked(folders: DataFrame) -> DataFrame:
    """folders (folder, …): a row for each file at any depth below each, with path, rel and n_bytes; a folder that is not there has none."""
    keep = folders.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row, paths, rels, sizes = [], [], [], []
            for i, folder in enumerate(batch.column("folder").to_pylist()):
                fs, at = opened(folder)
                base = at.rstrip("/")
                for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                    if info.type == pafs.FileType.File:
                        at_row.append(i)
                        paths.append(folder[: len(folder) - len(at)] + info.path if folder.endswith(at) else info.path)
                        rels.append(info.path[len(base) + 1 :])
                        sizes.append(info.size)
            rows = batch.take(pa.array(at_row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.string()), pa.array(rels, pa.string()), pa.array(sizes, pa.int64())], [*keep, "path", "rel", "n_bytes"])

    return folders.mapInArrow(step, _with(folders, path=T.StringType(), rel=T.StringType(), n_bytes=T.LongType()))
