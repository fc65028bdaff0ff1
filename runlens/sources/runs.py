"""Run folders as a data source: `spark.read.format("runlens_runs").load(root)`, or USING runlens_runs in SQL.

A run is a folder that holds a patch, a conversation or a purge report; a row has its path below root and the three texts, null where a
file is absent or, for the JSON ones, unreadable. The listing is cut into partitions by bytes, every file is read once, and
filters on `run` (equal, in a list, begins with) leave out folders before they are dealt. `register` makes the name known
to a session; pushing filters needs `spark.sql.python.filterPushdown.enabled`, which it sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from runlens.sources.files import blocks, opened

FILES = {"patch.diff": "diff", "conversation.json": "conversation", "git_integrity.json": "report"}
SCHEMA = "run string, diff string, conversation string, report string"
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Folders(InputPartition):
    runs: list[tuple[str, dict[str, str]]]


class RunsReader(DataSourceReader):
    def __init__(self, root: str, partition_bytes: int) -> None:
        self.root, self.partition_bytes = root, partition_bytes
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("run",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, run: str) -> bool:
        ok = {EqualTo: lambda f: run == f.value, In: lambda f: run in f.value, StringStartsWith: lambda f: run.startswith(f.value)}
        return all(ok[type(f)](f) for f in self.tests)

    def partitions(self) -> list[Folders]:
        fs, at = opened(self.root)
        found: dict[str, dict[str, str]] = {}
        size: dict[str, int] = {}
        scheme = self.root[: -len(at)] if "://" in self.root and self.root.endswith(at) else ""
        for info in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
            if info.type == pafs.FileType.File and info.base_name in FILES:
                run = info.path[len(at.rstrip("/")) + 1 :].rpartition("/")[0]
                if self._wanted(run):
                    found.setdefault(run, {})[FILES[info.base_name]] = scheme + info.path
                    size[run] = size.get(run, 0) + (info.size or 0)
        out: list[Folders] = []
        held = self.partition_bytes
        for run in sorted(found):
            if held + size[run] > self.partition_bytes or not out:
                out.append(Folders([]))
                held = 0
            out[-1].runs.append((run, found[run]))
            held += size[run]
        return out or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        names = ["run", *FILES.values()]
        rows: list[tuple[str | None, ...]] = []
        held = 0
        for run, files in partition.runs:
            texts = {c: b"".join(blocks(p)).decode("utf-8", "backslashreplace") for c, p in files.items()}
            for c in ("conversation", "report"):
                if c in texts and not _is_json(texts[c]):
                    texts[c] = None
            rows.append((run, *(texts.get(c) for c in FILES.values())))
            held += sum(len(t or "") for t in texts.values())
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class RunsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runlens_runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunsReader:
        if "path" not in self.options:
            raise ValueError("runlens_runs needs the path of the runs")
        return RunsReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunsSource)
