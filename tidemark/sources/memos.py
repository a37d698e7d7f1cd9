"""Memos as files of their own, one each, as a Spark data source named "memo_files".

    spark.dataSource.register(MemoFileSource)
    df.select("id", "memo").write.format("memo_files").mode("append").save("/data/memos")
    spark.read.format("memo_files").load("/data/memos")

The first column names the file, the second is the memo (text or binary), whose bytes are the file's, no more and no less.  A task writes to a
folder of its own, with a folder in it for each batch of rows: part-<write>-<partition>.<attempt>/<batch>/name=<name>.txt.  Equal names
of a batch go to further folders, so each row has its file; a null memo has none.  names.parquet, a row group a batch, holds the names with their files.

A write counts when its list, parts-<write>.json, is there: it names the folders of the attempts that were committed, the others are removed.  Reading takes the
files from the lists and the names beside the files, a task a batch, so that neither the driver nor a task ever lists them.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EngineError
from .dbf import open_file

NAMES = "names.parquet"
LONGEST = 200  # characters of a name in the name of its file; the whole name is kept beside it


class Group(InputPartition):
    """A batch of a task's folder."""

    def __init__(self, part: str, group: int):
        self.part, self.group = part, group


class MemoFileReader(DataSourceReader):
    BYTES = 16 << 20  # of memos in a batch of rows, beyond which the next begins

    def __init__(self, schema: T.StructType, folder: str, parts: list[tuple[str, int]]):
        self.schema, self.folder, self.parts = schema, folder, parts

    def partitions(self) -> list[InputPartition]:
        return [Group(part, i) for part, n in self.parts for i in range(n)] or [Group("", 0)]

    def read(self, part: Group) -> Iterator[pa.RecordBatch]:
        if not part.part:
            return
        schema = to_arrow_schema(self.schema)
        filesystem, folder = open_file(self.folder)
        home = f"{folder}/{part.part}"
        with filesystem.open_input_file(f"{home}/{NAMES}") as file:
            rows = pq.ParquetFile(file).read_row_group(part.group).combine_chunks()
        memos, size, first = [], 0, 0
        for i, place in enumerate(rows["file"].to_pylist(), 1):
            memo = None
            if place is not None:
                with filesystem.open_input_file(f"{home}/{place}") as file:
                    memo = file.read()
                size += len(memo)
            memos.append(memo)
            if size >= self.BYTES or i == len(rows):
                names = rows["name"].slice(first, i - first).combine_chunks()
                yield pa.RecordBatch.from_arrays([names.cast(schema.field(0).type), _as(memos, schema.field(1).type)], schema=schema)
                memos, size, first = [], 0, i


def _as(memos: list[bytes | None], kind: pa.DataType) -> pa.Array:
    """Bytes as text or binary, unchanged."""
    wide = kind in (pa.large_string(), pa.large_binary())
    return pa.array(memos, pa.large_binary() if wide else pa.binary()).view(kind)


@dataclass
class Written(WriterCommitMessage):
    part: str
    groups: int


class MemoFileWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, folder: str):
        if len(schema) != 2 or not isinstance(schema[1].dataType, (T.StringType, T.BinaryType)):
            raise EngineError("not names and memos", schema.simpleString())
        self.schema, self.folder, self.job = schema, folder, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"part-{self.job}-{context.partitionId():06}.{context.taskAttemptId()}"
        filesystem, folder = open_file(self.folder)
        home, kind, groups = f"{folder}/{part}", to_arrow_schema(self.schema).field(0).type, 0
        filesystem.create_dir(home, recursive=True)
        with filesystem.open_output_stream(f"{home}/{NAMES}") as out, pq.ParquetWriter(out, pa.schema([("name", kind), ("file", pa.string())])) as names:
            for batch in batches:
                if not batch.num_rows:
                    continue
                places, seen, folders = [], Counter(), set()
                for name, memo in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not memo.is_valid:
                        places.append(None)
                        continue
                    stem = "" if name is None else quote(str(name), safe="", errors="replace")[:LONGEST]
                    within = f"{groups:06}.{seen[stem]}" if seen[stem] else f"{groups:06}"
                    seen[stem] += 1
                    if within not in folders:
                        filesystem.create_dir(f"{home}/{within}")
                        folders.add(within)
                    places.append(f"{within}/name={stem}.txt")
                    with filesystem.open_output_stream(f"{home}/{places[-1]}") as file:
                        file.write(memo.as_buffer())
                group = pa.table({"name": batch.column(0).cast(kind), "file": pa.array(places, pa.string())})
                names.write_table(group, row_group_size=len(group))
                groups += 1
        return Written(part, groups)

    def commit(self, messages: list[Written | None]) -> None:
        """Removes what uncommitted attempts of this write have left, and puts the list of the others in place at once."""
        parts = [(m.part, m.groups) for m in messages if m is not None]
        self._remove({part for part, _ in parts})
        filesystem, folder = open_file(self.folder)
        with filesystem.open_output_stream(f"{folder}/undone-{self.job}") as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "parts": parts}).encode())
        filesystem.move(f"{folder}/undone-{self.job}", f"{folder}/parts-{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(set())

    def _remove(self, kept: set[str]) -> None:
        filesystem, folder = open_file(self.folder)
        for info in filesystem.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-") and info.base_name not in kept:
                filesystem.delete_dir(info.path)


class MemoFileSource(DataSource):
    """The data source."""

    @classmethod
    def name(cls) -> str:
        return "memo_files"

    def _lists(self) -> list[dict]:
        """What the writes to the folder have listed."""
        filesystem, folder = open_file(self.options["path"])
        found = []
        for info in sorted(filesystem.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.base_name):
            if info.base_name.startswith("parts-") and info.base_name.endswith(".json"):
                with filesystem.open_input_file(info.path) as file:
                    found.append(json.loads(file.read()))
        if not found:
            raise EngineError("no memo files", self.options["path"])
        return found

    def schema(self) -> T.StructType:
        first, *others = (T.StructType.fromJson(x["schema"]) for x in self._lists())
        if any([f.dataType for f in x] != [f.dataType for f in first] for x in others):
            raise EngineError("memo files of several types", self.options["path"])
        return first

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MemoFileReader(schema, self.options["path"], [tuple(p) for x in self._lists() for p in x["parts"]])

    def writer(self, schema: T.StructType, overwrite: bool) -> MemoFileWriter:
        if overwrite:
            raise EngineError("memo files are only added", self.options["path"])
        return MemoFileWriter(schema, self.options["path"])
