"""Reports as one whole file or none: a sink for JSON arrays and Markdown tables.

``spark.dataSource.register(ReportFile)``, then ``df.write.format("report_file").mode("overwrite")`` with the
options ``path`` (a file), ``kind`` ("json" or "markdown") and ``title`` (a heading before a table). Tasks
write pieces beside the file; when all are done the pieces are joined in the order of the tasks and the
file takes its name. If a task fails the pieces go and the file stays as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Piece(WriterCommitMessage):
    part: int
    name: str
    rows: int


def _json(row: Row) -> str:
    return json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False, allow_nan=False)


def _cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.kind, self.title = options["path"], options.get("kind", "json"), options.get("title")
        self.names, self.overwrite = schema.names, overwrite
        self.folder = f"{self.path}.{uuid.uuid4().hex}.pieces"
        if self.kind not in ("json", "markdown"):
            raise ValueError(f"no such kind of report: {self.kind}")
        store, path = self._store()
        if not overwrite and store.get_file_info(path).is_file:
            raise ValueError(f"{self.path} is there already")

    def _store(self, path: str | None = None):
        from pyarrow import fs

        path = path or self.path
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def write(self, iterator: Iterator[Row]) -> Piece:
        from pyspark import TaskContext

        store, folder = self._store(self.folder)
        store.create_dir(folder, recursive=True)
        context, n = TaskContext.get(), 0
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        with store.open_output_stream(name) as out:
            for n, row in enumerate(iterator, 1):  # noqa: B007
                line = ",\n" + _json(row) if self.kind == "json" else "| " + " | ".join(map(_cell, row)) + " |\n"
                out.write(line.encode())
        return Piece(context.partitionId(), name, n)

    def commit(self, messages: list[Piece | None]) -> None:
        store, path = self._store()
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        whole = f"{self._store(self.folder)[1]}/whole"
        store.create_dir(whole.rpartition("/")[0], recursive=True)
        with store.open_output_stream(whole) as out:
            if self.kind == "json":
                out.write(b"[")
            else:
                head = f"# {self.title}\n\n" if self.title else ""
                out.write(f"{head}| {' | '.join(map(_cell, self.names))} |\n|{'---|' * len(self.names)}\n".encode())
            # Before the first row of an array there is no comma.
            skip = 1 if self.kind == "json" else 0
            for piece in pieces:
                if piece.rows:
                    with store.open_input_file(piece.name) as f:
                        f.seek(skip)
                        while chunk := f.read(1 << 20):
                            out.write(chunk)
                    skip = 0
            if self.kind == "json":
                out.write(b"\n]\n")
        store.move(whole, path)
        self._clean()

    def abort(self, messages: list[Piece | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, folder = self._store(self.folder)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


class ReportFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_file"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options, schema, overwrite)
