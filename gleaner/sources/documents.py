"""``df.write.format("json_document")``: one JSON document, written in parts by the tasks and published at commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


#: Bytes after which a task begins a new part, so that a part can be read as one value.
PART_BYTES = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    """The files of a task, in order."""

    task: int
    files: list[str]


class JsonDocument(DataSource):
    """Rows (value: a JSON value) become the elements of an array, in the order of partitions and rows.

    Options: ``path``, ``head`` (the document up to the array's first element) and ``tail`` (what
    follows the last). The folder's files, by name, are the document: head, parts of about PART_BYTES
    (one or more a task) with an element a line, commas between parts, tail. Tasks write under names of their own into a folder
    beside the target; only the driver's commit names the parts of those that succeeded and swaps
    the folders, so a failed job leaves the old document.
    """

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options, overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.head, self.tail, self.overwrite = options["path"].rstrip("/"), options["head"], options["tail"], overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        context = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(self.staging)
        name, files = f"{folder}/task-{context.partitionId()}-{context.taskAttemptId()}", []
        out, size = None, 0
        for row in rows:
            if size >= PART_BYTES:
                out.write(b"\n")
                out.close()
                out = None
            value = row["value"].encode()
            if out is None:
                system.create_dir(folder, recursive=True)
                files.append(f"{name}-{len(files)}")
                out, size = system.open_output_stream(files[-1]), 0
                out.write(value)
            else:
                out.write(b",\n" + value)
            size += len(value)
        if out is not None:
            out.write(b"\n")
            out.close()
        return Part(context.partitionId(), files)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.staging)
        _, target = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)

        def put(name: str, text: str) -> None:
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(text.encode())

        parts = [file for m in sorted((m for m in messages if m), key=lambda m: m.task) for file in m.files]
        put("part-000000-0", f"{self.head}\n")
        for i, part in enumerate(parts, 1):
            system.move(part, f"{folder}/part-{i:06d}-1")
            if i < len(parts):
                put(f"part-{i:06d}-2", ",\n")
        put(f"part-{len(parts) + 1:06d}-9", f"{self.tail}\n")
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("task-"):
                system.delete_file(info.path)
        old = f"{folder}-old"
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            raise FileExistsError(target)
        if there:
            system.move(target, old)
        system.move(folder, target)
        if there:
            system.delete_dir(old)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
