"""Files as a data source: images in, assets out, with writes that are there whole or not at all.

    register(spark)
    spark.read.format("raster_files").option("path", folder).load()
    rows.write.format("raster_files").option("path", folder).mode("append").save()

Reading lists the folder once and deals files out by size; a task opens its own. Writing takes rows(name, content). A task
writes into a folder of its own below `_writing`, and tells what it wrote; only when all tasks have, files move to their names,
in place of others of that name. A task that fails and is tried again, or that runs twice, leaves nothing of its first try.
Names that leave the folder are an error. Folders are local paths or URIs that pyarrow's file systems know, and have to be
shared by driver and executors.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

READ = "image_id string, name string, format string, file_size long, content binary"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder.rstrip("/"))


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, folder: str, task_bytes: int) -> None:
        self.folder, self.task_bytes = folder, task_bytes

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _open(self.folder)
        parts, held = [[]], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or "/_writing/" in info.path:
                continue
            if held + info.size > self.task_bytes and parts[-1]:
                parts.append([])
                held = 0
            parts[-1].append(info.path)
            held += info.size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as file:
                content = file.read()
            name = posixpath.basename(path)
            yield path, name, name.rpartition(".")[2].upper() if "." in name else "", len(content), content


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    folder: str


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _open(self.folder)
        own = f"{root}/_writing/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        files = []
        try:
            for k, row in enumerate(iterator):
                name = posixpath.normpath(row["name"])
                if name.startswith(("/", "..")) or name in (".", ""):
                    raise ValueError(f"not a name below the folder: {row['name']}")
                with system.open_output_stream(f"{own}/{k}", compression=None) as out:
                    out.write(bytes(row["content"] or b""))
                files.append((f"{own}/{k}", name))
        except BaseException:
            system.delete_dir(own)
            raise
        return Written(files, own)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.folder)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(info.path) != "_writing":
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for message in filter(None, messages):
            for path, name in message.files:
                system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                system.move(path, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_writing/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_writing/{self.job}")
        if system.get_file_info(f"{root}/_writing").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{root}/_writing")):
            system.delete_dir(f"{root}/_writing")


class RasterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("task_bytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("rows have to have the columns name and content")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterFiles)
