"""Disk images from tables of files, and listings of disk images as tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.disks import BUILDERS, LISTINGS, extract_prodos


def _build(rows: pd.DataFrame, system: str) -> pd.DataFrame:
    rows = rows.sort_values("ord")
    image, stored = BUILDERS[system]([(n, bytes(c)) for n, c in zip(rows["name"], rows["content"], strict=True)])
    return pd.DataFrame({"disk_id": [rows["disk_id"].iloc[0]], "system": [system], "size_bytes": [len(image)], "files": [len(stored)], "content": [image]})


def build_disks(files: DataFrame, system: str) -> DataFrame:
    """files(disk_id, ord, name, content) to (disk_id, system, size_bytes, files, content), one disk a group. A group is
    one disk's files, which the caller bounds: a disk holds what its format can."""
    kind = dict(files.dtypes)["disk_id"]
    return files.select("disk_id", "ord", "name", "content").groupBy("disk_id").applyInPandas(partial(_build, system=system), f"disk_id {kind}, system string, size_bytes long, files long, content binary")


def _list(batches: Iterator[pd.DataFrame], system: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, name, size) for k, content in zip(batch["disk_id"], batch["content"], strict=True) for name, size in LISTINGS[system](bytes(content))]
        yield pd.DataFrame(rows, columns=["disk_id", "name", "size"])


def list_disks(disks: DataFrame, system: str) -> DataFrame:
    """(disk_id, name, size) of every entry: bytes, or blocks on a 1541. Extents of one CP/M name are summed, 128 bytes a record."""
    kind = dict(disks.dtypes)["disk_id"]
    listed = disks.select("disk_id", "content").mapInPandas(partial(_list, system=system), f"disk_id {kind}, name string, size long")
    return listed.groupBy("disk_id", "name").agg((F.sum("size") * 128).alias("size")) if system == "cpc_data" else listed


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, content in zip(batch["disk_id"], batch["content"], strict=True):
            image = bytes(content)
            rows = [(k, name, extract_prodos(image, name)) for name, _ in LISTINGS["prodos"](image)]
            yield pd.DataFrame(rows, columns=["disk_id", "name", "content"])


def extract_files(disks: DataFrame) -> DataFrame:
    """(disk_id, name, content) of every file of ProDOS volumes, read back through its index blocks."""
    kind = dict(disks.dtypes)["disk_id"]
    return disks.select("disk_id", "content").mapInPandas(_extract, f"disk_id {kind}, name string, content binary")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Each row's content as a file below folder, replacing one of that name; (name, error) with a row's failure kept."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            errors = []
            for n, c in zip(batch[name], batch[content], strict=True):
                try:
                    with system.open_output_stream(f"{root}/{n}", compression=None) as out:
                        out.write(bytes(c))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"name": batch[name], "error": pd.Series(errors, dtype=object)})

    return rows.select(name, content).mapInPandas(put, "name string, error string")
