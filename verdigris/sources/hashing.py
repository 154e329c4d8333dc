"""Digests of files of any size and number.

Folders are listed by tasks, level by level, a folder a row, so the driver holds no listing. Files are read
in tasks, the larger ones block by block, so none has to fit into memory. The digest is the sha256 of the
content, in hexadecimal.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from fnmatch import fnmatch
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.scanners import opened
from verdigris.sources.work import written

#: Bytes of a file that is read at once, and of a block of a larger one.
WHOLE, BLOCK = 1 << 26, 1 << 20
#: Entries of a folder that a task hands over at once.
ENTRIES = 10_000


def entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, bytes, is_folder) of a folder; of links, those to files count."""
    where, root = opened(folder)
    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(root) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False) or x.is_file():
                    yield x.name, 0 if x.is_dir(follow_symlinks=False) else x.stat().st_size, x.is_dir(follow_symlinks=False)
    else:
        for x in where.get_file_info(fs.FileSelector(root)):
            yield x.base_name, x.size or 0, x.type == fs.FileType.Directory


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of all files below a folder, paths relative to it. As Spark's sources do, it passes
    over names that start with a dot or a low line."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("is_folder", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                held = []
                for name, size, is_folder in entries(f"{folder}/{at}".rstrip("/")):
                    if not name.startswith(".") and (not name.startswith("_") or "=" in name):
                        held.append({"path": f"{at}/{name}".lstrip("/"), "bytes": size, "is_folder": is_folder})
                    if len(held) == ENTRIES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    level, parts = spark.createDataFrame([("",)], "path string"), []
    while not parts or not level.isEmpty():
        found = written(level.repartition("path").mapInArrow(read, "path string, bytes long, is_folder boolean"), "listing")
        parts.append(found.where("not is_folder").select("path", "bytes"))
        level = found.where("is_folder").select("path")
    return reduce(DataFrame.unionByName, parts)


def file_digests(spark: SparkSession, folder: str, *, whole: int = WHOLE, glob: str | None = None) -> DataFrame:
    """(path, bytes, digest) of all files below a folder, paths relative to it. The content of a file is
    never a column."""
    folder = folder.rstrip("/")
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row | {"digest": digest(f"{folder}/{row['path']}", row["bytes"] if row["bytes"] <= whole else BLOCK)} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = listing(spark, folder)
    if glob:
        files = files.where(F.udf(lambda path: fnmatch(path.rsplit("/", 1)[-1], glob), "boolean")("path"))
    return files.repartition("path").mapInArrow(read, "path string, bytes long, digest string")


def digest(path: str, block: int) -> str:
    where, path = opened(path)
    made = hashlib.sha256()
    with where.open_input_stream(path) as f:
        while part := f.read(max(block, 1)):
            made.update(part)
    return made.hexdigest()
