"""Scanners of one's own, as data sources that Spark reads in parts.

A scanner says on the driver how its work is cut into pieces and, in a task, gives the reports of one
piece. register() makes a data source of it: spark.read.format(name).options(...).load() gives one row
a report, of RESULT; a task takes several pieces in turn where there are more than PARTITIONS. The rows are what plans.registry.Registry reads into findings. A piece that fails gives a row
that says so, with the code of the failure, and the other pieces stay; a scanner that is not available
gives one such row.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = "project string, run_id string, tool string, stdout string, stderr string, root string, piece int, success boolean, error_code string, error string"
#: Most tasks of a scan, and rows that a task hands over at once.
PARTITIONS, ROWS = 512, 64
FIELDS = [x.split()[0] for x in RESULT.split(", ")]
ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for x in RESULT.split(", ")])


class Scanner(ABC):
    """What a user writes: a name, the languages it reads, its pieces, and the reports of a piece."""

    name: str
    languages: Sequence[str] = ("general",)

    def __init__(self, options: dict[str, str]):
        self.options = options

    def available(self) -> bool:
        return True

    @abstractmethod
    def pieces(self) -> Sequence[Any]:
        """What is scanned apart: anything that can be pickled. Slices of it are sent to the tasks, so a
        sequence that makes its pieces when they are asked for needs no room on the driver."""

    @abstractmethod
    def scan(self, piece: Any) -> Iterator[dict]:
        """Reports: project, run_id and stdout, and stderr, root and tool if they differ from '' and name."""


def failure_code(error: BaseException) -> str:
    """The error code of a scanner's failure."""
    if isinstance(error, TimeoutError) or type(error).__name__ == "TimeoutExpired":
        return "scanner_timeout"
    if isinstance(error, FileNotFoundError):
        return "scanner_binary_missing"
    return "scanner_config_error" if isinstance(error, KeyError) else "scanner_nonzero_exit"


class Pieces(InputPartition):
    """Pieces in a row, the first of which has the number given."""

    def __init__(self, place: int, what: Sequence[Any]):
        super().__init__((place, what))
        self.place, self.what = place, what


def source_of(scanner: type[Scanner]) -> type[DataSource]:
    """The data source of a scanner."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = dict(options)

        def failed(self, place: int, code: str, error: str) -> dict:
            return {"project": self.options.get("project"), "run_id": self.options.get("run_id"), "tool": scanner.name, "piece": place, "success": False, "error_code": code, "error": error}

        def partitions(self) -> list[Pieces]:
            made = scanner(self.options)
            if not made.available():
                return [Pieces(-1, [])]
            pieces = made.pieces()
            step = max(1, -(-len(pieces) // PARTITIONS))
            return [Pieces(i, pieces[i : i + step]) for i in range(0, len(pieces), step)]

        def reports(self, pieces: Pieces) -> Iterator[dict]:
            if pieces.place < 0:
                yield self.failed(0, "scanner_binary_missing", f"{scanner.name} is not available")
            for place, piece in enumerate(pieces.what, pieces.place):
                try:
                    for row in scanner(self.options).scan(piece):
                        yield {"tool": scanner.name, "stderr": "", "root": "", "piece": place, "success": True, **row}
                except Exception as e:  # whatever a user's scanner raises is a result of it
                    yield self.failed(place, failure_code(e), f"{type(e).__name__}: {e}")

        def read(self, pieces: Pieces) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in self.reports(pieces):
                held, size = [*held, {k: row.get(k) for k in FIELDS}], size + len(row.get("stdout") or "")
                if len(held) == ROWS or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, ARROW)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return scanner.name

        def schema(self) -> str:
            return RESULT

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source


def register(spark: SparkSession, *scanners: type[Scanner]) -> None:
    """Makes scanners readable by their names."""
    for scanner in scanners:
        spark.dataSource.register(source_of(scanner))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    found = urlparse(path)
    return (fs.LocalFileSystem(), found.path or path) if found.scheme in ("", "file") else fs.FileSystem.from_uri(path)


class Cuts(Sequence):
    """(path, start, end) of files (path, size) cut every step bytes, made when they are asked for."""

    def __init__(self, files: list[tuple[str, int]], step: int):
        self.files, self.step = files, step
        self.ends = list(accumulate(-(-size // step) for _, size in files))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        if not 0 <= at < len(self):
            raise IndexError(at)
        nth = bisect_right(self.ends, at)
        path, size = self.files[nth]
        start = (at - (self.ends[nth - 1] if nth else 0)) * self.step
        return path, start, min(start + self.step, size)


class LineReports(Scanner):
    """Reports in lines that have landed as files under option `path`, as .../<project>/<run_id>/<file>:
    a file is read in pieces of `piece_bytes`, cut at the ends of lines, each a report of its own."""

    name = "line_reports"

    def pieces(self) -> Cuts:
        step = int(self.options.get("piece_bytes", 1 << 25))
        where, path = opened(self.options["path"])
        files = [f for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return Cuts(sorted((f.path, f.size) for f in files), step)

    def scan(self, piece: tuple[str, int, int]) -> Iterator[dict]:
        path, start, end = piece
        where, _ = opened(self.options["path"])
        with where.open_input_file(path) as f:
            f.seek(max(0, start - 1))
            text = f.read(end - max(0, start - 1))
            if start:  # the line that the piece starts in, if any, belongs to the one before
                cut = text.find(b"\n")
                text = text[cut + 1 :] if cut >= 0 else b""
            more = b"" if not text or text.endswith(b"\n") else f.read(1 << 16)
            while more:
                cut = more.find(b"\n")
                text += more if cut < 0 else more[:cut]
                more = b"" if cut >= 0 else f.read(1 << 16)
        project, run_id = (p.split("=", 1)[-1] for p in path.split("/")[-3:-1])
        yield {"project": project, "run_id": run_id, "stdout": text.decode(errors="replace"), "tool": self.options.get("tool", self.name), "root": self.options.get("root", "")}
