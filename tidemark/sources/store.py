"""Archives of an object store as a Spark source.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.read.format("archives").load("s3://bucket/data").where("date >= '2024-01'")

A store is anything with ``list(marker)``, which gives (names, next marker or None), and ``get(name)``, which gives bytes or
None where there is no such object.  Another one than a file system is used by registering ``source_of(store)``.
"""

from __future__ import annotations

import hashlib
import io
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.functions.keys import DATE

_ARCHIVE = "key string, date string, zip_bytes long, sha256 string, expected string, sha256_ok boolean"
#: Columns by the option ``rows``.
SCHEMAS = {
    "lines": _ARCHIVE + ", line_no long, line string, error string",
    "archives": _ARCHIVE,
    "contents": _ARCHIVE + ", content binary",
    "names": "key string, length long, date string",
}
# Fixed value: seconds between attempts.
BACKOFF = (2, 4, 8, 16)
#: Lines of a batch, and bytes of archives of a partition, about; an archive isn't split.
LINES, PARTITION_BYTES = 20_000, 32 << 20


class Store(Protocol):
    def list(self, marker: str | None) -> tuple[list[tuple[str, int]], str | None]: ...

    def get(self, name: str) -> bytes | None: ...


class FileStore:
    """Files below a folder of any file system that pyarrow knows by its URI; listed in one page."""

    def __init__(self, root: str):
        self.root = root

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def list(self, marker: str | None) -> tuple[list[tuple[str, int]], str | None]:
        from pyarrow import fs

        system, base = self._open()
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f.path[len(base) :].lstrip("/"), f.size) for f in found if f.is_file), None

    def put(self, name: str, content: bytes) -> None:
        system, base = self._open()
        path = f"{base.rstrip('/')}/{name}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as stream:
            stream.write(content)

    def get(self, name: str) -> bytes | None:
        system, base = self._open()
        try:
            with system.open_input_stream(f"{base.rstrip('/')}/{name}") as stream:
                return stream.read()
        except FileNotFoundError:
            return None


def attempted(do: Callable, waits: tuple[float, ...]):
    """What ``do`` gives, tried again after each wait while it fails with an error of the store; the last error is raised."""
    for wait in (*waits, None):
        try:
            return do()
        except OSError:
            if wait is None:
                raise
            time.sleep(wait)


def listed(store: Store, waits: tuple[float, ...]) -> Iterator[tuple[str, int]]:
    """(name, size) of all objects, page by page until there is no marker or a page is empty."""
    marker = None
    while True:
        page, following = attempted(lambda: store.list(marker), waits)  # noqa: B023
        yield from page
        if following is None or not page:
            return
        marker = following


class Archives(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class ArchiveReader(DataSourceReader):
    def __init__(self, store: Store, waits: tuple[float, ...], rows: str):
        self.store, self.waits, self.rows, self.tests = store, waits, rows, []

    def pushFilters(self, filters: list[Filter]):
        """Filters on dates and names choose archives before any is read.  Spark applies all of them again: it may take two
        scans that differ in nothing else for the same one."""
        tests = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v}
        for f in filters:
            if type(f) in tests and f.attribute in (("date",), ("key",)):
                self.tests.append((f.attribute[0], tests[type(f)], f.value))
            yield f

    def partitions(self) -> list[Archives]:
        """Archives in groups of about PARTITION_BYTES; names alone are held here, as by any source of files."""
        out, held = [], 0
        for name, size in listed(self.store, self.waits):
            if not name.endswith(".zip"):
                continue
            has = {"key": name, "date": _date(name)}
            if not all(test(has[column], value) for column, test, value in self.tests):
                continue
            if not out or held + size > PARTITION_BYTES:
                out.append(Archives([]))
                held = 0
            out[-1].names.append((name, size))
            held += size
        return out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        names = partition.names if partition else []
        if self.rows == "names":
            yield _batch("names", [name for name, _ in names], [size for _, size in names], [_date(name) for name, _ in names])
            return
        for name, _ in names:
            content = attempted(lambda: self.store.get(name), self.waits)  # noqa: B023
            sums = attempted(lambda: self.store.get(name + ".CHECKSUM"), self.waits)  # noqa: B023
            expected = (sums.decode("utf-8", "replace").split() or [None])[0] if sums is not None else None
            sha = None if content is None else hashlib.sha256(content).hexdigest()
            about = (name, _date(name), None if content is None else len(content), sha, expected, sha is not None and sha == expected)
            if self.rows == "lines":
                for numbers, lines, error in lines_of(content):
                    yield _batch("lines", *([x] * len(lines) for x in about), numbers, lines, [None] * (len(lines) - 1) + [error])
            else:
                yield _batch(self.rows, *([x] for x in about), *([[content]] if self.rows == "contents" else []))


def _date(name: str) -> str:
    found = re.search(DATE, name)
    return found[1] if found else ""


def lines_of(content: bytes | None) -> Iterator[tuple[list[int], list[str | None], str | None]]:
    """(numbers, lines, error of the last one) of the first member, LINES at a time; what is broken ends with line -1."""
    lines, start = [], 0
    try:
        if content is None:
            raise FileNotFoundError("listed, but not there")
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.infolist()[0]) as member:
            for line in io.TextIOWrapper(member, "utf-8", errors="replace", newline=None):
                lines.append(line.rstrip("\n"))
                if len(lines) == LINES:
                    yield [*range(start, start + len(lines))], lines, None
                    lines, start = [], start + len(lines)
        if lines:
            yield [*range(start, start + len(lines))], lines, None
    except (zipfile.BadZipFile, IndexError, EOFError, zlib.error, FileNotFoundError) as e:
        yield [*range(start, start + len(lines)), -1], [*lines, None], f"{type(e).__name__}: {e}"


def _batch(rows: str, *columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in SCHEMAS[rows].split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


class ArchiveSource(DataSource):
    """Zip archives with their checksums: a row for each line of an archive's first member, in file order.

    Columns: the name below the root, the date in it (empty if none), the archive's size and SHA-256, the checksum expected
    of the file beside it (null if there is none) and whether they agree, the line and its number from 0.  An archive that
    is broken or gone gives, after what could be read, a row of line -1 that says why.  Options: ``path``; ``rows``, 'lines'
    unless given: 'archives' for one row an archive, 'contents' for that with its bytes, 'names' for what is listed, of which
    nothing is read; ``backoff``: seconds between attempts, for every request to the store.

    Filters on ``date`` and ``key`` choose the archives that are read; spark.sql.python.filterPushdown.enabled has to be set.
    Contents never leave the task that reads them but as lines."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "lines")]

    def store(self) -> Store:
        return FileStore(self.options["path"])

    def reader(self, schema: StructType) -> ArchiveReader:
        waits = tuple(float(x) for x in self.options.get("backoff", ",".join(map(str, BACKOFF))).split(",") if x)
        return ArchiveReader(self.store(), waits, self.options.get("rows", "lines"))


def source_of(store: Store, name: str = "archives") -> type[ArchiveSource]:
    """A source like ArchiveSource, with another store."""

    class Of(ArchiveSource):
        @classmethod
        def name(cls) -> str:
            return name

        def store(self) -> Store:
            return store

    return Of
