"""A data source for folder trees that also sees names Spark's file readers hide.

``spark.read.format("filetree")`` gives one row a file: path, path below the root, name,
length and bytes.  The driver lists folders only until there are enough of them to share
out; everything below is listed and read in tasks.  Conditions on ``file_name`` are pushed
down, so files of other names are not opened.

Options: ``path`` the root, a folder or one file, local or with a scheme that pyarrow knows;
``skip`` folder names and ``skipSuffix`` an ending of folder names that are not entered;
``hidden`` to give only files that Spark hides (below or named with a leading dot or
underscore); ``parts`` the number of tasks aimed at; ``content`` to leave the bytes out.

Folders and files that cannot be read are left out.  Links to folders are not followed.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringEndsWith,
    StringStartsWith,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("path", "below", "file_name", "length", "content")
#: Bytes of contents after which a batch is handed on.
BATCH_BYTES = 16 << 20


@dataclass
class Folder(InputPartition):
    """Folders of one task: (path, path below the root, hidden, whether to go deeper)."""

    places: list[tuple[str, str, bool, bool]]


@dataclass
class Entry:
    path: str
    name: str
    is_folder: bool
    length: int


def is_hidden(name: str) -> bool:
    """Names that Spark's file readers leave out."""
    kept = name.startswith(("_metadata", "_common_metadata")) or (name.startswith("_") and "=" in name)
    return name.startswith((".", "_")) and not kept or name.endswith("._COPYING_")


class Local:
    """Folders of this machine or of a mounted file system."""

    def entries(self, folder: str) -> list[Entry]:
        try:
            with os.scandir(folder) as found:
                return sorted(filter(None, map(self._entry, found)), key=lambda e: e.name)
        except OSError:
            return []

    @staticmethod
    def _entry(found: os.DirEntry) -> Entry | None:
        try:
            if found.is_dir(follow_symlinks=False):
                return Entry(found.path, found.name, True, 0)
            return Entry(found.path, found.name, False, found.stat().st_size) if found.is_file() else None
        except OSError:
            return None

    def one(self, path: str) -> Entry | None:
        if not os.path.isfile(path):
            return None
        return Entry(path, os.path.basename(path), False, os.path.getsize(path))

    def read(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as file:
                return file.read()
        except OSError:
            return None


class Remote:
    """Any file system that pyarrow reaches; paths keep the scheme and host of the root."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.files, inner = fs.FileSystem.from_uri(root)
        self.prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""

    def entries(self, folder: str) -> list[Entry]:
        from pyarrow import fs

        try:
            found = self.files.get_file_info(fs.FileSelector(folder.removeprefix(self.prefix)))
        except OSError:
            return []
        return sorted(
            (Entry(self.prefix + f.path, f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found),
            key=lambda e: e.name,
        )

    def one(self, path: str) -> Entry | None:
        info = self.files.get_file_info(path.removeprefix(self.prefix))
        return Entry(path, info.base_name, False, info.size) if info.is_file else None

    def read(self, path: str) -> bytes | None:
        try:
            with self.files.open_input_stream(path.removeprefix(self.prefix)) as file:
                return file.read()
        except OSError:
            return None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}
        self.root = options["path"].rstrip("/") or "/"
        if self.root.startswith("file:"):
            self.root = "/" + self.root.removeprefix("file:").lstrip("/")
        self.skip = frozenset(filter(None, options.get("skip", "").split("\n")))
        self.skip_suffix = options.get("skipsuffix", "")
        self.hidden = options.get("hidden", "false") == "true"
        self.parts = int(options.get("parts", "64"))
        self.content = options.get("content", "true") == "true"
        self.names: list[Filter] = []

    def files(self) -> Local | Remote:
        return Remote(self.root) if "://" in self.root else Local()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the name choose what is opened; Spark applies all of them again."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("file_name",):
                self.names.append(f)
            yield f

    def wants(self, name: str) -> bool:
        for f in self.names:
            if isinstance(f, EqualTo) and name != f.value:
                return False
            if isinstance(f, In) and name not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not name.startswith(f.value):
                return False
            if isinstance(f, StringEndsWith) and not name.endswith(f.value):
                return False
        return True

    def enters(self, name: str) -> bool:
        return name not in self.skip and not (self.skip_suffix and name.endswith(self.skip_suffix))

    def partitions(self) -> list[Folder]:
        """Folders are opened level by level until there are enough to share out."""
        files, shallow = self.files(), []
        level = [(self.root, "", False)]
        while level and len(level) < self.parts and len(shallow) < 4 * self.parts:
            deeper = []
            for path, below, hidden in level:
                shallow.append((path, below, hidden, False))
                deeper += [
                    (e.path, f"{below}{e.name}/", hidden or is_hidden(e.name))
                    for e in files.entries(path) if e.is_folder and self.enters(e.name)
                ]
            level = deeper
        places = sorted(shallow + [(*place, True) for place in level])
        size = -(-len(places) // max(1, self.parts))
        return [Folder(places[i : i + size]) for i in range(0, len(places), size)]

    def found(self, files: Local | Remote, place: tuple[str, str, bool, bool]) -> Iterator[tuple[Entry, str]]:
        """The wanted files of a folder, and of the folders below it if they are to be entered."""
        root_file = files.one(place[0]) if not place[1] else None
        if root_file:
            if self.wants(root_file.name) and (is_hidden(root_file.name) or not self.hidden):
                yield root_file, root_file.name
            return
        open_ = [place]
        while open_:
            path, below, hidden, deep = open_.pop()
            for e in files.entries(path):
                own = hidden or is_hidden(e.name)
                if e.is_folder:
                    if deep and self.enters(e.name):
                        open_.append((e.path, f"{below}{e.name}/", own, True))
                elif self.wants(e.name) and (own or not self.hidden):
                    yield e, below + e.name

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, rows, size = self.files(), [], 0
        for place in partition.places:
            for entry, below in self.found(files, place):
                content = files.read(entry.path) if self.content else b""
                if content is None:
                    continue
                rows.append((entry.path, below, entry.name, entry.length, content if self.content else None))
                size += len(content) + 200
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True)
    arrays = [
        pa.array([_named(v) for v in column] if kind == pa.string() else column, kind)
        for column, kind in zip(columns, kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))


def _named(name: str) -> str:
    """A name that is no text in UTF-8 has its odd bytes replaced."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, below string, file_name string, length bigint, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree_reader(spark: SparkSession):
    """``spark.read`` for the format, with conditions on names pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree")
