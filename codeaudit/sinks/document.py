"""A data sink that writes one JSON document a name, from sorted rows of its parts.

``df.write.format("jsondocument")`` takes rows (name, section, value): ``value`` is JSON text,
``section`` the number of the list it belongs to.  Rows of a name must stand together, in
order of section; a task streams them into one file and never holds more than a row.  The
option ``texts`` is a JSON list of what stands before, between and after the sections.

Files are written below a hidden folder of the run and moved to their places when all tasks
have succeeded; after a failure that folder is removed, so no part of a document is left.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, by their names before and after the commit."""

    files: list[tuple[str, str]] = field(default_factory=list)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}
        path = options["path"]
        self.folder = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)
        if "://" in path and not path.startswith("file:"):
            raise ValueError("documents go to a folder that all executors have mounted")
        self.texts = json.loads(options["texts"])
        self.ending = options.get("ending", ".json")
        self.run = os.path.join(self.folder, f".run-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        done, file, name, section, first = Written(), None, None, 0, True
        try:
            for row in rows:
                if file is None or row["name"] != name:
                    if file is not None:
                        self.close(file, section)
                    name, section, first = row["name"], 0, True
                    os.makedirs(self.run, exist_ok=True)
                    place = os.path.join(self.run, uuid.uuid4().hex)
                    file = open(place, "w", encoding="utf-8")
                    done.files.append((place, os.path.join(self.folder, quote(name or "", safe="") + self.ending)))
                    file.write(self.texts[0])
                while section < row["section"]:
                    section, first = section + 1, True
                    file.write(self.texts[section])
                if row["value"] is not None:
                    file.write(("" if first else ",\n") + row["value"])
                    first = False
            if file is not None:
                self.close(file, section)
        except BaseException:
            for place, _ in done.files:
                if os.path.exists(place):
                    os.remove(place)
            raise
        return done

    def close(self, file, section: int) -> None:
        file.write("".join(self.texts[section + 1 :]))
        file.close()

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for message in messages:
            for place, final in message.files if message else ():
                os.replace(place, final)
        shutil.rmtree(self.run, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsondocument"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_documents(parts: DataFrame, path: str, texts: list[str], ending: str = ".json") -> None:
    """Write (name, section, value) rows as a document a name; ``position`` orders a section."""
    parts.sparkSession.dataSource.register(DocumentSink)
    order = [F.coalesce("name", F.lit("")), "section", *([F.col("position")] if "position" in parts.columns else [])]
    rows = parts.repartition(F.coalesce("name", F.lit(""))).sortWithinPartitions(*order)
    sink = rows.select("name", "section", "value").write.format("jsondocument").mode("append")
    sink.option("path", path).option("texts", json.dumps(texts)).option("ending", ending).save()
