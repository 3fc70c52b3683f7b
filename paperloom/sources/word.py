"""Word files as a Spark data source: ``spark.read.format("docx").schema(...).load(folder)``.

Planning lists the files whose names ``pathGlobFilter`` admits and deals them to partitions of about
equal size; a partition parses its files one after the other and gives a row each.  Only the columns of
the schema asked for are built: ``docx.word_schema(columns)`` makes one.  Filters aren't pushed: what
Spark 4.1 pushes into a Python source stays with every DataFrame made of the same load, which would
take rows from the others without a word.

Options: ``pathGlobFilter``, ``partition_bytes`` (of files, in a partition), ``most_inflated`` (bytes that
a file's XML may inflate to), ``recursive`` (whether folders within the folder are read).
"""

from __future__ import annotations

import fnmatch
import hashlib
import zipfile
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom.sources import docx

#: A file costs at least this many bytes when partitions are planned: opening it takes time, too.
OPEN_COST = 1 << 16
#: Bytes of an archive without members; what is shorter can't be searched for its end.
LEAST_ARCHIVE = 22


def file_system(uri: str):
    """(Arrow filesystem, path, prefix that makes a path a URI again)."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), path, "file:"
    found, path = fs.FileSystem.from_uri(uri)
    return found, path, uri[: uri.index("://") + 3 + (len(uri.split("://")[1].split("/")[0]) if path.startswith("/") else 0)]


@dataclass
class Files(InputPartition):
    """(path, size) of the files of one task."""

    files: list

    def __init__(self, files):
        super().__init__(None)
        self.files = files


def dealt(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """Files in order of their path, cut into partitions of at most ``most`` bytes; a larger file stands alone."""
    out, load = [], 0
    for path, size in sorted(files):
        cost = max(size, OPEN_COST)
        if not out or load + cost > most:
            out.append([])
            load = 0
        out[-1].append((path, size))
        load += cost
    return out


class WordReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = schema.names, options
        self.nested = {f.name: f.dataType.elementType.names for f in schema.fields if hasattr(f.dataType, "elementType")}

    def partitions(self):
        from pyarrow import fs

        files, path, _ = file_system(self.options["path"])
        deep = self.options.get("recursive", "false").lower() == "true"
        folder, _, pattern = path.rpartition("/") if any(c in path for c in "*?[") else (path, "", "*")
        if files.get_file_info(folder).type == fs.FileType.File:
            found = [files.get_file_info(folder)]
        else:
            found = files.get_file_info(fs.FileSelector(folder, recursive=deep))
        kept = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[:1] not in "._" and fnmatch.fnmatch(f.base_name, self.options.get("pathGlobFilter", "*"))]
        return [Files(part) for part in dealt(kept, int(self.options.get("partition_bytes", 1 << 25)))] or [Files([])]

    def read(self, partition):
        files, _, prefix = file_system(self.options["path"])
        most = int(self.options.get("most_inflated", docx.MOST_INFLATED))
        wanted = [n for n in self.names if n in docx.COLUMNS]
        for path, _ in partition.files:
            name = path.rpartition("/")[2]
            row = {"doc_id": hashlib.sha1((prefix + path).encode()).hexdigest(), "filename": name, "paper_code": name.rpartition(".")[0].upper() if "." in name else name.upper()}
            if not name.lower().endswith(".docx"):
                row["parse_error"] = "not a .docx file"
            else:
                try:
                    with files.open_input_file(path) as stream:
                        if stream.size() < LEAST_ARCHIVE:
                            raise zipfile.BadZipFile("File is not a zip file")
                        row |= docx.parse_docx(stream, wanted, most)
                except Exception as e:  # noqa: BLE001  any file may be malformed in any way
                    row["parse_error"] = f"{type(e).__name__}: {e}"
            yield tuple(self._value(n, row.get(n)) for n in self.names)

    def _value(self, name, value):
        if value is None or not isinstance(value, list):
            return value
        return [tuple(x.get(f) for f in self.nested[name]) for x in value]


class WordFiles(DataSource):
    @classmethod
    def name(cls):
        return "docx"

    def schema(self):
        return docx.WHOLE_SCHEMA

    def reader(self, schema):
        return WordReader(schema, self.options)

