"""A sink of one file a report, in a bounded number of folders, committed as a whole.

`df.write.format("reports").mode("overwrite").option("path", ...).save()` takes rows
(name, content). Tasks write below a staging folder beside the target; the job's
commit moves the folders (as many as `folders` says, however many reports there
are) into place, and an aborted job's staging folder goes. A task that runs again
writes the same names again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FOLDERS = 256


@dataclass
class Written(WriterCommitMessage):
    files: int


def folder_of(name: str, folders: int) -> str:
    return f"{zlib.crc32(name.encode()) % folders:04d}"


def file_of(name: str) -> str:
    """A name as a file's: no separators, and none that is hidden or another folder's."""
    return "".join(c if c.isalnum() or c in "._- " else "_" for c in name).lstrip(".") or "_"


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, folders: int, suffix: str):
        self.path, self.folders, self.suffix = path.rstrip("/"), folders, suffix
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator) -> Written:
        system, root = self._open(self.staging)
        made, files = set(), 0
        for row in iterator:
            folder = f"{root}/{folder_of(row.name, self.folders)}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/{file_of(row.name)}{self.suffix}") as out:
                out.write((row.content or "").encode())
            files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Replace what is below the path by what was staged."""
        system, root = self._open(self.path)
        _, staged = self._open(self.staging)
        system.create_dir(staged, recursive=True)
        for old in system.get_file_info(fs.FileSelector(root)):
            if old.path != staged:
                system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
        for new in system.get_file_info(fs.FileSelector(staged)):
            system.move(new.path, f"{root}/{new.base_name}")
        system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, staged = self._open(self.staging)
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if not overwrite:
            raise ValueError("reports are replaced as a whole: write with mode overwrite")
        return ReportWriter(self.options["path"], int(self.options.get("folders", FOLDERS)), self.options.get("suffix", ".md"))


def write_reports(rows: DataFrame, path: str, folders: int = FOLDERS, suffix: str = ".md") -> None:
    """One file for each of rows (name, content)."""
    rows.sparkSession.dataSource.register(Reports)
    rows.select("name", "content").write.format("reports").mode("overwrite").option("path", path).option("folders", folders).option("suffix", suffix).save()
