"""Pictures as files: a Spark data source whose files appear only when the whole write is committed.

Each task writes under a folder of its own below ``_staged``; the commit moves what tasks report into place, in threads, and an
abort deletes it.  A task that ran twice reports once, so nothing of the other attempt stays.  Folders may have any scheme that
pyarrow's file systems know; a plain path is a mounted folder.  Where a mark of the caller's says that the folder is whole, tasks move their
files themselves.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder given as a path or a URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class PictureWriter(DataSourceWriter):
    def __init__(self, folder: str, marked: bool = False) -> None:
        self.folder, self.marked, self.run = folder, marked, uuid.uuid4().hex

    def write(self, iterator):
        files, base = file_system(self.folder)
        own, names, made = f"{base}/_staged/{self.run}/{uuid.uuid4().hex}", [], set()
        files.create_dir(own, recursive=True)
        for row in iterator:
            name = posixpath.normpath("/" + row["name"])[1:]  # never above the folder
            inner = posixpath.dirname(name)
            if inner not in made:
                for top in [own, base] if self.marked else [own]:
                    files.create_dir(f"{top}/{inner}".rstrip("/"), recursive=True)
                made.add(inner)
            with files.open_output_stream(f"{own}/{name}") as out:
                out.write(bytes(row["content"]))
            if self.marked:
                files.move(f"{own}/{name}", f"{base}/{name}")
            else:
                names.append(name)
        return Written(own, names)

    def _done(self) -> None:
        files, base = file_system(self.folder)
        if files.get_file_info(f"{base}/_staged/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/_staged/{self.run}")
        if not files.get_file_info(fs.FileSelector(f"{base}/_staged", allow_not_found=True)) and files.get_file_info(f"{base}/_staged").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_staged")

    def commit(self, messages):
        files, base = file_system(self.folder)
        moves = [(f"{m.folder}/{n}", f"{base}/{n}") for m in messages if m for n in m.names]
        for folder in {posixpath.dirname(to) for _, to in moves}:
            files.create_dir(folder, recursive=True)
        if isinstance(files, fs.LocalFileSystem):  # renames of one disk wait for each other: threads only add to that
            for move in moves:
                files.move(*move)
        else:
            with ThreadPoolExecutor(32) as pool:
                list(pool.map(lambda x: files.move(*x), moves))
        self._done()

    def abort(self, messages):
        self._done()


class Pictures(DataSource):
    """Options: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PictureWriter(self.options["path"], self.options.get("marked") == "true")


def save_pictures(rows: DataFrame, folder: str, root: str, marked: bool = False) -> None:
    """rows: name (a path below the folder), content.  Writes a file each into ``folder``, which must not lie inside the indexed root; files that are there are replaced.

    ``marked``: the caller marks the folder as whole afterwards, and nobody reads it before.  Then tasks move their files into place, each whole,
    and no name goes through the driver; what a failed write has moved stays."""
    _, target = file_system(folder)
    _, inside = file_system(root)
    if posixpath.commonpath([target, inside]) == inside:
        raise ValueError("the output folder lies inside the indexed root")
    rows.sparkSession.dataSource.register(Pictures)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("pictures").option("marked", str(marked).lower()).mode("append").save(folder)
