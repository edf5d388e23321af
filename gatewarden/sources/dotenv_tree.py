"""Trees of ``.env`` files under their own name: ``<root>/<deployment>/.env``.

Spark's file sources skip names that start with a dot, so a Python data source
reads and writes them.  The driver lists only the folders below ``root``; tasks
list and read what is in them.  A writing task streams one file after the other
under a name of its own and then gives it its final name, so readers see a whole
old or a whole new file and a repeated task writes the same bytes again; files
of other deployments stay.  Files are replaced one by one, not all at once.

Paths are local or shared folders, or any address that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.settings import render_dotenv_lines
from .dotenv import parse_dotenv

FILE_NAME = ".env"
#: Read tasks at most; folders are dealt over them.
READ_TASKS = 2000


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.name = options["path"], options.get("name", FILE_NAME)

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        store, root = _open(self.root)
        # A root that is missing is an error here.
        found = store.get_file_info(fs.FileSelector(root))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        n = min(READ_TASKS, len(names))
        return [Folders(names[i::n]) for i in range(n)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple[str, str, str]]:
        from pyarrow import fs

        store, root = _open(self.root)
        for folder in partition.names:
            for f in store.get_file_info(fs.FileSelector(posixpath.join(root, folder), recursive=True)):
                if f.type == fs.FileType.File and f.base_name == self.name:
                    with store.open_input_stream(f.path) as stream:
                        yield folder, f.path, stream.readall().decode("utf-8", "replace")


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.name = options["path"], options.get("name", FILE_NAME)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, root = _open(self.root)
        for deployment, rows in groupby(iterator, key=lambda r: r[0]):
            if deployment in (None, "", ".", "..") or "/" in deployment:
                raise ValueError(f"no folder name: {deployment!r}")
            folder = posixpath.join(root, deployment)
            store.create_dir(folder, recursive=True)
            fresh, final = (posixpath.join(folder, n) for n in (f"{self.name}.{uuid.uuid4().hex}", self.name))
            with store.open_output_stream(fresh) as out:
                for i, (_, line) in enumerate(rows):
                    # An emptied deployment is a single blank line; its file has no byte.
                    if i or line:
                        out.write(f"{line}\n".encode())
            if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(final).type == fs.FileType.File:
                store.delete_file(final)
            store.move(fresh, final)
        return WriterCommitMessage()


class DotenvTree(DataSource):
    """``spark.read.format("dotenv_tree").load(root)``: deployment_id (the folder below the
    root), path, text.  Writes rows (deployment_id, line) that lie together and in order."""

    @classmethod
    def name(cls) -> str:
        return "dotenv_tree"

    def schema(self) -> str:
        return "deployment_id string, path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(dict(self.options))


def read_dotenv_tree(spark: SparkSession, root: str, name: str = FILE_NAME) -> DataFrame:
    """(deployment_id, path, line_no, key, value) of all files called ``name`` below
    ``root``; a missing root fails."""
    spark.dataSource.register(DotenvTree)
    return parse_dotenv(spark.read.format("dotenv_tree").option("name", name).load(root))


def write_dotenv_tree(settings: DataFrame, root: str, name: str = FILE_NAME, key: str = "deployment_id") -> None:
    """O4's text as ``<root>/<deployment>/<name>``, one file per deployment of ``settings``."""
    settings.sparkSession.dataSource.register(DotenvTree)
    lines = render_dotenv_lines(settings, key=key).repartition(key).sortWithinPartitions(key, "cat_ord", "part", "line")
    lines.selectExpr(f"CAST(`{key}` AS string) AS deployment_id", "line").write.format("dotenv_tree").option("name", name).mode("append").save(root)
