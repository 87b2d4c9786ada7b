"""A sink of whole named files: one file a row, all of a job or none.

``write_named(files, path)`` takes rows (name, text). Tasks write below a hidden folder of the job; only when all have
ended and no name came twice do tasks of a second job move the files to their names, each by one rename, so
that a reader sees an old or a new file and never part of one. A job that fails before it moves leaves what was there and removes
its own folder. Neither names nor files pass through the driver: what was written where is a table. Paths may be of any
store that pyarrow knows; names may have folders in them, and of millions of files they should.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.session import cut, ship


def _staged(path: str, job: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Writes rows (name, text) below the job's folder: where each is, and its name in plain form."""

    def stage(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(path)
        folder = posixpath.join(root, job, uuid.uuid4().hex)  # another attempt of the task has another folder
        fs.create_dir(folder, recursive=True)
        k = 0
        for part in parts:
            done = []
            for given, text in zip(part["name"], part["text"]):
                name = posixpath.normpath(given or "")
                if name.startswith(("/", "..", ".writing-")) or name == ".":
                    raise ValueError(f"not a file name below the folder: {given!r}")
                at = posixpath.join(folder, str(k))
                with fs.open_output_stream(at) as f:
                    f.write((text or "").encode())
                done.append((at, name))
                k += 1
            yield pd.DataFrame(done, columns=["at", "name"])

    return stage


def _moved(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Moves staged files to their names. A task that is tried again passes over what its first attempt has moved."""

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(path)
        made = set()
        for part in parts:
            for at, name in zip(part["at"], part["name"]):
                to = posixpath.join(root, name)
                folder = posixpath.dirname(to)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                try:
                    fs.move(at, to)
                except FileNotFoundError:
                    if fs.get_file_info(to).type != FileType.File:
                        raise
            yield part[["name"]]

    return move


def _found(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(path)

        def text_of(at: str) -> str:
            with fs.open_input_file(at) as f:
                return f.readall().decode()

        for part in parts:
            for k in range(0, len(part), 256):  # names are short, texts are not
                some = part.iloc[k : k + 256].copy()
                some["text"] = [text_of(posixpath.join(root, n)) for n in some["name"]]
                yield some

    return read


def _removed(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(path)
        for part in parts:
            for name in part["name"]:
                at = posixpath.join(root, name)
                if fs.get_file_info(at).type == FileType.File:
                    fs.delete_file(at)
            yield part

    return remove


def write_named(files: DataFrame, path: str) -> DataFrame:
    """SNK-6: files (name, text) below path, each replaced as a whole when all are written. Gives their names (name)."""
    ship(files.sparkSession)
    job = f".writing-{uuid.uuid4().hex}"
    try:
        staged = cut(files.select("name", "text").mapInPandas(_staged(path, job), "at string, name string"))
        if not staged.groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError("two rows have the same name")
        staged.mapInPandas(_moved(path), "name string").agg(F.count("name")).collect()
    finally:
        fs, root = FileSystem.from_uri(path)
        own = posixpath.join(root, job)  # only the job's own folder goes
        if fs.get_file_info(own).type == FileType.Directory:
            fs.delete_dir(own)
    return staged.select("name")


def read_named(names: DataFrame, path: str) -> DataFrame:
    """name, text of the files of these names (name) below path, read where the names are: no folder is listed, and
    a task reads as many files as it has names. A name without a file is an error."""
    ship(names.sparkSession)
    return names.select("name").mapInPandas(_found(path), "name string, text string")


def remove_named(names: DataFrame, path: str) -> None:
    """Delete the files of these names (name) below path."""
    ship(names.sparkSession)
    names.select("name").mapInPandas(_removed(path), "name string").agg(F.count("name")).collect()
