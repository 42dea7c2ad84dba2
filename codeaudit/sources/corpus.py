"""Source files as a table, from folders of files or from an existing table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.operators.discovery import filter_binary_ext, filter_ignored, filter_skip_dirs, with_language
from codeaudit.session import checkpoint

CHUNK = 8 << 20
HEAD_BYTES = 1_048_584
BATCH_BYTES = 16 << 20
LISTED = "path string, size long, mtime timestamp, file_type string, read_error string"
_ENTRIES = LISTED + ", folder boolean"


def _local(path: str) -> str | None:
    """The path in the local file system, or None for another one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _entries(folder: str) -> Iterator[tuple]:
    """(path, size, mtime, type, error, is folder) of what lies directly in a folder; links are not followed."""
    local = _local(folder)
    try:
        if local is not None:
            with os.scandir(local) as found:
                for e in found:
                    state = e.stat(follow_symlinks=False)
                    kind = "symlink" if e.is_symlink() else "file" if e.is_file() else "special"
                    yield (e.path, state.st_size, datetime.fromtimestamp(state.st_mtime, timezone.utc), kind, None,
                           e.is_dir(follow_symlinks=False))
            return
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(folder)
        scheme = folder[: len(folder) - len(inside)] if folder.endswith(inside) else ""
        for e in store.get_file_info(fs.FileSelector(inside)):
            yield scheme + e.path, e.size or 0, e.mtime, "file", None, e.type == fs.FileType.Directory
    except OSError as err:
        yield folder, 0, None, "folder", os.strerror(err.errno) if err.errno else str(err), False


def _stream(path: str):
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, file_type and read_error of everything below a folder, whatever its name.

    Folders are listed by the executors, one level of the tree after the other.  A
    folder that cannot be read is a row with its error.  Links are listed as such
    and not followed.
    """
    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ENTRIES.split(", ")]
        for frame in frames:
            for folder in frame["path"]:
                held: list[tuple] = []
                for row in _entries(folder):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    level = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    found = None
    while True:
        seen = checkpoint(level.mapInPandas(entries, _ENTRIES))
        files = seen.filter("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = seen.filter("folder").select("path")
        n = folders.count()
        if not n:
            return found
        level = folders.repartition(min(n, spark.sparkContext.defaultParallelism))


def _relative(root: str) -> Column:
    return F.substr("path", F.lit(len((_local(root) or root).rstrip("/")) + 2))


def _dealt(files: DataFrame, partitions: int | None) -> DataFrame:
    return files.repartition(partitions or files.sparkSession.sparkContext.defaultParallelism)


def read_corpus(
    spark: SparkSession, source: str | DataFrame, root: str | None = None,
    project: Column | None = None, patterns: list[str] | None = None,
    languages_only: bool = False, partitions: int | None = None,
) -> DataFrame:
    """`source_files` below a folder, or from a table that has the columns already.

    `root` is cut off the paths; by default each folder directly below it is a
    project.  Paths are filtered before any file is opened, and files of any name
    (`__init__.py`, `.env`) are read.  A source text is one value; a file that
    cannot be read has null content and its `read_error`.
    """
    if isinstance(source, DataFrame):
        files = source
    else:
        below = _relative(root or source)
        listed = list_files(spark, source).filter("file_type = 'file'")
        owner, relative = (F.substring_index(below, "/", 1), F.substr(below, F.length(F.substring_index(below, "/", 1)) + 2)) \
            if project is None else (project, below)
        files = listed.select(owner.alias("project_id"), relative.alias("path"), "mtime", "size", F.col("path").alias("_at"))
    kept = filter_ignored(filter_binary_ext(filter_skip_dirs(files)), patterns)
    if languages_only:
        kept = with_language(kept).filter(F.col("language").isNotNull())
    if "_at" not in kept.columns:
        return kept

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for at in range(len(frame)):
                row = frame.iloc[at: at + 1].drop(columns="_at")
                try:
                    with _stream(frame["_at"].iat[at]) as f:
                        text, error = f.read().decode("utf-8", "replace"), None
                except (OSError, MemoryError) as err:
                    text, error = None, str(err)
                held.append(row.assign(content=text, read_error=error))
                size += len(text or "")
                if size > BATCH_BYTES or len(held) == 1000:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_at").schema)
    return _dealt(kept, partitions).mapInPandas(read, fields + ", content string, read_error string")


def hash_files(spark: SparkSession, path: str, root: str | None = None, partitions: int | None = None) -> DataFrame:
    """(path, size, sha256, head, file_type, read_error) of every file below a folder.

    Each file is streamed once by one task, `CHUNK` bytes at a time, whatever its
    size; `head` are its leading bytes for format checks.
    """
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "size", "sha256", "head", "file_type", "read_error"]
        for frame in frames:
            rows, held = [], 0
            for row in frame.itertuples():
                digest, head, size, error = hashlib.sha256(), b"", 0, row.read_error
                if row.file_type == "file":
                    try:
                        with _stream(row.path) as f:
                            while chunk := f.read(CHUNK):
                                head = head or chunk[:HEAD_BYTES]
                                digest.update(chunk)
                                size += len(chunk)
                    except OSError as err:
                        error = str(err)
                read = row.file_type == "file" and error is None
                rows.append((row.relative, size if read else row.size, digest.hexdigest() if read else None, head, row.file_type, error))
                held += len(head)
                if held > BATCH_BYTES or len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    listed = list_files(spark, path).withColumn("relative", _relative(root or path))
    return _dealt(listed, partitions).mapInPandas(
        hashed, "path string, size long, sha256 string, head binary, file_type string, read_error string")
