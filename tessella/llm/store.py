"""Shared storage: tables that cut lineage, and binary shards that tasks write and read back.

Everything goes to the folder that the session names in ``spark.checkpoint.dir``, which driver and executors share.
Only where that is unset and Spark runs in one local process is a folder under the local /tmp used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/tessella"


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables and shards written inside the block when it ends well, but for the files of results passed to what it yields.

    Such results must be written tables: what is deleted can't be worked out again. Outside such blocks whatever an
    operator wrote stays until the shared folder is cleared, as its result may be read at any later time.
    """
    first, files = len(_made), []

    def keep(result: DataFrame) -> DataFrame:
        files.extend(result.inputFiles())
        return result

    yield keep
    for path in _made[first:]:
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in files):
            fs, own = filesystem(path)
            if fs.get_file_info(own).type == pafs.FileType.Directory:
                fs.delete_dir(own)
    del _made[first:]


def forget(table: DataFrame) -> None:
    """Delete a written table in the shared folder that nothing reads any more."""
    shared = shared_dir(table.sparkSession).removeprefix("file://")
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        fs, own = filesystem(path)
        if shared in path and fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back: the lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, as a task sees them."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def write_shard(uri: str, parts: list[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a repeated task leaves one whole file.

    Repeated tasks write the same bytes; where one has finished before, its file stays.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        fs.move(draft, path)
    else:
        fs.delete_file(draft)
    return sum(len(part) for part in parts)


def read_shard(uri: str) -> memoryview:
    """A shard's bytes: memory-mapped where the folder is mounted, else read whole (shards are of bounded size)."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return memoryview(np.memmap(path, dtype=np.uint8, mode="r"))
    with fs.open_input_file(path) as source:
        return memoryview(source.read())


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from lists or arrays, cast to ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def groups(batches: Iterator[pa.RecordBatch], names: Iterable[str], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a partition sorted by its first ``keys`` columns, one group at a time, as numpy arrays by column.

    Groups may span batches; what waits is one group, whose size the caller bounds.
    """
    names, waiting = list(names), None
    for b in batches:
        new = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        if not b.num_rows:
            continue
        waiting = new if waiting is None else {n: np.concatenate([waiting[n], new[n]]) for n in names}
        change = np.zeros(len(waiting[names[0]]) - 1, bool)
        for n in names[:keys]:
            change |= waiting[n][1:] != waiting[n][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield {n: waiting[n][lo:hi] for n in names}
        waiting = {n: waiting[n][cuts[-1] :] for n in names}
    if waiting is not None:
        yield waiting
