"""What the corpus operators have in common: shared folders, hot-key lookups, row batches.

Everything that one task writes for another goes below ``spark.checkpoint.dir``, the one
folder that the driver and all executors see. Paths stay URIs throughout; executors open
them with ``pyarrow.fs``, which reads local, HDFS and object-store URIs alike.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The heaviest keys of a lookup that are broadcast; any key with over 1/HOT_KEYS of all rows is among them.
HOT_KEYS = 1000
#: Rows of a batch are numbered below 2**ROW_BITS, so (batch, row) fits one long.
ROW_BITS = 24
#: Batches that one task may write.
TASK_BATCHES = 1 << 14


_own_root: list[str] = []
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder all executors share; a temporary folder only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="tessella-shared-"))
        root = _own_root[0]
    return ("file://" + root if root.startswith("/") else root).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh, unique folder below the shared one."""
    uri = f"{shared_root(spark)}/tessella-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    return uri


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder made by ``new_folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if uri in _made:
        _made.remove(uri)


def mark() -> int:
    """Where ``release`` may begin."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the folders made since a mark; call it once what was read from them has been written."""
    for uri in [u for u in _made[since:] if u != keep]:
        drop_folder(spark, uri)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    uri = folder or new_folder(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on the driver or an executor."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write: Callable) -> None:
    """Write a file under a temporary name, then move it into place, so retries never clash."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with files.open_output_stream(aside, compression=None) as out:
        write(out)
    files.move(aside, path)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    weight: str,
    spread: Column,
) -> DataFrame:
    """Left-join ``left`` to ``right`` (one row per key) without a hot task.

    ``weight`` is a column of ``right``: how many rows of ``left`` have its key. The ``HOT_KEYS``
    heaviest rows of ``right`` are broadcast, a proven bound; rows of ``left`` that they answer
    go through the shuffled join with a key of their own, made of ``spread``. The keys that are
    left hold under 1 / HOT_KEYS of the rows each.
    """
    values = [c for c in right.columns if c not in keys]
    top = right.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    number = F.xxhash64(*keys)
    hot = top.select(
        number.alias("_hash_hot"), *[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*values).alias("_hot")
    )
    cold = right.select(
        number.alias("_hash_cold"), *[F.col(k).alias(f"_cold_{k}") for k in keys], F.struct(*values).alias("_cold")
    )
    # one long as the only join key keeps hashed tables small; the bounds compare the keys themselves
    def same(side: str) -> list[Column]:
        return [(F.col(k) >= F.col(f"_{side}_{k}")) & (F.col(k) <= F.col(f"_{side}_{k}")) for k in keys]

    both = left.withColumn("_hash", number).join(F.broadcast(hot), _all([F.col("_hash") == F.col("_hash_hot"), *same("hot")]), "left")
    apart = F.xxhash64(F.lit("answered"), spread, "_hash")
    both = both.withColumn("_hash", F.when(F.col("_hot").isNotNull(), apart).otherwise(F.col("_hash")))
    match = [F.col("_hash") == F.col("_hash_cold"), *same("cold")]
    joined = both.join(cold, _all(match), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*[F.col(c) for c in left.columns], *[got[v].alias(v) for v in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def tidy() -> None:
    """Give freed memory back at the end of a task: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def batch_path(folder: str, number: int) -> str:
    return f"{folder}/{number // TASK_BATCHES % 1000:03d}/{number}.arrow"


def spill_batches(folder: str, size: int, use: Callable[[pa.Table, int], Iterator[pa.RecordBatch]]):
    """Function for ``mapInArrow``: store the task's rows as numbered batch files and use each one.

    A batch has about ``size`` bytes of Arrow data and under 2**ROW_BITS rows. Its number
    follows from the partition and the place in it, so a task run again after a lost executor
    writes the same file. Batches let later steps reread rows by number instead of shuffling
    texts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * TASK_BATCHES
        held: list[pa.RecordBatch] = []
        used = rows = seq = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, used, rows, seq
            table = pa.Table.from_batches(held)
            if seq >= TASK_BATCHES:
                raise ValueError("a partition has too many batches; read it in smaller splits")
            number = base + seq
            write_atomically(batch_path(folder, number), lambda out: _write_ipc(out, table))
            held, used, rows, seq = [], 0, 0, seq + 1
            yield from use(table, number)

        for part in parts:
            for piece in pieces(part, size):
                if held and (used + piece.nbytes > size or rows + piece.num_rows >= 1 << ROW_BITS):
                    yield from flush()
                held.append(piece)
                used += piece.nbytes
                rows += piece.num_rows
        if held:
            yield from flush()
        tidy()

    return run


def pieces(part: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch of about ``size`` bytes, one row at least."""
    if part.num_rows == 0:
        return
    step = max(1, int(part.num_rows * size / 4 / max(part.nbytes, 1)))
    for at in range(0, part.num_rows, step):
        yield part.slice(at, step)


def _write_ipc(out, table: pa.Table) -> None:
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_file(out, table.schema, options=options) as writer:
        writer.write_table(table)


def read_batch(folder: str, number: int) -> pa.Table:
    files, path = filesystem(batch_path(folder, number))
    with files.open_input_file(path) as src:
        return pa.ipc.open_file(src).read_all()
