"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch, and of the part of it that is Python objects at one time: long texts stay within a worker's memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, dealt to all of them; any other as it is.

    The work on a text outweighs moving it once; rows and results are the same either way.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; it is read when a plan runs, so it has to stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most BATCH_BYTES (or one row) of the batches that have rows."""
    for b in batches:
        todo = [b] if b.num_rows else []
        while todo:
            part = todo.pop()
            if part.num_rows == 1 or part.nbytes <= BATCH_BYTES:
                yield part
            else:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]


def arrow_map(df: DataFrame, ddl: str, fn: Callable[[dict[str, list]], dict[str, list]], *cols) -> DataFrame:
    """Apply ``fn`` to the named columns, piece by piece, as Python lists; ``ddl`` types what it returns."""
    return arrow_stream(df, ddl, lambda parts: (fn(b.to_pydict()) for b in parts), *cols)


def arrow_stream(df: DataFrame, ddl: str, fn, *cols) -> DataFrame:
    """Like arrow_map, but ``fn`` maps a partition's iterator of pieces to an iterator of column dicts.

    What ``fn`` keeps between pieces (caches, open groups) ends with the partition.
    """
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches):
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.select(*cols).mapInArrow(run, schema)


def arrow_with(df: DataFrame, ddl: str, fn) -> DataFrame:
    """``df`` with the columns of ``ddl`` added or replaced, last in order; no shuffle.

    ``fn`` maps a partition's iterator of pieces (all columns) to one dict of the new columns for each.
    """
    new = T.StructType.fromDDL(ddl)
    kept = [f for f in df.schema if f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])
    arrow = to_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches):
        waiting = deque()

        def parts():
            for b in slices(batches):
                waiting.append(b)
                yield b

        for out in fn(parts()):
            b = waiting.popleft()
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(out[f.name], arrow.field(f.name).type) for f in new.fields)], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def groups_of(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, as ``(key, rows of the other columns)``."""
    key, rows = None, []
    for b in parts:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def sha256_hex(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()


def fold_of(key: Column) -> Column:
    """The split remainder: crc32 of the id as text, mod 4; remainder 2 is held out (null ids too)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4, F.lit(2))


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most ``bound`` rows, by the smallest hashes of ``keys``; all rows if there are no more.

    Keys that alone hold a twentieth of the bound are left out (no other key left: any rows of theirs).
    Fits of small models and range borders only; never used for what an operator returns.
    """
    n = df.count()
    if n <= bound:
        return df
    h = F.xxhash64(*keys, F.lit(11))
    few = df.where(F.pmod(h, F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, 2 * bound / n)) + 1))
    # about 2 x bound hashes
    sizes = sorted((r.h, r.n) for r in few.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect())
    hot = [x for x, size in sizes if size > max(1, bound // 20)]
    total, last = 0, None
    for x, size in sizes:
        if size <= max(1, bound // 20):
            if total + size > bound:
                break
            total, last = total + size, x
    return df.limit(bound) if last is None else few.where((h <= F.lit(last)) & ~h.isin(hot))
