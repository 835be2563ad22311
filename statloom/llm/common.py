"""Helpers that the corpus operators share: shared-folder tables, Arrow mapping and table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch of texts (its default is 10,000); set on the session by `small_batches`.
BATCH_ROWS = 1000
#: Rows of an Arrow batch are handed on in slices of about this many bytes of text.
SLICE_BYTES = 2_000_000


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="statloom-shared-"))
        found = _own[0]
    return found.rstrip("/")


#: Folder of each intermediate table that this process wrote, by the table.
_written: dict[str, str] = {}


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/statloom/{name}-{uuid.uuid4().hex}"
    _written[path.rsplit("/", 1)[1]] = path
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: it cuts lineage and survives lost executors.

    The table stays until `drop_tables` or `drop_written` removes it, since the caller's plan may read it at any time.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, *keys: str, shuffle: bool = False) -> DataFrame:
    """As shared_table, in as many buckets by keys as shuffles have partitions: groups and joins by keys need no exchange.

    shuffle: deal the rows by keys first, so that each bucket is one file; else each task writes the buckets it has.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _path(spark, name)
    called = path.rsplit("/", 1)[1].replace("-", "_")
    if shuffle:
        df = df.repartition(n, *keys).sortWithinPartitions(*keys)
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys)
    (writer.sortBy(*keys) if shuffle else writer).saveAsTable(called)
    out = spark.table(called)
    out.schema  # analysed before the name goes; the files stay
    spark.sql(f"DROP TABLE {called}")
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def folders(df: DataFrame) -> set[str]:
    """Names of the intermediate tables that df reads."""
    return {x for file in df.inputFiles() for x in file.split("/") if x in _written}


def drop_tables(tables: list[DataFrame]) -> None:
    """Remove intermediate tables that no plan reads any more."""
    for t in tables:
        for name in folders(t):
            _delete(t.sparkSession, _written.pop(name))


def written() -> set[str]:
    """Names of the intermediate tables so far, for `drop_written`."""
    return set(_written)


def drop_written(spark: SparkSession, keep: set[str]) -> None:
    """Remove all intermediate tables of this process but those named; for use once results are written."""
    for name in set(_written) - keep:
        _delete(spark, _written.pop(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger, since texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def cuts(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts near `size` bytes, so that long texts don't gather in Python."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += text.as_buffer().size if text.is_valid else 0
        if held >= size:
            yield start, i + 1 - start
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in such runs of rows."""
    for start, n in cuts(batch.column(column), size):
        yield batch.slice(start, n)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], text: int = 1) -> DataFrame:
    """mapInArrow where make() builds a worker-side function from a slice of rows to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                columns = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)
        # Spark keeps workers for later stages; what this task needed shouldn't stay with them.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
