"""What the training-data operators share: table reads, shared-folder stashes, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
DEFAULT_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it out.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    return named or DEFAULT_SHARED


#: Writer's options for rows of megabytes: a reader takes a row group at once, and Parquet's limit by bytes looks at every hundredth row only.
LARGE_ROWS = {"parquet.block.row.count.limit": "2"}

#: What operators remember in a worker process, by operator.
_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """The dictionary in which an operator keeps what it remembers between the tasks of a worker."""
    return _caches.setdefault(name, {})


def only_cache(name: str | None) -> None:
    """A worker that begins with another operator's rows forgets what the operators before remembered."""
    for other, cache in _caches.items():
        if other != name:
            cache.clear()


#: Stashes of the open ``scratch`` blocks, innermost last.
_scratch: list[list[DataFrame]] = []


def stash(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The write is committed by Spark's own protocol, so a lost executor costs a
    task, not the data.  Column types that Parquet cannot hold are the caller's concern.
    ``keep``: the table outlives the innermost ``scratch`` block.  ``options``: the writer's.
    """
    return stash_all([df], name, keep, **options)


def stash_all(frames: Iterable[DataFrame], name: str, keep: bool = False, **options: str) -> DataFrame:
    """The rows of all ``frames``, which are of one schema, in one table; each is written before the next is asked for."""
    path = None
    for df in frames:
        path = path or f"{shared_dir(df.sparkSession)}/nodelytics-{name}-{uuid.uuid4().hex}"
        df.write.mode("append").options(**options).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stash_path = path
    open_blocks = _scratch[:-1] if keep else _scratch
    if open_blocks:
        open_blocks[-1].append(made)
    return made


def release(*stashed: DataFrame) -> None:
    """Delete stashes of which no later plan reads any more."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch():
    """Delete at the end what is stashed inside; what is read afterwards must be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        release(*_scratch.pop())


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or ``name`` with as many underscores in front as keep it apart from all columns of ``frames``.

    No column of ``frames`` begins with it either, so it may lead a group of new names.
    """
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names of result columns: those given, with as many underscores in front as keep each apart from the columns of ``df``."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of a batch."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of one hold about ``max_bytes``; a longer text stands alone."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist() if batch.num_rows else []
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def with_columns(df: DataFrame, text: str, schema: str, function: Callable[[list[bytes | None]], list[list]], cache: str | None = None) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, which ``function`` gives for a list of texts.

    ``schema`` is DDL; a name of it that ``df`` has too gets underscores in front.
    ``cache``: the name of the ``worker_cache`` that ``function`` uses.
    """
    spark = df.sparkSession
    extra = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    extra = StructType([StructField(n, f.dataType) for n, f in zip(apart(df, *extra.names), extra.fields, strict=True)])
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in extra]
    position = df.columns.index(text)

    def run(batches):
        only_cache(cache)
        for batch in batches:
            for part in slices([batch], batch.schema.names[position]):
                made = function(utf8(part.column(position)))
                columns = [*part.columns, *(pa.array(v, type=f.type) for v, f in zip(made, fields, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))
