"""Helpers shared by the document operators: staging, folds and Arrow streaming."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases the bytes A-Z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = r"[^\x20\x09-\x0D]+"
_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that the context has for checkpoints.

    Where neither is set, a folder of our own, which only a driver that runs the tasks itself
    (master ``local`` or ``local[...]``) can share with them; on a cluster that is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="costweave-shared-")
    return _own_dirs[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs one reread instead of a rerun of
    everything before, and later plans see the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the files of :func:`staged` tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from all learning."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def hash_sample(df: DataFrame, max_rows: int, by: list[str] | None = None) -> DataFrame:
    """About ``max_rows`` distinct rows chosen by a hash of the columns ``by`` (all): the same ones in every run.

    A share of the hash range bounds them, for the number of distinct hashes is estimated (to 1 %);
    no limit, which would send them through one task. Rows alike in those columns count once,
    so one row that repeats cannot fill the sample. Above ``max_rows`` the size varies by its square
    root. The hashes that repeat in the sample, ``max_rows`` or so at most, are broadcast: only their rows are shuffled.
    """
    key = fresh(df, "sample_hash")
    hashed = df.withColumn(key, F.xxhash64(F.lit("sample"), *(F.col(f"`{c}`") for c in by or df.columns)))
    n = hashed.agg(F.approx_count_distinct(key, 0.01)).first()[0]
    if n > max_rows:
        hashed = hashed.where(F.pmod(key, F.lit(1 << 53)) < int((1 << 53) * max_rows / n))
    repeated = [r[0] for r in hashed.groupBy(key).count().where("count > 1").select(key).collect()]
    if not repeated:
        return hashed.drop(key)
    again = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in sorted(repeated)], f"{key} long"))
    once = hashed.join(again, key, "left_anti")
    return once.unionByName(hashed.join(again, key, "left_semi").dropDuplicates([key])).drop(key)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most 1,000 rows and, for rows of like size, 16 MB."""
    step = max(1, min(1000, batch.num_rows * (16 << 20) // max(1, batch.nbytes)))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def arrow_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once a task and gives ``batch columns -> dict of lists``.

    Texts arrive in Arrow batches and are dropped batch by batch, so a task holds
    one batch at a time whatever the table's size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for part in _slices(batch):
                out = handle(*(part.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema
                )

    return df.select(*columns).mapInArrow(run, schema)


def with_columns_from(df: DataFrame, columns: list[str], make: Callable[[], Callable], added: str) -> DataFrame:
    """All columns of ``df`` and those of the schema ``added``, computed batch by batch from ``columns``.

    ``make()`` is called once a task; what it gives maps lists of the columns' values to a dict
    of the added ones. Added names must not be among those of ``df``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(added)
    arrow_extra = to_arrow_schema(extra)
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for part in _slices(batch):
                out = handle(*(part.column(i).to_pylist() for i in places))
                arrays = [*part.columns, *(pa.array(out[f.name], f.type) for f in arrow_extra)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *arrow_extra.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))
