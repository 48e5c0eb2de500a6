"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one call in a Python worker: Spark's own batches (64 MB at most by default) are read slice by slice.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A folder of our own stands in for it in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark ignores case): ``name``, underscored as often as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity(*columns: str) -> Column:
    """256 bits that tell rows apart by these columns, nulls included: no two rows of any corpus are taken for one."""
    parts = [F.concat(F.coalesce(F.length(c := F.col(n).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit(""))) for n in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATE: list = [None, None]


def worker_state(kind: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, one thing at a time: the caches of an operator go when another one begins."""
    if _STATE[0] != kind:
        _STATE[:] = [None, None]
        _STATE[:] = [kind, make()]
    return _STATE[1]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of BATCH_ROWS rows at most, and of about BATCH_BYTES unless a row alone has more."""
    step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_batches(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], dict]], new: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed batch by batch in Python.

    ``function`` is called once a task and returns what maps a RecordBatch to {new column: values}. Columns of df that bear
    the name of a new column, in any case, are replaced; those in ``drop`` are not returned.
    """
    names = [f.name for f in new]
    taken = {n.lower() for n in names}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and f.name not in drop]
    schema = T.StructType(kept + new)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = function()
        for batch in (part for whole in batches for part in slices(whole)):
            got = call(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in keep_names]
            columns = [c if c.type == arrow.field(i).type else c.cast(arrow.field(i).type) for i, c in enumerate(columns)]
            columns += [v.cast(arrow.field(n).type) if isinstance(v := got[n], pa.Array) else pa.array(v, arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
