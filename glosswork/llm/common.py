"""What the operators of this package share: the shared folder, materialisation, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a worker holds as Python objects at a time.
SLICE_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine
    will do if driver and executors are one process, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="glosswork-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files behind tables of stored() once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) runs of a batch, each of about `chars` characters or a single longer text."""
    values = batch.column(batch.schema.get_field_index(column))
    size, start, have = values.nbytes, 0, 0
    if size <= chars:
        if len(values):
            yield 0, values.to_pylist()
        return
    lengths = pc.binary_length(values).to_pylist()
    for i, n in enumerate(lengths):
        if have and have + n > chars:
            yield start, values.slice(start, i - start).to_pylist()
            start, have = i, 0
        have += n
    if start < len(lengths):
        yield start, values.slice(start).to_pylist()


class Remembered(dict):
    """What was computed for a stretch of text, by the stretch; at most `most` entries.

    When it is full, only entries that were needed again since the last time are kept (none, if they are
    over half). What it returns never depends on what it holds.
    """

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.most, self.again = most, set()

    def missing(self, wanted: set) -> list:
        """Makes room, and returns what of `wanted` is to be computed now."""
        new = {x for x in wanted if x not in self}  # a difference of sets would go through all that is held
        if len(self) + len(new) > self.most:
            kept = {k: self[k] for k in self.again} if 2 * len(self.again) < self.most else {}
            self.clear()
            self.update(kept)
            self.again = set()
            new = {x for x in wanted if x not in self}
        else:
            self.again |= wanted - new
        return list(new)


_HELD: dict = {}


def held(key: tuple, make):
    """What an operator keeps in a worker process from task to task. Workers are used again by other
    operators, so one operator's state goes when another's comes; nothing returned depends on it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """For operators that keep nothing in a worker: drops what others kept."""
    _HELD.clear()


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
