"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as a Java and a Python character class.
SPACE = "\\x20\\x09-\\x0D"
#: Text that one step of a Python task holds at a time, so that memory doesn't follow the batch's row count.
STEP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about limit bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        yield batch.slice(start)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, share: float = 1e-4) -> DataFrame:
    """rows with table's columns, null where table lacks the key (or the key is null).

    table has one row a key and the number of rows that hold it in the column copies, which is left out. Keys with more
    than that share of all rows would each meet in one task; there are at most 1 / share of them, so they are broadcast,
    and only the other keys are shuffled."""
    frequent = F.col("copies") > share * total
    hot = F.broadcast(table.where(frequent).drop("copies"))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(~frequent).drop("copies"), key, "left")
    return rows.join(hot, key).unionByName(others)


class Shared:
    """Tables written to a folder that all executors share, for results that are read more than once.

    The folder is the session's spark.checkpoint.dir. Where that is unset a local session takes a temporary folder, and
    a cluster is an error, as its machines share none."""

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        self.spark, self.root = spark, f"{root or tempfile.mkdtemp(prefix='corpusloom-')}/kept-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = kept, path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes kept tables that nothing will read again."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
