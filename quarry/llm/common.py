"""What the operators share: scratch tables, word expressions, row keys.

Scratch tables are Parquet folders under ``spark.checkpoint.dir``, which every
executor and the driver can read, so a lost executor costs a re-read and never
a result.  Results read them lazily, so they stay until ``clear_scratch`` is
called or the driver process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it: space and 0x09 to 0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Everything that is neither ASCII digit, ASCII lower-case letter nor beyond ASCII.
NON_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault("dir", tempfile.mkdtemp(prefix="quarry-"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is scratch either way
        pass


#: Of a table whose size is known about, rows that go to one file.
FILE_ROWS = 100_000

_FOLDERS: list[tuple[SparkSession, str]] = []


def clear_scratch() -> None:
    """Remove all scratch tables; results that weren't written by then can't be read any more."""
    while _FOLDERS:
        _remove(*_FOLDERS.pop())


atexit.register(clear_scratch)


class Scratch:
    """A folder of intermediate tables."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
        _FOLDERS.append((spark, self.path))

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage and survives lost executors.

        With ``rows``, about how many there are, small tables go to a file for
        each core instead of one for each shuffle partition: on a local file
        system Hadoop starts processes for every file (chmod), and until such a
        process runs its program it counts with all of its executor's memory.
        """
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        _remove(self.spark, f"{self.path}/{name}")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = SPACE) -> Column:
    """The maximal runs outside ``separators``; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def bind(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f uses it: a lambda's argument is a variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, for work that multiplies what it holds; freed memory goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
