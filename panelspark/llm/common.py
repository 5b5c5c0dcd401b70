"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own and
    any other session a folder in its warehouse, which is shared too.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        told = "file://" + tempfile.mkdtemp(prefix="panelspark-")
    else:
        told = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelspark"
    spark.conf.set("spark.checkpoint.dir", told)
    return told


#: Folders that :func:`saved` has written and nothing has removed yet.
_WRITTEN: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts the lineage, so that later jobs neither repeat the work nor lose it
    with an executor. Results that are lazy may need it until they are written;
    then :func:`clear` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the folders of tables of :func:`saved` that nothing lazy reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.saved_at)


def clear(spark: SparkSession) -> None:
    """Removes every intermediate table of this driver. Results of the operators must have been written before."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def broadcast_if(small: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound; else any join will do."""
    return F.broadcast(small) if rows <= most else small


#: Rows and bytes of text in one Arrow batch. Texts can be long, so batches stay short.
TEXT_ROWS, TEXT_BYTES = 256, 64 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds: about ``TEXT_ROWS`` rows or ``TEXT_BYTES`` at a time from here on, or one row."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def map_texts(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas in short batches."""
    short_batches(df.sparkSession)
    return df.mapInPandas(function, schema)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
