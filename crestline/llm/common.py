"""Small helpers that the operators of this subpackage share.

Every operator takes a DataFrame with an id column and a text column and looks
at those two alone: other columns may have any name, also one that an operator
gives to a column of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters: blank, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
#: A word, for Java's regular expressions: a run of anything but those six.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator works on, a null text made empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other letters left as they are."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session (as in tests), whose one machine is driver and executors at
    once, may leave it unset; then a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, sort_by: list[str] | None = None) -> DataFrame:
    """df, stored as Parquet in the shared folder and read again: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, least: int = 100) -> DataFrame:
    """rows joined with a table that has one row a key, without a hot key's rows meeting in one task.

    Keys of over a thousandth of all rows (and `least`) are fewer than a thousand; their
    rows of unique are broadcast, the others are joined as usual.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = [r[0] for r in counts.filter(F.col("n") > max(least, total // 1000)).select(key).collect()]
    if not hot:
        return rows.join(unique, key)
    often = F.col(key).isin(hot)
    return rows.filter(often).join(F.broadcast(unique.filter(often)), key).unionByName(rows.filter(~often | F.col(key).isNull()).join(unique.filter(~often), key))
