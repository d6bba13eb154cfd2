"""What the operators share: words, tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import shared_dir

#: White space that separates words; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: what follows doesn't recompute what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `stored` returned; nothing read from now on may need it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def aside(docs: DataFrame) -> list[Column]:
    """All columns of docs under names that no operator uses."""
    return [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]


def restored(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns set aside under their own names, some of them with new values."""
    return [new.get(c, F.col(f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def bind(value: Column, then) -> Column:
    """then(v) with v evaluated once."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")
