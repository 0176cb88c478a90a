"""Model text made from the driver's tables: written once for each folder of tables in a session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import shared_dir

_MADE: dict[tuple[str, str, str], str] = {}


def made_once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[str], None]) -> str:
    """The folder that make filled for these tables; it fills a new one where there is none yet in this session, or where that is gone."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    done = _MADE.get(key)
    if done is None or not path_of(done).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_of(f"{done}/_made")):
        done = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make(done)
        spark.range(1).write.parquet(f"{done}/_made")
        _MADE[key] = done
    return done


def as_text(rows: DataFrame, key: str, expression: str, path: str) -> list[str]:
    """Each row's lines as text files below path, in the order of a key; the files' names in that order."""
    spark = rows.sparkSession
    rows.orderBy(key).select(F.expr(expression).alias("value")).filter("value IS NOT NULL").write.text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName() for f in found if f.getPath().getName().startswith("part-") and f.getLen())


def one_file(rows: list[str], spark: SparkSession, path: str) -> str:
    """Lines as one text file below path; its name."""
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return next(f.getPath().getName() for f in found if f.getPath().getName().startswith("part-") and f.getLen())
