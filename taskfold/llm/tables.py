"""Tables between the steps of an operator, in the shared folder that the session names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from taskfold.session import scratch_path

#: While a table is made: shuffle files go as soon as a job ends, as what it wrote is read again and never computed
#: again; and texts, some of which are long, go to the Python workers a thousand at a time.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


@contextmanager
def while_writing(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    wanted = dict(_WHILE_WRITING)
    if rows:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str, rows: int | None = None, **options) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, with no lineage.

    ``rows``: how many go to a Python worker at a time; ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with while_writing(spark, rows):
        df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables made by ``stored`` that no later step reads."""
    for table in tables:
        path = getattr(table, "_llm_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever dots or spaces are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_rows(docs: DataFrame) -> DataFrame:
    """``row``: all columns of a table as one, so that no other column can clash with them."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"))


def with_row(rows: DataFrame, more: str) -> T.StructType:
    """The schema of ``row`` and further columns."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more).fields])
