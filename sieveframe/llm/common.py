"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\f\r"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    return cut(df)


#: A table of so many light rows at most (counted before) may be broadcast.
LIGHT = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to one row for each group, which is broadcast if a count shows it to be small enough."""
    groups = materialize(groups)
    return rows.join(F.broadcast(groups) if groups.count() <= LIGHT else groups, on)


def in_order(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with ``__rank`` (from 0) in a total order and, for each column in ``sums``, ``__to_<name>``: its sum up to and with the row.

    A range-partitioned sort numbers the rows within partitions; one row for each partition tells what lies before it. No task holds all rows.
    """
    rows = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__id", 33).cast("int")).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")
    per = rows.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__of_{c}") for c in sums])
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = per.select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"__of_{c}").over(above), F.lit(0)).alias(f"__of_{c}") for c in sums])
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__n") + F.col("__at")).alias("__rank"), *[(F.col(f"__of_{c}") + F.sum(c).over(within)).alias(f"__to_{c}") for c in sums])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; any other column is left behind in the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, schema: str, rows: Callable[[list], Iterable[tuple]], chunk: int = 512) -> DataFrame:
    """mapInArrow over lists of column values, `chunk` rows at a time, so memory is bounded by the chunk.

    ``rows`` gets the columns as Python lists and yields output tuples in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = list(rows([c.to_pylist() for c in part.columns]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
