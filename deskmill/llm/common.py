"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deskmill.session import durable

# Rows of one Arrow batch: bounds a worker's memory where texts are long.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Settings that jobs with Python workers want."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, prolonged until they clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def with_row_key(df: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """``df`` with a long ``name`` that, beside the id, tells documents apart.

    Rows of one id and one text are one document and share it. Different texts of one id
    have different keys, and each row without an id has its own; such rows are written
    once, so that all readers see the same. It is zero for all other rows.
    """
    known, alone = df.filter(F.col(doc_id).isNotNull()), df.filter(F.col(doc_id).isNull())
    digest = F.xxhash64(F.col(text), F.col(text).isNull())
    (key,) = fresh(df, "_shared_id")
    spread = known.groupBy(F.col(doc_id).alias(key)).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    shared = durable(spread.filter("lo <> hi").select(key))
    if shared.isEmpty():
        keyed = known.withColumn(name, F.lit(0).cast("long"))
    else:
        mine = F.when(F.col(key).isNotNull(), digest).otherwise(0)
        keyed = known.join(shared, F.col(doc_id) == F.col(key), "left").withColumn(name, mine).drop(key)
    if alone.isEmpty():
        return keyed
    return keyed.unionByName(durable(alone.withColumn(name, F.monotonically_increasing_id() + 1)))


def text_or_empty(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def map_text(
    df: DataFrame,
    text: str,
    fields: str,
    make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence]]],
    as_bytes: bool = False,
) -> DataFrame:
    """Append the columns ``fields`` (DDL), computed from the text column alone.

    ``make`` runs once per task; what it returns gets the texts of one batch
    (null: empty) and gives one sequence per new column. Names must be unused.
    """
    extra = StructType.fromDDL(fields)
    schema = StructType([*df.schema.fields, *extra.fields])
    at = df.columns.index(text)
    types = [f.type for f in to_arrow_schema(extra)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(at)
            if as_bytes:
                column = column.cast(pa.binary())
            none = b"" if as_bytes else ""
            texts = [none if t is None else t for t in column.to_pylist()]
            new = [pa.array(v, type=t) for v, t in zip(step(texts), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)
