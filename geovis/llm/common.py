"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import geovis
from geovis.session import work_dir

SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Give this package's source to all executors, once per context. Spark serves the file, so
    nothing has to be installed there or lie in a shared folder."""
    if spark.sparkContext in SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(geovis.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="geovis-source-"), "geovis-source.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    SHIPPED.add(spark.sparkContext)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow` with this package's source on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(rows, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table of documents; a null text becomes the empty text. Columns of
    other names are left behind, so they cannot clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which driver and executors share."""
    return work_dir(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a written table: what follows reads files, not a lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession, 'checkpoints')}-{uuid.uuid4().hex[:8]}")
    return df.checkpoint()


def arrow_schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def record(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    """A record batch of the schema from lists or numpy arrays in its column order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller record batches, so that a batch of long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def same_bits(column: Column) -> Column:
    """Unsigned 64-bit value held in a long, as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
