"""Small helpers of the text operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

WHITE = b" \t\n\x0b\x0c\r"
#: Rows of one output batch; keeps the memory of a Python worker apart from the input's batch size.
OUT_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: Column) -> DataFrame:
    """Only the columns an operator needs, so that extra columns are pruned and never clash."""
    return docs.select(F.col("doc_id"), F.col("text"), *extra)


def utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """Texts of a column as UTF-8 bytes, one at a time; null is the empty text."""
    for v in column.cast(pa.binary()):
        yield v.as_py() or b""


def per_row(df: DataFrame, ddl: str, setup: Callable, *args) -> DataFrame:
    """Map every row by a function of its task.

    ``setup(*args)`` runs once in a task and returns ``f(batch) -> iterator of tuples``; the tuples
    follow ``ddl`` and are sent on in batches of at most :data:`OUT_ROWS` rows.
    """
    schema: StructType = _parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = setup(*args)
        for batch in batches:
            rows = []
            for row in f(batch):
                rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``: the folds of labelled rows and of held-out texts."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % n


def fold_of(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Null-safe equality of several columns, as a join condition."""
    cond = F.lit(True)
    for a, b in names.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
