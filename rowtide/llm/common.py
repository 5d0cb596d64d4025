"""Small helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Rows of one Arrow batch are handled in pieces of about this many bytes of text.
PIECE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the given text or binary column holds about ``limit`` bytes in each piece.

    A single row longer than the limit is a piece of its own.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, length in enumerate(pc.binary_length(values).to_pylist()):
            length = length or 0
            if i > start and held + length > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        if batch.num_rows > start:
            yield batch.slice(start)


def arrow_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], text: str, schema: StructType | str, limit: int = PIECE_BYTES
) -> DataFrame:
    """Apply ``function`` (piece of rows to a dict of columns) to every row of ``df``; rows are not moved."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for piece in pieces(batches, text, limit):
            made = function(piece)
            yield pa.RecordBatch.from_arrays(
                [_array(made[field.name], field.type) for field in target], schema=target
            )

    return df.mapInArrow(run, schema)


def _array(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def column(piece: pa.RecordBatch, name: str) -> pa.Array:
    return piece.column(piece.schema.get_field_index(name))


def hash_sample(df: DataFrame, text: str, rows: int, max_chars: int) -> list[str]:
    """At most ``rows`` texts of at most ``max_chars`` characters, the ones of smallest hash.

    A share of the hashes that yields about four times the wanted rows is cut out before anything is sorted,
    so what the tasks send does not grow with their number.
    """
    share = min(1.0, 4 * rows / max(1, df.count()))
    near = F.pmod(F.xxhash64(text), F.lit(1 << 20)) <= int(share * (1 << 20))
    short = df.filter(near & (F.length(text) <= max_chars)).select(F.col(text).alias("t"))
    return [r["t"] for r in short.orderBy(F.xxhash64("t")).limit(rows).collect()]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts_of(piece: pa.RecordBatch, name: str) -> list[str]:
    """The column as strings; null is the empty text."""
    return [t or "" for t in column(piece, name).to_pylist()]
