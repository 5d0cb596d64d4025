"""Row shaping: from raw log events to named before/after images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.values import map_json, normalized
from rowtide.functions.versions import file_seq
from rowtide.operators.ordered import LOG_ORDER, carry_last

ROW_TYPES = {"WRITE": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE"}
TABLE = ["database_name", "table_name"]


def resolve_table_map(log: DataFrame) -> DataFrame:
    """Name the table of each row event from the latest TABLE_MAP before it.

    Expects blocked log entries (``with_blocks``). Row events without a mapping are dropped;
    TABLE_MAP entries have done their work and are dropped too.
    """
    announced = F.when(F.col("type") == "TABLE_MAP", F.struct(*TABLE))
    mapped = carry_last(log, ["connector", "table_id"], LOG_ORDER, announced, "_mapping")
    is_row = F.col("type").isin(*ROW_TYPES)
    kept = mapped.filter((F.col("type") != "TABLE_MAP") & (~is_row | F.col("_mapping").isNotNull()))
    return kept.withColumns(
        {c: F.when(is_row, F.col(f"_mapping.{c}")).otherwise(F.col(c)) for c in TABLE}
    ).drop("_mapping")


def filter_tables(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of configured tables, names matched exactly."""
    return rows.join(F.broadcast(catalog.select(*TABLE)), TABLE, "left_semi")


def ignored_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of tables nobody configured."""
    return rows.join(F.broadcast(catalog.select(*TABLE)), TABLE, "left_anti")


def mark_configured(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``configured``, keeping every row."""
    known = catalog.select(*TABLE, F.lit(True).alias("configured"))
    return rows.join(F.broadcast(known), TABLE, "left").fillna(False, ["configured"])


def join_metadata(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach columns and primary key; a row whose table has no metadata is an error.

    With a layout history (``catalog.with_layouts``) a row gets the newest layout at or before its log
    position. The catalogue is the configured list, so broadcasting it has a fixed bound.
    """
    joined = rows.join(F.broadcast(catalog.drop("table_order", "bare")), TABLE, "left")
    if "layouts" in catalog.columns:
        here = F.struct(file_seq("file").alias("file_seq"), F.col("pos").alias("position"))
        newest = F.try_element_at(F.filter("layouts", lambda x: x["since"] <= here), F.lit(-1))
        joined = joined.withColumn("_layout", newest)
        for c in ("columns", "primary_keys", "bare_pattern"):
            joined = joined.withColumn(c, F.coalesce(F.col(f"_layout.{c}"), F.col(c)))
        joined = joined.drop("layouts", "_layout")
    missing = F.raise_error(F.concat_ws(".", F.lit("no metadata loaded for configured table"), *TABLE))
    return joined.filter(F.when(F.col("columns").isNull(), missing.cast("boolean")).otherwise(F.lit(True)))


def named_map(columns: Column, values: Column) -> Column:
    """Column names zipped with positional values, cut to the shorter side."""
    n = F.least(F.size(columns), F.size(values))
    zipped = F.map_from_arrays(F.slice(columns, F.lit(1), n), F.slice(values, F.lit(1), n))
    return F.when(values.isNotNull(), zipped)


def name_columns(rows: DataFrame) -> DataFrame:
    """Replace positional ``before``/``after`` values by maps from column name to text."""
    return rows.withColumns(
        {side: named_map(F.col("columns"), F.col(side)) for side in ("before", "after")}
    )


def extract_pk(image: Column, primary_keys: Column) -> Column:
    """Key columns of an image in key order; a column the image lacks gives null."""
    values = F.transform(primary_keys, lambda c: F.try_element_at(image, c))
    return F.when(image.isNotNull(), F.map_from_arrays(primary_keys, values))


def row_images(events: DataFrame) -> DataFrame:
    """One row per change with its operation and before/after values."""
    exploded = events.select(
        *[c for c in events.columns if c != "rows"], F.posexplode("rows").alias("row_pos", "row")
    )
    op = F.create_map(*[F.lit(x) for pair in ROW_TYPES.items() for x in pair])[F.col("type")]
    return exploded.select(
        *[c for c in exploded.columns if c != "row"],
        op.alias("op"),
        F.when(F.col("type") != "WRITE", F.col("row.before")).alias("before"),
        F.when(F.col("type") != "DELETE", F.col("row.after")).alias("after"),
    )


def with_keys(rows: DataFrame) -> DataFrame:
    """Add ``primary_key`` (from the after image, from before for deletes) and ``pk_changed``."""
    before = extract_pk(F.col("before"), F.col("primary_keys"))
    after = extract_pk(F.col("after"), F.col("primary_keys"))
    changed = ~F.map_values(before).eqNullSafe(F.map_values(after))
    return rows.withColumns(
        {
            "primary_key": F.when(F.col("op") == "DELETE", before).otherwise(after),
            "pk_changed": (F.col("op") == "UPDATE") & changed,
        }
    )


def check_pk_stable(rows: DataFrame, on_error: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Split off updates that change their primary key.

    ``raise`` makes the job fail when such a row is reached, as a feed must not go past it;
    ``quarantine`` returns them as the second DataFrame.
    """
    bad = rows.filter("pk_changed").drop("pk_changed")
    if on_error == "quarantine":
        return rows.filter("NOT pk_changed").drop("pk_changed"), bad
    if on_error != "raise":
        raise ValueError(f"unknown on_error: {on_error}")
    # A filter is evaluated whichever columns are read afterwards.
    failure = F.raise_error(F.lit("primary key mutation is not supported")).cast("boolean")
    guarded = rows.filter(F.when(F.col("pk_changed"), failure).otherwise(F.lit(True)))
    return guarded.drop("pk_changed"), bad


def image_json(image: Column) -> Column:
    """A named image as one JSON object, numbers unquoted, fields in column order."""
    return map_json(image, F.col("bare_pattern"))


def normalize_values(df: DataFrame) -> DataFrame:
    """Typed columns in the form row images carry them: Base64 bytes, ISO instants, plain dates."""
    return df.select(*[normalized(f.name, f.dataType).alias(f.name) for f in df.schema])
