"""Catalogue of configured tables: ordered columns and primary keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide import schemas as S
from rowtide.functions.values import bare_pattern, bare_pattern_of

CATALOG = """database_name string, table_name string, columns array<string>, primary_keys array<string>,
       bare array<string>, bare_pattern string, table_order int"""


@dataclass(frozen=True)
class TableSpec:
    """One configured table. ``bare`` names the columns JSON prints without quotes."""

    database: str
    table: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...]
    bare: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"{self.database}.{self.table}"

    @classmethod
    def of(cls, database: str, table: str, df: DataFrame, primary_key: list[str]) -> TableSpec:
        """Spec of a DataFrame, columns in schema order."""
        bare = tuple(f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)))
        return cls(database, table, tuple(df.columns), tuple(primary_key), bare)


def load_catalog(spark: SparkSession, tables: list[TableSpec]) -> DataFrame:
    """The configured tables as a DataFrame; fails when any of them is unusable.

    The list comes from configuration, so the result is local data of known, small size.
    """
    if not tables:
        raise ValueError("no table is configured")
    for spec in tables:
        if not spec.columns:
            raise ValueError(f"no columns found for configured table {spec.name}")
        if not spec.primary_key:
            raise ValueError(f"no primary key found for configured table {spec.name}")
    rows = [
        (t.database, t.table, list(t.columns), list(t.primary_key), list(t.bare), bare_pattern(list(t.bare)), i) for i, t in enumerate(tables)
    ]
    return spark.createDataFrame(rows, CATALOG)


@dataclass(frozen=True)
class Layout:
    """Columns a table has from a log position on: row events at or after it carry them."""

    spec: TableSpec
    file_seq: int
    position: int


def with_layouts(catalog: DataFrame, layouts: list[Layout]) -> DataFrame:
    """The catalogue with later layouts of its tables given by the caller."""
    rows = [
        (x.spec.database, x.spec.table, x.file_seq, x.position, list(x.spec.columns), list(x.spec.primary_key), list(x.spec.bare), None)
        for x in layouts
    ]
    return attach_layouts(catalog, catalog.sparkSession.createDataFrame(rows, S.LAYOUT))


def attach_layouts(catalog: DataFrame, layouts: DataFrame) -> DataFrame:
    """The catalogue with later layouts of its tables (``ddl.layout_history``), so that rows are named as of their position.

    Adds ``layouts``, the versions of each table in log order; a table without any keeps its columns. The
    list grows by one entry for each schema change.
    """
    version = F.struct(
        F.struct("file_seq", "position").alias("since"), "columns", "primary_keys", bare_pattern_of(F.col("bare")).alias("bare_pattern")
    )
    versions = layouts.groupBy("database_name", "table_name").agg(F.array_sort(F.collect_list(version)).alias("layouts"))
    return catalog.join(versions, ["database_name", "table_name"], "left")


def catalog_from_session(
    spark: SparkSession, tables: list[tuple[str, str]], primary_keys: dict[str, list[str]]
) -> DataFrame:
    """Catalogue read from tables registered in the session, keys given per ``database.table``."""
    specs = []
    for database, table in tables:
        name = f"{database}.{table}"
        if not spark.catalog.tableExists(name):
            raise ValueError(f"no columns found for configured table {name}")
        specs.append(TableSpec.of(database, table, spark.table(name), primary_keys.get(name, [])))
    return load_catalog(spark, specs)
