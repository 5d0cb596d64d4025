"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.session import materialize

PREFIX_CHARS = 64
SALTS = 32


def normalized(text: Column) -> Column:
    """Runs of blank, tab, newline, vertical tab, form feed and return become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def surviving_groups(keys: DataFrame) -> DataFrame:
    """Groups of two rows or more by length, refined by prefix hash: (n_norm, prefix_hash).

    ``keys`` holds ``n_norm`` and ``prefix_hash`` of every row. One pre-aggregated shuffle counts both
    levels: the count of a length is the sum over its prefixes.
    """
    refined = keys.groupBy("n_norm", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    lengths = refined.groupBy("n_norm").agg(F.sum("n").alias("n_length")).filter("n_length > 1")
    return (
        refined.join(lengths, "n_norm", "left_semi").filter("n > 1").select("n_norm", "prefix_hash")
    )


def _with_keys(docs: DataFrame, text: str) -> DataFrame:
    norm = normalized(F.col(text))
    return docs.select(
        F.octet_length(norm).alias("n_norm"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix_hash"),
        F.sha2(norm, 256).alias("text_sha256"),
        "*",
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its group: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after :func:`normalized`. The smallest id of a group stays.
    Null text counts as empty; an empty table gives an empty result; rows that repeat an id are counted
    as rows of the group and share one decision (``kept`` is "has the smallest id"); a null id stays
    only when the whole group has no id. Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    rows = materialize(
        _with_keys(docs, "_text").select("_id", "n_norm", "prefix_hash", "text_sha256"), "exact-keys"
    )
    survivors = surviving_groups(rows)
    groups = (
        rows.groupBy("n_norm", "prefix_hash", "text_sha256")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .join(survivors, ["n_norm", "prefix_hash"], "left_semi")
        .filter("group_size > 1")
        .select("text_sha256", "keep_id", "group_size")
    )
    # A hot text is spread over SALTS sub-keys; its one group row is repeated for each.
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("_salt", salt).join(salted, ["text_sha256", "_salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` does not keep; columns are unchanged.

    Rows are dropped by (id, full hash), so an id that occurs with two texts loses only the copied one.
    """
    removed = (
        exact_dedup(docs, id_column, text)
        .filter("NOT kept")
        .select(F.col(id_column).alias("_id"), F.col("text_sha256").alias("_sha"))
        .distinct()
    )
    sha = F.sha2(normalized(docs[text]), 256)
    return docs.join(removed, docs[id_column].eqNullSafe(removed["_id"]) & (sha == removed["_sha"]), "left_anti")


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each (id, normalised text), the least by its columns; a null id is an id of its own.

    Repeats are counted over ids and hashes. Only rows that have any are gathered, and they combine in their tasks.
    """
    sha = F.sha2(normalized(docs[text]), 256)
    repeated = materialize(
        docs.select(docs[id_column].alias("_id"), sha.alias("_sha")).groupBy("_id", "_sha").count().filter("count > 1").drop("count"),
        "repeats",
    )
    if repeated.isEmpty():
        return docs
    same = docs[id_column].eqNullSafe(repeated["_id"]) & (sha == repeated["_sha"])
    row = F.struct(*[docs[c] for c in docs.columns])
    least = docs.join(repeated, same, "left_semi").groupBy(docs[id_column], sha).agg(F.min(row).alias("_row"))
    return docs.join(repeated, same, "left_anti").unionByName(least.select("_row.*"))
