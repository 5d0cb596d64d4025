"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, computable both ways.

Row number x of n becomes place p(x); shard p mod shards, slot p div shards. So shards differ by one row at most,
slots have no gaps, and where a row went (or which row a slot holds) follows from n, the seed and the number alone.

The permutation works on pairs (x div b, x mod b) of a grid a x b that is just large enough. Rounds add a mix of one
half to the other and take turns, so each can be undone; a place outside of [0, n) is permuted again until it is
inside (cycle walking).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.operators.snapshot import with_rank

LAW = "rows"
SEED = 20240229
ROUNDS = 8
# Products of two numbers below this prime fit a bigint.
PRIME = (1 << 31) - 1
FIRST, SECOND = 1_103_515_245, 741_103_597
# Places outside the range are fewer than one row of the grid, so a walk is rarely longer than one step.
MAX_WALK = 256


def round_keys(seed: int = SEED) -> list[int]:
    return [(seed * 48_271 + (r + 1) * 1_645_333_507) % PRIME for r in range(ROUNDS)]


def _mix(half: Column, key: Column) -> Column:
    spread = ((half + key) % PRIME) * FIRST % PRIME
    return spread.bitwiseXOR(F.shiftright(spread, 13)) * SECOND % PRIME


def grid(n: Column) -> tuple[Column, Column]:
    """Sides a, b with a * b >= n, by less than one row more."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("bigint")
    return a, F.call_function("div", n + a - 1, a)


def _rounds(x: Column, n: Column, seed: int, inverse: bool) -> Column:
    a, b = grid(n)
    steps = [F.struct(F.lit(r).alias("r"), F.lit(k).cast("bigint").alias("key")) for r, k in enumerate(round_keys(seed))]
    sign = -1 if inverse else 1

    def one(held, step):
        left = F.pmod(held["left"] + sign * _mix(held["right"], step["key"]), a)
        right = F.pmod(held["right"] + sign * _mix(held["left"], step["key"]), b)
        return F.when(
            step["r"] % 2 == 0, F.struct(left.alias("left"), held["right"].alias("right"))
        ).otherwise(F.struct(held["left"].alias("left"), right.alias("right")))

    start = F.struct(F.call_function("div", x, b).alias("left"), (x % b).alias("right"))
    return F.aggregate(F.array(*(steps[::-1] if inverse else steps)), start, one, lambda s: s["left"] * b + s["right"])


def _walked(x: Column, n: Column, seed: int, inverse: bool) -> Column:
    once = _rounds(x, n, seed, inverse)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        once,
        lambda y, _: F.when(y < n, y).otherwise(_rounds(y, n, seed, inverse)),
        lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("bigint")),
    )
    return F.when(once < n, once).otherwise(walk)


def place_of(row_number: Column, n: Column, seed: int = SEED) -> Column:
    """Place of a row number (0-based, of ``n``) in the shuffled order."""
    return _walked(row_number.cast("bigint"), n.cast("bigint"), seed, False)


def row_at(place: Column, n: Column, seed: int = SEED) -> Column:
    """The row number that a place of the shuffled order holds: undoes :func:`place_of`."""
    return _walked(place.cast("bigint"), n.cast("bigint"), seed, True)


def with_shards(
    df: DataFrame, order: list[str], shards: int, seed: int = SEED, names: tuple[str, str] = ("shard", "slot")
) -> DataFrame:
    """Add shard and slot to every row. ``order`` numbers the rows; rows equal in it are interchangeable.

    Numbering sorts ``df`` by range once and needs one row per partition beyond that; no task holds more than its range.
    An empty table stays empty; ``names`` must not be among its columns.
    """
    ranked = with_rank(df, order)
    place = place_of(F.col("row_rank"), F.col("n_total"), seed)
    shard, slot = names
    return (
        ranked.withColumn("_place", place)
        .withColumns({shard: (F.col("_place") % shards).cast("int"), slot: F.expr(f"_place DIV {int(shards)}")})
        .drop("_place", "row_rank", "n_total")
    )


def write_shards(placed: DataFrame, path: str, files: int) -> None:
    """Write rows with shard and slot as folders ``shard=N``; read by name, the files of a shard ascend by slot."""
    ranged = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard and slot: (id, size, text_crc32, law, shard, slot, grown_shard).

    Rows are numbered by id, null ids first; rows with equal ids by checksum, size and hash of their texts, and rows equal
    in all are interchangeable. ``size`` is the UTF-8 bytes of the text plus one; null counts like the empty
    text, checksum 0. Texts of any length are read once and not moved. The law is ``rows``, so ``grown_shard`` is
    null. Other columns are not read; an empty table gives an empty result.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(value) + 1).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(value).alias("_tie"),
    )
    placed = with_shards(rows, ["_id", "text_crc32", "size", "_tie"], shards, seed)
    return placed.select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
