"""Benchmark decontamination: one FM-index per shard of documents, searched for every benchmark window.

A window is 13 consecutive words of an item, or a whole shorter item. Words outside the benchmark's vocabulary
cannot be part of an occurrence, so the index of a shard holds only the stretches of vocabulary words that
are long enough for a window; the rest of the text is still read and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rowtide.llm.common import arrow_map, column, free_names
from rowtide.llm.fm_index import FMIndex

WINDOW = 13
# Benchmark text held by one broadcast; a larger benchmark is searched block after block.
BLOCK_BYTES = 16 << 20
GAP = 1  # symbol between stretches; 0 ends the shard, vocabulary words follow from 2


def _word_table() -> bytes:
    """Bytes of words stay, A-Z in lower case; every other byte becomes a blank."""
    out = bytearray(b" " * 256)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


WORD_TABLE = _word_table()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


@dataclass
class Phrases:
    """Distinct windows of a block of items, by length, and the items of each."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # length -> windows x length
    items: dict[int, list[np.ndarray]] = field(default_factory=dict)  # length -> item numbers of each window
    names: list[str] = field(default_factory=list)

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def phrases_of(items: list[tuple]) -> Phrases:
    out = Phrases()
    numbers: dict[str, int] = {}
    owners: dict[int, dict[tuple, set[int]]] = {}
    for item_id, text in items:
        symbols = [out.vocabulary.setdefault(w, len(out.vocabulary) + 2) for w in words(text)]
        if not symbols:
            continue
        number = numbers.setdefault("" if item_id is None else str(item_id), len(numbers))
        size = min(WINDOW, len(symbols))
        group = owners.setdefault(size, {})
        for i in range(len(symbols) - size + 1):
            group.setdefault(tuple(symbols[i : i + size]), set()).add(number)
    out.names = list(numbers)
    for size, group in owners.items():
        out.windows[size] = np.array(list(group), dtype=np.int64)
        out.items[size] = [np.array(sorted(s)) for s in group.values()]
    return out


def search_shard(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """Words of each document, its merged hit spans (pairs of word offsets) and the items found in it."""
    totals: list[int] = []
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    place: list[np.ndarray] = []
    shortest = phrases.shortest
    get = phrases.vocabulary.get
    for row, text in enumerate(texts):
        found = words(text)
        totals.append(len(found))
        if not shortest or len(found) < shortest:
            continue
        symbols = np.fromiter(map(get, found, repeat(GAP)), dtype=np.int64, count=len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], symbols > GAP, [False]))))
        starts, stops = edges[::2], edges[1::2]
        for a, b in zip(starts[stops - starts >= shortest], stops[stops - starts >= shortest]):
            parts += [symbols[a:b], np.array([GAP])]
            owner.append(np.full(b - a + 1, row))
            place.append(np.arange(a, b + 1))
    spans = [np.empty((0, 2), dtype=np.int64) for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not parts:
        return totals, spans, items
    index = FMIndex(np.concatenate([*parts, np.array([0])]))
    rows, places = np.concatenate(owner), np.concatenate(place)
    cover = np.zeros(len(rows) + 1, dtype=np.int64)
    for size, windows in phrases.windows.items():
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        many = (high - low)[hit]
        which = np.repeat(hit, many)
        ranks = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
        at = index.locate(ranks)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        pairs = np.unique(np.stack((rows[at], which)), axis=1)
        for row, window in pairs.T:
            items[row].update(phrases.names[k] for k in phrases.items[size][window])
    covered = np.cumsum(cover)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
    for a, b in zip(edges[::2], edges[1::2]):
        spans[rows[a]] = np.vstack((spans[rows[a]], [[places[a], places[b - 1] + 1]]))
    return totals, spans, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark as blocks of at most about ``block_bytes`` of text, one at a time.

    A block is fetched when it is asked for, so the driver holds the windows of one block only.
    """
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        part = items if n == 1 else items.filter(block == k)
        yield phrases_of([tuple(r) for r in part.collect()])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keep: bool = False,
) -> DataFrame:
    """Benchmark passages in every whole text.

    Returns (id, n_words, n_hit, n_items, items_sha256, contaminated, spans); ``spans`` are the merged
    stretches to remove, as word offsets ``first-past``. With ``keep`` the columns of ``docs`` are returned,
    followed by the flag. Null texts and items have no words; an item repeated under one id counts
    once; an item without an id counts under the empty name; without items nothing is hit. Rows are not
    moved, so repeated rows and hot texts are answered one by one.
    """
    spark = docs.sparkSession
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    base = docs if keep else docs.select(id_column, text)
    n_, spans_, items_, flag_ = free_names(base, "_n", "_spans", "_items", "_contaminated")
    state = [StructField(n_, LongType()), StructField(spans_, ArrayType(LongType())), StructField(items_, ArrayType(StringType()))]
    fields = list(base.schema.fields)
    rows = base
    for k, phrases in enumerate(blocks):
        shared = spark.sparkContext.broadcast(phrases)  # bounded by block_bytes

        def run(piece, shared=shared, first=k == 0):
            totals, spans, items = search_shard(column(piece, text).to_pylist(), shared.value)
            if not first:
                for i, (s, t) in enumerate(zip(column(piece, spans_).to_pylist(), column(piece, items_).to_pylist())):
                    spans[i] = merged(np.vstack((spans[i], np.array(s, dtype=np.int64).reshape(-1, 2))))
                    items[i].update(t)
            made = {f.name: column(piece, f.name) for f in fields}
            return made | {n_: totals, spans_: [s.ravel().tolist() for s in spans], items_: [sorted(t) for t in items]}

        rows = arrow_map(rows, run, text, StructType(fields + state))
    # The last step stays in SQL: sums over the spans, the hash of the names.
    hits = F.aggregate(
        F.transform(spans_, lambda value, i: F.when(i % 2 == 1, value).otherwise(-value)),
        F.lit(0).cast("bigint"),
        lambda acc, value: acc + value,
    )
    contaminated = (hits > 0) & (20 * hits >= F.col(n_))
    if keep:
        return rows.select(*[f.name for f in fields], contaminated.alias(flag_))
    starts = F.filter(spans_, lambda _, i: i % 2 == 0)
    ends = F.filter(spans_, lambda _, i: i % 2 == 1)
    pair = F.zip_with(starts, ends, lambda a, b: F.concat_ws("-", a, b))
    return rows.select(
        id_column,
        F.col(n_).alias("n_words"),
        hits.alias("n_hit"),
        F.size(items_).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
        F.array_join(pair, ",").alias("spans"),
    )
