"""Repeated passages across documents, found by suffix sorting.

A byte goes when it lies in a string of ``width`` bytes that also starts in a document with a smaller id. A string is
routed by the least hash of the ``GRAM``-byte substrings in it, which equal strings share:

1. Every bucket of documents lists the least hashes of its strings; a hash that only one document has cannot
   belong to a repeated string, so its strings are done.
2. The remaining strings travel to the shard of their hash, neighbours with one hash as one context. Equal contexts
   of a bucket are combined before they travel.
3. Each shard leaves out the strings whose own hash no other string of it has, and sorts the suffixes of the rest by
   external induced sorting. Strings are equal where the common prefixes between neighbours reach ``width``; the
   least id of such a class decides.
4. Decisions return to the documents and are merged into removed runs.

The text is shuffled once, because the three steps that read it share one exchange; all steps are deterministic, so lost executors are made good by recomputing.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.induced_sort import sort_suffixes

WIDTH = 50
GRAM = 16
BUCKET_BYTES = 8 << 20  # text of one bucket of documents
SHARD_BYTES = 8 << 20  # input text per shard of contexts
PIECE = 1 << 20  # bytes hashed at a time
LONGEST = 1024  # strings of one context
# A hash that occurs more often than this is routed string by string, so no shard gathers all its contexts.
HOT = 50_000
QUEUE_ITEMS = 1 << 18  # queued suffixes one sort holds in memory; the rest waits on disk
MARKS = 1 << 25  # places that mark repeated strings of a shard
NO_HASH = np.uint64(2**64 - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)


def substring_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash of the substring of ``size`` bytes at each place that has one."""
    n = len(data) - size + 1
    power, reach = data.astype(np.uint64) + np.uint64(1), 1  # hashes of ``reach`` bytes, a power of two
    factor, done, hashed = ODD, 0, np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if size & reach:
                hashed *= factor
                hashed += power[done : done + n]
                done += reach
            if done == size:
                break
            power = power[:-reach] * factor + power[reach:]
            factor, reach = factor * factor, reach * 2
        hashed ^= hashed >> np.uint64(31)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(29)
    return hashed


def least_hashes(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each start of a ``width``-byte string, the least hash of the ``gram``-byte substrings in it."""
    hashed = substring_hashes(data, gram)
    span, reach = 1, width - gram + 1
    while span * 2 <= reach:
        hashed = np.minimum(hashed[:-span], hashed[span:])
        span *= 2
    if span < reach:
        hashed = np.minimum(hashed[: len(hashed) - (reach - span)], hashed[reach - span :])
    return np.minimum(hashed, NO_HASH - np.uint64(1))


def stretches(texts: list[bytes], width: int, gram: int):
    """Maximal runs of strings with one least hash: (text number, first start, strings, hash) as arrays."""
    out = []
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= PIECE):
            held += len(texts[stop])
            stop += 1
        lengths = np.array([len(t) for t in texts[at:stop]])
        if held >= width:
            least = least_hashes(np.frombuffer(b"".join(texts[at:stop]), dtype=np.uint8), width, gram)
            starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(at, stop), lengths)[: len(least)]
            offset = np.arange(len(least)) - starts[owner - at]
            # Strings that would reach into the next text do not exist; long runs are cut.
            exists = offset + width <= lengths[owner - at]
            change = np.empty(len(least), dtype=bool)
            change[0] = True
            change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (exists[1:] != exists[:-1])
            change |= offset % LONGEST == 0
            first = np.flatnonzero(change)
            many = np.diff(np.append(first, len(least)))
            real = exists[first]
            first, many = first[real], many[real]
            out.append((owner[first], offset[first], many, least[first]))
        at = stop
    if not out:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*out))


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _texts(group: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and bytes of the different rows of a bucket, by id and bytes; their places there name them."""
    rows = sorted(set(zip(group.column("_id").to_pylist(), group.column("_data").to_pylist())))
    return np.array([i for i, _ in rows], dtype=np.int64), [data for _, data in rows]


def list_hashes(group: pa.Table, width: int, n_shards: int) -> pa.Table:
    """Step 1 for a bucket: its distinct hashes by shard, how often each occurs, and whether in two documents."""
    bucket = group.column("_bucket")[0].as_py()
    ids, texts = _texts(group)
    owner, _, _, hashes = stretches(texts, width, GRAM)
    made = {"_shard": [], "_bucket": [], "hashes": [], "counts": [], "several": []}
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], ids[owner[order]]
        first = np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1))
        counts = np.diff(np.append(first, len(hashes))).astype(np.uint32)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        distinct = hashes[first]
        shard = (distinct % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = order[a:b]
            made["_shard"].append(int(shard[mine[0]]))
            made["_bucket"].append(bucket)
            made["hashes"].append(distinct[mine].tobytes())
            made["counts"].append(_pack(counts[mine]))
            made["several"].append(_pack(several[mine]))
    return pa.table(made, schema=pa.schema([("_shard", pa.int64()), ("_bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("several", pa.binary())]))


def repeated_hashes(group: pa.Table, hot: int) -> pa.Table:
    """Which hashes of each bucket occur in two documents anywhere, and which of them are hot."""
    rows = group.to_pylist()
    parts = [np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows]
    every = np.concatenate(parts)
    counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    several = np.concatenate([_unpack(r["several"], bool) for r in rows])
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    buckets = np.diff(np.append(first, len(every)))
    # Two buckets are nearly always two documents; rows of one id do not remove each other later.
    repeated = (buckets > 1) | np.logical_or.reduceat(several[order], first)
    total = np.add.reduceat(counts[order], first)
    distinct = ordered[first]
    distinct, is_hot = distinct[repeated], total[repeated] > hot
    made = {"_bucket": [], "hashes": [], "hot": []}
    if len(distinct):
        for r, mine in zip(rows, parts):
            at = np.minimum(np.searchsorted(distinct, mine), len(distinct) - 1)
            found = distinct[at] == mine
            if found.any():
                made["_bucket"].append(r["_bucket"])
                made["hashes"].append(mine[found].tobytes())
                made["hot"].append(mine[found][is_hot[at[found]]].tobytes())
    return pa.table(made, schema=pa.schema([("_bucket", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())]))


CONTEXTS = pa.schema([
    ("_shard", pa.int64()), ("_bucket", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("many", pa.binary()), ("text", pa.binary()),
])
RUNS = pa.schema([("_bucket", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])


def _runs_row(bucket: int, rows, starts, ends) -> dict:
    """Runs of one bucket, merged by row."""
    rows, starts, ends = (np.asarray(x, dtype=np.int64) for x in (rows, starts, ends))
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    if len(rows):
        # The furthest end so far, per row; a run starts where it is passed.
        fresh = np.concatenate(([True], rows[1:] != rows[:-1]))
        group = np.cumsum(fresh)
        big = np.int64(ends.max() + 1)
        reach = np.maximum.accumulate(ends + group * big) - group * big
        fresh[1:] |= starts[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        rows, starts, ends = rows[first], starts[first], np.maximum.reduceat(ends, first)
    return {"_bucket": bucket, "rows": _pack(rows), "starts": _pack(starts), "ends": _pack(ends)}


def send_contexts(group: pa.Table, answers: pa.Table, width: int, n_shards: int) -> pa.Table:
    """Step 2 for a bucket: contexts of repeated hashes, by shard.

    Of equal contexts only the ones of the smallest id travel. The others are removed whatever the
    shards say; they are kept as rows of shard -1.
    """
    if group.num_rows == 0 or answers.num_rows == 0:
        return pa.table({f.name: pa.array([], f.type) for f in CONTEXTS}, schema=CONTEXTS)
    bucket = group.column("_bucket")[0].as_py()
    ids, texts = _texts(group)
    owner, offset, many, hashes = stretches(texts, width, GRAM)
    known = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in answers.column("hashes").to_pylist()]))
    hot = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in answers.column("hot").to_pylist()]))
    found = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    owner, offset, many, hashes = owner[found], offset[found], many[found], hashes[found]
    is_hot = np.isin(hashes, hot) if len(hot) else np.zeros(len(hashes), dtype=bool)
    shard = (hashes % np.uint64(n_shards)).astype(np.int64)
    least: dict[bytes, int] = {}  # context -> smallest id so far; texts come by id, so the first one
    sent: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
    gone: tuple[list, list, list] = ([], [], [])

    def offer(place, k, doc, start, n, context):
        if least.setdefault(context, doc) == doc:
            row = sent[place]
            row[0].append(k)
            row[1].append(start)
            row[2].append(n)
            row[3].append(context)
        else:
            gone[0].append(k)
            gone[1].append(start)
            gone[2].append(start + n + width - 1)

    for k, start, n, place, split in zip(owner.tolist(), offset.tolist(), many.tolist(), shard.tolist(), is_hot.tolist()):
        doc, text = int(ids[k]), texts[k]
        if split:
            for s in range(start, start + n):
                one = text[s : s + width]
                offer(xxhash.xxh64_intdigest(one) % n_shards, k, doc, s, 1, one)
        else:
            offer(place, k, doc, start, n, text[start : start + n + width - 1])
    rows = [
        {
            "_shard": place, "_bucket": bucket, "rows": _pack(np.array(k, dtype=np.int32)), "ids": _pack(ids[k]), "starts": _pack(np.array(s, dtype=np.int64)),
            "many": _pack(np.array(n, dtype=np.int32)), "text": zlib.compress(b"".join(c), 1),
        }
        for place, (k, s, n, c) in sent.items()
    ]
    if gone[0]:
        local = _runs_row(bucket, *gone)
        rows.append({"_shard": -1 - bucket, "_bucket": bucket, "rows": local["rows"], "ids": b"", "starts": local["starts"], "many": local["ends"], "text": b""})
    return pa.Table.from_pylist(rows, schema=CONTEXTS)


def equal_strings(text: np.ndarray, is_start: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Smallest id of the class of equal ``width``-byte strings, for each start; other places are undefined."""
    order, common = sort_suffixes(text, cap=width, depth=width, memory_items=QUEUE_ITEMS)
    group = np.cumsum(common < width)
    mine = is_start[order]
    order, group = order[mine], group[mine]
    out = np.zeros(len(text), dtype=np.int64)
    if len(order):
        first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        least = np.minimum.reduceat(ids[order], first)
        out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def repeated_starts(text: np.ndarray, is_start: np.ndarray, width: int) -> np.ndarray:
    """Which of the strings that start at ``is_start`` may occur twice; one whose hash is alone cannot."""
    out = np.zeros(len(text), dtype=bool)
    if len(text) >= width:
        mine = np.flatnonzero(is_start)
        hashes = substring_hashes(text, width)[mine]
        ordered = np.sort(hashes)
        marked = np.zeros(MARKS, dtype=bool)
        marked[ordered[1:][ordered[1:] == ordered[:-1]] % np.uint64(MARKS)] = True
        out[mine] = marked[hashes % np.uint64(MARKS)]
    return out


def least_ids(text: np.ndarray, is_start: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Like ``equal_strings``; only the stretches of strings that may be repeated are sorted."""
    start = repeated_starts(text, is_start, width)
    out = ids.copy()
    # A stretch reaches ``width - 1`` bytes beyond its last start.
    edge = np.diff(np.concatenate(([0], start.astype(np.int8), [0])))
    first, past = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    sizes = past - first + width - 1
    if len(first):
        moved = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(first - moved, sizes)
        is_mine = np.ones(len(at), dtype=bool)
        for k in range(1, width):
            is_mine[moved + sizes - k] = False
        out[at[is_mine]] = equal_strings(text[at], is_mine, ids[at], width)[is_mine]
    return out


def judge_shard(group: pa.Table, width: int) -> pa.Table:
    """Step 3: removed runs by bucket and row. Equal contexts are sorted once."""
    rows = group.to_pylist()
    if rows and rows[0]["_shard"] < 0:  # decided in the bucket itself
        done = [{"_bucket": r["_bucket"], "rows": r["rows"], "starts": r["starts"], "ends": r["many"]} for r in rows]
        return pa.Table.from_pylist(done, schema=RUNS)
    number: dict[bytes, int] = {}
    which, docs, ids, starts, buckets = [], [], [], [], []
    for r in rows:
        many = _unpack(r["many"], np.int32)
        data = zlib.decompress(r["text"])
        ends = np.cumsum(many.astype(np.int64) + width - 1).tolist()
        at = 0
        for end in ends:
            which.append(number.setdefault(data[at:end], len(number)))
            at = end
        docs.append(_unpack(r["rows"], np.int32))
        ids.append(_unpack(r["ids"], np.int64))
        starts.append(_unpack(r["starts"], np.int64))
        buckets.append(np.full(len(many), r["_bucket"], dtype=np.int64))
    which = np.array(which, dtype=np.int64)
    docs, ids, starts, buckets = np.concatenate(docs), np.concatenate(ids), np.concatenate(starts), np.concatenate(buckets)
    lengths = np.array([len(c) for c in number], dtype=np.int64)
    text = np.frombuffer(b"".join(number), dtype=np.uint8)
    del number
    order = np.lexsort((ids, which))
    least = ids[order][np.searchsorted(which[order], np.arange(len(lengths)))]
    begins = np.cumsum(lengths) - lengths
    is_start = np.ones(len(text), dtype=bool)
    for k in range(1, width):
        is_start[begins + lengths - k] = False
    least_id = least_ids(text, is_start, np.repeat(least, lengths), width)
    # Every sent context against the decisions of its text; neighbouring removed strings become one run at once.
    n = lengths[which] - width + 1
    first = np.cumsum(n) - n
    inner = np.arange(n.sum()) - np.repeat(first, n)
    hit = least_id[np.repeat(begins[which], n) + inner] < np.repeat(ids, n)
    before, after = np.roll(hit, 1), np.roll(hit, -1)
    before[first] = False
    after[first + n - 1] = False
    opens, closes = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    entry = np.searchsorted(first, opens, "right") - 1
    run_start, run_end = starts[entry] + inner[opens], starts[entry] + inner[closes] + width
    order = np.argsort(buckets[entry], kind="stable")
    entry, run_start, run_end = entry[order], run_start[order], run_end[order]
    cuts = np.flatnonzero(np.diff(buckets[entry])) + 1
    made = []
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(entry)]):
        if high > low:
            bucket = int(buckets[entry[low]])
            made.append(_runs_row(bucket, docs[entry[low:high]], run_start[low:high], run_end[low:high]))
    return pa.Table.from_pylist(made, schema=RUNS)


def apply_runs(group: pa.Table, runs: pa.Table) -> pa.Table:
    """Step 4 for a bucket: what is left of each document."""
    by_row: dict[int, list] = defaultdict(list)
    if runs.num_rows:
        parts = [[_unpack(x, np.int64) for x in runs.column(c).to_pylist()] for c in ("rows", "starts", "ends")]
        merged = _runs_row(0, *(np.concatenate(p) for p in parts))
        columns = (_unpack(merged[c], np.int64).tolist() for c in ("rows", "starts", "ends"))
        for row, a, b in zip(*columns):
            by_row[row].append((a, b))
    ids, data = group.column("_id"), group.column("_data").to_pylist()
    place = {row: k for k, row in enumerate(sorted(set(zip(ids.to_pylist(), data))))}
    made = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
    for doc, text in zip(ids.to_pylist(), data):
        cut = by_row.get(place[doc, text], ())
        left, at = hashlib.sha256(), 0
        for a, b in cut:
            left.update(text[at:a])
            at = b
        left.update(text[at:])
        made["n_bytes"].append(len(text))
        made["n_removed"].append(sum(b - a for a, b in cut))
        made["n_spans"].append(len(cut))
        made["kept_sha256"].append(left.hexdigest())
        made["spans"].append(",".join(f"{a}:{b}" for a, b in cut))
    return pa.table({"_id": ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids} | made)


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    bucket_bytes: int = BUCKET_BYTES,
    shard_bytes: int = SHARD_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """Bytes of each document that also occur, ``width`` at a time, in a document with a smaller id.

    Returns (id, n_bytes, n_removed, n_spans, kept_sha256, spans); ``spans`` are the maximal removed runs as
    byte offsets ``start:end``. Null text is empty; texts shorter than ``width`` keep all bytes; an empty table
    gives an empty result. Rows that repeat an id are one source and never remove each other, whether their texts are
    equal or not; each loses what is found in its own text. A row without an id is no source and loses nothing. Ids
    are whole numbers.
    """
    every = docs.select(
        F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data")
    )
    rows = every.filter(F.col("_id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("_data"))).first()[0] or 0
    n_buckets, n_shards = max(1, math.ceil(total / bucket_bytes)), max(1, math.ceil(total / shard_bytes))
    # The text is part of the bucket's key, so rows of one id are spread too.
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_data"), F.lit(n_buckets).cast("bigint")))
    listed = spread.groupBy("_bucket").applyInArrow(
        lambda t: list_hashes(t, width, n_shards), "_shard bigint, _bucket bigint, hashes binary, counts binary, several binary"
    )
    answers = listed.groupBy("_shard").applyInArrow(
        lambda t: repeated_hashes(t, hot), "_bucket bigint, hashes binary, hot binary"
    )
    contexts = spread.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(
        lambda t, a: send_contexts(t, a, width, n_shards),
        "_shard bigint, _bucket bigint, rows binary, ids binary, starts binary, many binary, text binary",
    )
    runs = contexts.groupBy("_shard").applyInArrow(
        lambda t: judge_shard(t, width), "_bucket bigint, rows binary, starts binary, ends binary"
    )
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string"
    result = spread.groupBy("_bucket").cogroup(runs.groupBy("_bucket")).applyInArrow(apply_runs, schema)
    untouched = every.filter(F.col("_id").isNull()).select(
        "_id", F.octet_length("_data").cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.sha2("_data", 256), F.lit("")
    )
    return result.union(untouched).withColumnRenamed("_id", id_column)
