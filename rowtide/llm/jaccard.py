"""Near copies: a Jaccard join over word shingles with adaptive multi-match prefixes.

Shingles are ordered by how common they are. Two sets that reach the threshold share at least ``m`` shingles
among the first ``|x| - least overlap + m`` of each, for any ``m``. Every set picks its own ``m`` from the estimated
cost of its candidates: a set whose prefix is common lengthens it and asks for that many more shared
shingles before its candidates are compared in full.

Copies with equal sets are one node. Before pairs are looked for, each node is compared with one centre that
shares its most common prefix shingle; nodes that link to the same centre need no pairs among themselves.
Pairs are then looked for only across the groups so far, which loses no component.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

from rowtide.llm.common import arrow_map, column, free_names
from rowtide.llm.components import connected_components
from rowtide.llm.exact import drop_repeats, normalized
from rowtide.operators.snapshot import with_rank
from rowtide.session import materialize

MORE_MATCHES = 16  # a prefix is lengthened by at most so many shingles
VERIFY_COST = 20.0  # comparing two sets, in steps along a posting list
BLOCK = 256  # members or probes of one posting list that meet in one task
BUCKET_BYTES = 8 << 20  # text of one bucket of documents
SHARD_BYTES = 24 << 20  # text whose shingles one task counts
PIECE = 1 << 20  # bytes hashed at a time

# --- sets ----------------------------------------------------------------------------------------------

ODD = 0x9E3779B97F4A7C15
UNDO = pow(ODD, -1, 2**64)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class Shingler:
    """Sets of hashed word shingles: sorted distinct 64-bit values.

    Words are hashed for many texts at once: a word's hash is the sum of its bytes times powers of an odd
    number, shifted back to its start.
    """

    def __init__(self, size: int):
        self.size = size
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def sets_of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= PIECE):
                held += len(texts[stop]) + 1
                stop += 1
            yield from self._sets(texts[at:stop])
            at = stop

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(ODD, len(data)), _powers(UNDO, len(data))
        inside = ~BLANK[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        first, past = edges[::2], edges[1::2]
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
        word = _mixed((total[past] - total[first]) * self.down[first] + (past - first).astype(np.uint64))
        lengths = np.array([len(t) + 1 for t in texts])
        bounds = np.searchsorted(first, np.concatenate(([0], np.cumsum(lengths))))
        rolled = word.copy()
        for k in range(1, self.size):
            rolled = _mixed(rolled[:-1] * np.uint64(ODD) + word[k:]) if len(rolled) > 1 else rolled[:0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= self.size:
                yield np.unique(rolled[a : b - self.size + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    short = _mixed(short * np.uint64(ODD) + word[k])
                yield short
            else:
                yield np.empty(0, dtype=np.uint64)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def least_overlap(n: int, num: int, den: int) -> int:
    """Shared shingles a set of ``n`` needs with any linked set: J >= num/den, so at least that share of itself."""
    return -(-num * n // den)


# --- how many sets hold each shingle ---------------------------------------------------------------------


def _node_sets(docs: pa.Table, nodes: pa.Table, size: int) -> tuple[list[bytes], list, list[np.ndarray]]:
    """Keys, ids and sets of the bucket's nodes, each from one row with the node's id and set, by key."""
    wanted = dict(zip(nodes.column("_key").to_pylist(), nodes.column("_id").to_pylist()))
    ids = set(wanted.values())
    rows = [(i, t or b"") for i, t in zip(docs.column("_id").to_pylist(), docs.column("_text").to_pylist()) if i in ids]
    found = {}
    for (i, _), values in zip(rows, Shingler(size).sets_of([t for _, t in rows])):
        key = set_key(values)
        if key not in found and key in wanted and wanted[key] == i:
            found[key] = values
    keys = sorted(found)
    return keys, [wanted[k] for k in keys], [found[k] for k in keys]


def _by_shard(sets: list[np.ndarray], n_shards: int, bits: int):
    """Distinct shortened shingles of a bucket ordered by shard, their counts, and where each occurrence went."""
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    short = flat >> np.uint64(64 - bits)
    width = -(-(1 << bits) // n_shards)  # shards are ranges, so value order is shard order
    values, where, counts = np.unique(short, return_inverse=True, return_counts=True)
    cuts = np.searchsorted(values, np.arange(n_shards + 1, dtype=np.uint64) * np.uint64(width))
    return values, counts, where, cuts


LISTS = "_shard bigint, _bucket bigint, tokens binary, counts binary"
ANSWERS = "_bucket bigint, _shard bigint, counts binary"


def list_shingles(docs: pa.Table, nodes: pa.Table, size: int, n_shards: int, bits: int) -> pa.Table:
    made = {"_shard": [], "_bucket": [], "tokens": [], "counts": []}
    if docs.num_rows and nodes.num_rows:
        values, counts, _, cuts = _by_shard(_node_sets(docs, nodes, size)[2], n_shards, bits)
        for shard in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[shard], cuts[shard + 1]
            steps = np.diff(values[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
            # Byte planes: the steps are small, so the high planes vanish under compression.
            kept = max(1, 8 - int((steps[1:].max(0)[::-1] > 0).argmax()) if b - a > 1 and steps[1:].any() else 1)
            planes = np.ascontiguousarray(steps[:, :kept].T).tobytes()
            made["_shard"].append(int(shard))
            made["_bucket"].append(nodes.column("_bucket")[0].as_py())
            made["tokens"].append(bytes([kept]) + int(values[a]).to_bytes(8, "little") + planes)
            made["counts"].append(zlib.compress(counts[a:b].astype(np.uint32).tobytes(), 1))
    kinds = pa.schema([("_shard", pa.int64()), ("_bucket", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
    return pa.table(made, schema=kinds)


def _tokens(blob: bytes) -> np.ndarray:
    kept, first = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(kept, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :kept] = planes.T
    steps = steps.view(np.uint64).ravel().copy()
    steps[0] = first
    return np.cumsum(steps)


def count_shingles(group: pa.Table) -> pa.Table:
    """Sets over all buckets that hold each shingle, returned to every bucket in its own order."""
    rows = group.to_pylist()
    parts = [_tokens(r["tokens"]) for r in rows]
    _, where = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint32) for r in rows])
    total = np.bincount(where, weights=counts).astype(np.uint32)[where]
    made, at = [], 0
    for r, mine in zip(rows, parts):
        made.append({"_bucket": r["_bucket"], "_shard": r["_shard"], "counts": zlib.compress(total[at : at + len(mine)].tobytes(), 1)})
        at += len(mine)
    return pa.Table.from_pylist(made, schema=pa.schema([("_bucket", pa.int64()), ("_shard", pa.int64()), ("counts", pa.binary())]))


LIVE = "key binary, min_id {kind}, n bigint, need int, prefix binary, tokens array<bigint>, counts array<bigint>, values binary"


def live_nodes(docs: pa.Table, both: pa.Table, size: int, n_shards: int, bits: int, num: int, den: int, kind: pa.DataType) -> pa.Table:
    """Nodes that share a shingle of their one-match prefix with another node.

    ``tokens`` and ``counts`` are those shared shingles and their list lengths; ``prefix`` is the prefix for the
    ``need`` matches the node picked; ``values`` is the whole set.
    """
    made = {"key": [], "min_id": [], "n": [], "need": [], "prefix": [], "tokens": [], "counts": [], "values": []}
    nodes = both.filter(pc.is_valid(both.column("_key")))
    answers = both.filter(pc.is_valid(both.column("counts")))
    if docs.num_rows and nodes.num_rows:
        keys, ids, sets = _node_sets(docs, nodes, size)
        values, _, where, _ = _by_shard(sets, n_shards, bits)
        order = np.argsort(answers.column("_shard").to_numpy(), kind="stable").tolist()
        blobs = answers.column("counts").to_pylist()
        common = np.concatenate([np.frombuffer(zlib.decompress(blobs[i]), dtype=np.uint32) for i in order])[where].astype(np.int64)
        at = 0
        for key, node_id, mine in zip(keys, ids, sets):
            n = len(mine)
            held = common[at : at + n]
            at += n
            first = n - least_overlap(n, num, den) + 1
            ordered = np.lexsort((mine, held))[: min(n, first + MORE_MATCHES - 1)]
            shared = ordered[:first][held[ordered[:first]] > 1]
            if not len(shared):
                continue
            m = matches_needed(held[ordered].astype(np.float64), first)
            made["key"].append(key)
            made["min_id"].append(node_id)
            made["n"].append(n)
            made["need"].append(m)
            made["prefix"].append(mine[ordered[: first + m - 1]].tobytes())
            made["tokens"].append(mine[shared].view(np.int64))
            made["counts"].append(held[shared])
            made["values"].append(mine.tobytes())
    longs = pa.list_(pa.int64())
    kinds = pa.schema([("key", pa.binary()), ("min_id", kind), ("n", pa.int64()), ("need", pa.int32()), ("prefix", pa.binary()), ("tokens", longs), ("counts", longs), ("values", pa.binary())])
    return pa.table({f.name: pa.array(made[f.name], f.type) for f in kinds}, schema=kinds)


# --- pairs ---------------------------------------------------------------------------------------------


def linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the threshold, by exact comparison."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("values").alias("va")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("values").alias("vb")), "b"
    )

    def run(piece):
        keep = []
        for x, y in zip(column(piece, "va").to_pylist(), column(piece, "vb").to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                keep.append(False)
                continue
            shared = np.intersect1d(x, y, assume_unique=True).size
            keep.append(den * shared >= num * (len(x) + len(y) - shared))
        return {"a": column(piece, "a"), "b": column(piece, "b"), "linked": keep}

    return arrow_map(both, run, "va", "a binary, b binary, linked boolean").filter("linked").select("a", "b")


def matches_needed(counts: np.ndarray, first: int) -> int:
    """The number of shared prefix shingles that makes a set's candidates cheapest.

    ``counts`` are the posting-list lengths along the longest prefix. With ``m`` matches the lists of
    ``first + m - 1`` shingles are read, and at most their total over ``m`` candidates are compared.
    """
    total = np.cumsum(counts)
    options = np.arange(1, len(counts) - first + 2)
    read = total[first - 1 :]
    return int(options[np.argmin(read + VERIFY_COST * read / options)])


LIST_ROW = ["token", "mb", "pb", "probe", "key", "label", "n", "need", "prefix"]


def cross_links(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links between groups out of sorted rows of list blocks (token, mb, pb), several blocks in an Arrow batch.

    Rows without their sets (``values``) are only looked through for candidates: what comes out then is the list
    (token) and key of every row that has one. A block that ends with its batch may go on in the next one, so its
    rows wait for it.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        columns = [held.column(c).to_numpy() for c in ("token", "mb", "pb")]
        change = np.zeros(held.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield _block_pairs(held.slice(0, last), cuts[:-1], num, den)
        waiting = held.slice(last).to_batches()
    if waiting:
        yield _block_pairs(pa.Table.from_batches(waiting).combine_chunks(), np.empty(0, dtype=np.int64), num, den)


def _block_pairs(rows: pa.Table, cuts: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    token, n, need = (rows.column(c).to_numpy() for c in ("token", "n", "need"))
    probe = np.array(rows.column("probe").to_pylist(), dtype=bool)
    key, label, blobs = (rows.column(c).to_pylist() for c in ("key", "label", "prefix"))
    sets = rows.column("values").to_pylist() if "values" in rows.column_names else None
    a, b, seen = [], [], set()
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows]):
        members = [i for i in range(low, high) if not probe[i]]
        probes = [i for i in range(low, high) if probe[i]]
        if members and probes and (len(members) > 1 or len(probes) > 1 or key[members[0]] != key[probes[0]]):
            for p, m in _list_links(token[low], members, probes, n, need, label, blobs, sets, num, den):
                if sets is None:
                    seen.update((p, m))
                    continue
                a.append(key[p])
                b.append(key[m])
    if sets is None:
        found = sorted({(int(token[i]), key[i]) for i in seen})
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())], ["token", "key"])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _list_links(token, members, probes, n, need, label, blobs, sets, num: int, den: int):
    """Probes against members of other groups in one block of one posting list.

    A pair is left to the list of its first shared prefix shingle, and is compared in full only with the
    smaller of the two match numbers and an overlap bound that can still reach the threshold. Groups that
    a link has joined need no second link, so a block yields fewer links than it has rows.
    """
    joined: dict[bytes, bytes] = {}

    def group(x: bytes) -> bytes:
        while x in joined:
            x = joined[x]
        return x

    token = np.int64(token).view(np.uint64)
    prefixes = [np.frombuffer(blobs[i], dtype=np.uint64) for i in members]
    lengths = np.array([len(p) for p in prefixes])
    flat, owner = np.concatenate(prefixes), np.repeat(np.arange(len(members)), lengths)
    place = np.argsort(flat, kind="stable")
    flat, owner = flat[place], owner[place]
    sizes, wanted = n[members], need[members]
    rest = sizes - lengths
    for p in probes:
        mine = np.frombuffer(blobs[p], dtype=np.uint64)
        low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        many = high - low
        place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        which = owner[place]
        count = np.bincount(which, minlength=len(members))
        small, large = np.minimum(sizes, n[p]), np.maximum(sizes, n[p])
        bound = np.minimum(count + np.maximum(rest, n[p] - len(mine)), small)
        fits = (count >= np.minimum(wanted, need[p])) & (den * small >= num * large) & ((num + den) * bound >= num * (sizes + n[p]))
        chosen = [i for i in np.flatnonzero(fits).tolist() if label[members[i]] != label[p]]
        if not chosen:
            continue
        first = np.full(len(members), len(mine))
        np.minimum.at(first, which, np.repeat(np.arange(len(mine)), many))
        here = int(np.flatnonzero(mine == token)[0])
        if sets is None:
            yield from ((p, members[i]) for i in chosen if first[i] == here)
            continue
        whole = np.frombuffer(sets[p], dtype=np.uint64)
        for i in chosen:
            one, other = group(label[p]), group(label[members[i]])
            if first[i] == here and one != other:
                shared = np.intersect1d(whole, np.frombuffer(sets[members[i]], dtype=np.uint64), assume_unique=True).size
                if den * shared >= num * (n[p] + sizes[i] - shared):
                    joined[one] = other
                    yield p, members[i]


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = 3,
    num: int = 90,
    den: int = 100,
    bucket_bytes: int = BUCKET_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Set size and component of every row: (id, n_shingles, component_id).

    Sets hold distinct shingles of ``size`` words, or the whole sequence of a shorter text; rows link when
    ``den * intersection >= num * union``. The component is the smallest id reachable. Null and wordless
    texts have an empty set, link with nothing and are their own component. Rows with equal sets are one
    node, so ties, repeated rows and hot groups of copies add no pairs. A row without an id takes the
    component of rows with an equal set and is not compared otherwise. Other columns are not read; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    shinglers: list[Shingler] = []

    def keys(piece):
        if not shinglers:
            shinglers.append(Shingler(size))
        sets = list(shinglers[0].sets_of(column(piece, "_text").to_pylist()))
        return {
            "id": column(piece, "_id"), "n": [len(v) for v in sets],
            "key": [set_key(v) if len(v) else None for v in sets], "bytes": column(piece, "_size"),
        }

    sized = docs.withColumn("_size", F.octet_length("_text").cast("bigint"))
    rows = materialize(arrow_map(sized, keys, "_text", f"id {kind}, n bigint, key binary, bytes bigint"), "set-keys")
    nodes = materialize(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("min_id")), "nodes")
    live = materialize(_live(docs, nodes, rows, size, num, den, bucket_bytes, shard_bytes), "live-nodes")
    sets = live.select("key", "values")
    lists = materialize(
        live.select("key", "min_id", F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        .select("key", "min_id", F.col("t.tokens").alias("token"), F.col("t.counts").alias("c")),
        "lists",
    )

    # One centre for the nodes that share their most common prefix shingle.
    chosen = materialize(
        lists.groupBy("key").agg(F.max(F.struct("c", "token", "min_id")).alias("s")).select("key", "s.token", "s.min_id"), "chosen"
    )
    centres = materialize(
        chosen.groupBy("token").agg(F.min(F.struct("min_id", "key")).alias("s")).select("token", F.col("s.key").alias("b")), "centres"
    )
    stars = chosen.select("token", F.col("key").alias("a")).join(centres, "token").filter("a <> b").select("a", "b")
    star_links = materialize(linked_pairs(stars, sets, num, den), "star-links")

    # Pairs across the groups so far, list by list.
    groups = star_links.select(F.col("a").alias("key"), F.col("b").alias("label"))
    labelled = materialize(
        lists.join(groups, "key", "left").select("token", "key", "c", F.coalesce("label", "key").alias("label")), "labelled"
    )
    sizes = labelled.groupBy("token", "label").agg(
        F.count(F.lit(1)).alias("m"), F.max("c").alias("c"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    mixed = materialize(
        sizes.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("members"),
            F.max("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        )
        .filter("labels > 1")
        .select("token", F.col("top.label").alias("main"), "members", (F.col("members") - F.col("top.m")).alias("probes"), "c", "x", "y")
        # Of lists with the same members only the first in the order of shingles can hold a pair's first one.
        .groupBy("x", "y", "members")
        .agg(F.min(F.struct("c", F.col("token").bitwiseXOR(F.lit(-(2**63))).alias("place"), "token", "main", "probes")).alias("s"))
        .select("s.token", "s.main", "members", "s.probes"),
        "mixed-lists",
    )
    in_lists = labelled.drop("c").join(mixed, "token")
    blocks = lambda of: F.ceil(F.col(of) / F.lit(BLOCK)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), blocks(of) - 1))
    own = lambda of: F.pmod(F.hash("key"), blocks(of))

    def in_blocks(rows: DataFrame, sets: list[str]) -> DataFrame:
        """Rows of list blocks: a member meets every block of probes, a probe every block of members."""
        known = rows.join(live.select("key", "n", "need", "prefix", *sets), "key")
        fields = ["token", "key", "label", "n", "need", "prefix", *sets]
        members = known.select(*fields, own("members").alias("mb"), every("probes").alias("pb"), F.lit(False).alias("probe"))
        probes = known.filter("label <> main").select(*fields, every("members").alias("mb"), own("probes").alias("pb"), F.lit(True).alias("probe"))
        return (
            members.unionByName(probes).select(*LIST_ROW, *sets).repartition("token", "mb", "pb").sortWithinPartitions("token", "mb", "pb")
        )

    # Prefixes alone tell which rows have a candidate; only those bring their sets.
    promising = in_blocks(in_lists, []).mapInArrow(lambda batches: cross_links(batches, num, den), "token bigint, key binary")
    promising = materialize(promising.distinct(), "promising")
    across = in_blocks(in_lists.join(promising, ["token", "key"], "left_semi"), ["values"]).mapInArrow(
        lambda batches: cross_links(batches, num, den), "a binary, b binary"
    )
    parts = connected_components(star_links.union(across))
    named = parts.join(nodes.select(F.col("key").alias("node"), "min_id"), "node")
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    linked = named.join(least, "root").select(F.col("node").alias("key"), "component_id")
    answer = materialize(
        nodes.join(linked, "key", "left").select("key", F.coalesce("component_id", "min_id").alias("component_id")), "answer"
    )
    return rows.join(answer, "key", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _live(docs, nodes, rows, size, num, den, bucket_bytes, shard_bytes) -> DataFrame:
    """Live nodes with their prefixes and sets; the text is shuffled once, by bucket of its id.

    Nodes are represented by the text of their smallest id, so rows without an id have nothing to bring and stay out.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n_buckets, n_shards = max(1, math.ceil(total / bucket_bytes)), max(1, math.ceil(total / shard_bytes))
    # Shingles are counted by so many leading bits that chance equals are about one in a thousand.
    bits = min(64, max(32, total.bit_length() + 10))
    id_kind = docs.schema["_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(id_kind)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n_buckets).cast("bigint"))
    spread = docs.filter("_id IS NOT NULL").withColumn("_bucket", bucket("_id")).groupBy("_bucket")
    node_rows = nodes.filter("min_id IS NOT NULL").select(
        bucket("min_id").alias("_bucket"), F.col("min_id").alias("_id"), F.col("key").alias("_key"),
        F.lit(None).cast("bigint").alias("_shard"), F.lit(None).cast("binary").alias("counts"),
    )
    listed = spread.cogroup(node_rows.groupBy("_bucket")).applyInArrow(lambda d, n: list_shingles(d, n, size, n_shards, bits), LISTS)
    answers = listed.groupBy("_shard").applyInArrow(count_shingles, ANSWERS)
    both = node_rows.unionByName(answers.select("_bucket", F.lit(None).cast(id_kind).alias("_id"), F.lit(None).cast("binary").alias("_key"), "_shard", "counts"))
    return spread.cogroup(both.groupBy("_bucket")).applyInArrow(
        lambda d, b: live_nodes(d, b, size, n_shards, bits, num, den, arrow_kind), LIVE.format(kind=id_kind.simpleString())
    )


def _named(docs: DataFrame, id_column: str, text: str, name: str) -> DataFrame:
    """``docs`` with every id as ``name``; texts without an id get names past the greatest id, in the order of their hashes."""
    lost = docs.filter(docs[id_column].isNull())
    if lost.isEmpty():
        return docs.withColumn(name, F.col(id_column))
    integral = isinstance(docs.schema[id_column].dataType, IntegralType)
    if not integral and not isinstance(docs.schema[id_column].dataType, StringType):
        raise TypeError(f"rows without an id need ids that are integers or strings: {id_column}")
    (sha,) = free_names(docs, "_sha")
    hashed = lost.withColumn(sha, F.sha2(normalized(F.col(text)), 256))
    ranked = with_rank(hashed.select(sha).distinct(), [sha])
    greatest = docs.agg(F.max(id_column)).first()[0]
    if integral:
        past = F.lit(-1 if greatest is None else greatest).cast("bigint") + 1 + F.col("row_rank")
    else:
        past = F.concat(F.lit(greatest or ""), F.lit("~"), F.lpad(F.col("row_rank").cast("string"), 20, "0"))
    # A text delivered many times without an id is one row by now (drop_repeats), so no key is hot.
    named = hashed.join(ranked.select(sha, past.alias(name)), sha).drop(sha)
    kind = "bigint" if integral else "string"
    return docs.filter(docs[id_column].isNotNull()).withColumn(name, F.col(id_column).cast(kind)).unionByName(named)


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with the document of smallest id of each component; columns are unchanged.

    Rows that repeat an id and its text are one document. Documents without an id come after all others;
    where a component has none with an id, the one of smallest text hash stays.
    """
    (name,) = free_names(docs, "_name")
    named = _named(drop_repeats(docs, id_column, text), id_column, text, name)
    found = jaccard_components(named, name, text, size, num, den)
    gone = found.filter(F.col(name) != F.col("component_id")).select(F.col(name).alias("_gone")).distinct()
    return named.join(gone, named[name] == gone["_gone"], "left_anti").select(*[named[c] for c in docs.columns])
