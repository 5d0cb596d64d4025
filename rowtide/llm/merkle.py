"""Merkle manifest of a table: one tree a group, one tree over the groups, proofs by pointer jumping.

Nodes are known by (tree, level, idx). Leaves are numbered inside their group, every FANOUT consecutive nodes
form a run, and a run's digest is its parent. Trees of groups are numbered from 0; the tree over their roots is
TOP, and the root of tree ``t`` is node (TOP, 0, t).

Proofs are found by pointer jumping. Each node starts with the siblings it meets on the step to its parent; a
self-join on "my ancestor" doubles the distance and appends the ancestor's segment to the node's own, until every
node holds the way to the root. Leaves of one run share all but their first step, so the run jumps for them and
the first step is put in front at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.operators.snapshot import with_rank
from rowtide.session import lookup_join, materialize

FANOUT = 16
TOP = -1
# Sub-keys of one ancestor in a self-join, at most.
MAX_SALTS = 1 << 16

_NODE = ["tree", "level", "idx"]
_SEGMENT = "array<struct<left:binary,right:binary>>"


def sized(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """Digest of a row from its values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[sized(v) for v in values]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _height(n: Column) -> Column:
    """Levels above the leaves: how often runs are formed until one node is left."""
    powers = F.array(*[F.lit(FANOUT**k).cast("bigint") for k in range(15)])
    return F.size(F.filter(powers, lambda p: p < n))


def _steps(digests: Column, at: Column) -> Column:
    """The siblings of the run's member ``at`` (0-based): those before it and those after it."""
    return F.struct(
        F.unhex(_joined(F.slice(digests, F.lit(1), at))).alias("left"),
        F.unhex(_joined(F.slice(digests, at + 2, F.lit(FANOUT)))).alias("right"),
    )


def _runs(nodes: DataFrame, level: int, member: list[str]) -> DataFrame:
    """Nodes of ``level`` gathered into runs of at most FANOUT, with the digest of each run."""
    runs = nodes.groupBy("tree", "height", F.expr(f"idx DIV {FANOUT}").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *member))).alias("members")
    )
    return runs.withColumns(
        {"level": F.lit(level + 1), "digest": F.unhex(F.sha2(_joined(F.col("members.digest")), 256))}
    )


def _levels(nodes: DataFrame, level: int, top: int) -> list[DataFrame]:
    """Runs of every level above ``level`` up to ``top``, each written once; every level is a sixteenth of the last."""
    made = []
    while level < top:
        runs = materialize(_runs(nodes.filter(F.col("height") > level), level, ["digest"]), "merkle-level")
        made.append(runs)
        nodes, level = runs, level + 1
    return made


def _known_as(tree: str = "tree", level: str = "level", idx: str = "idx") -> list[Column]:
    """Key of a node: the root of a group's tree is known as a leaf of the tree over the groups."""
    is_root = (F.col("tree") != TOP) & (F.col(level) == F.col("height"))
    return [
        F.when(is_root, F.lit(TOP).cast("bigint")).otherwise(F.col(tree)).alias("tree"),
        F.when(is_root, F.lit(0)).otherwise(F.col(level)).alias("level"),
        F.when(is_root, F.col(tree)).otherwise(F.col(idx)).alias("idx"),
    ]


def _pointers(runs: list[DataFrame], root: DataFrame) -> DataFrame:
    """Every node above the leaves with its parent and the siblings it meets there; the root has neither."""
    ends = root.select(
        *_NODE,
        *[F.lit(None).cast(kind).alias(f"a_{c}") for c, kind in zip(_NODE, ("bigint", "int", "bigint"))],
        F.array().cast(_SEGMENT).alias("segment"),
        F.when(F.col("level") == 0, F.col("digest")).alias("subroot"),
    )
    for level in runs:
        inside = level.select("tree", "level", "height", "idx", "members", F.posexplode("members").alias("at", "member"))
        parent = [c.alias(f"a_{name}") for c, name in zip(_known_as(), _NODE)]
        ends = ends.unionByName(
            inside.select(
                "tree",
                (F.col("level") - 1).alias("level"),
                F.col("member.idx").alias("idx"),
                *parent,
                F.array(_steps(F.col("members.digest"), F.col("at"))).alias("segment"),
                F.when((F.col("tree") == TOP) & (F.col("level") == 1), F.col("member.digest")).alias("subroot"),
            )
        )
    return ends


def _jump(pointers: DataFrame, longest: int) -> DataFrame:
    """Double the distance until every node points past the root and holds the whole way to it.

    At distance d an ancestor serves up to FANOUT**d nodes. It is repeated for sub-keys so that one key meets a
    few hundred of them; ancestors that far up are so few that the copies stay a small part of the table.
    """
    pointers = materialize(pointers, "merkle-pointers")
    distance = 1
    while distance <= longest:
        salts = min(FANOUT ** max(0, distance - 2), MAX_SALTS)
        far = pointers.filter((F.col("tree") == TOP) | (F.col("level") > distance)).select(
            *[F.col(c).alias(f"a_{c}") for c in _NODE],
            *[F.col(f"a_{c}").alias(f"b_{c}") for c in _NODE],
            F.col("segment").alias("more"),
            F.col("subroot").alias("far_subroot"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"),
        )
        there = pointers.filter("a_level IS NULL")
        joined = (
            pointers.filter("a_level IS NOT NULL")
            .withColumn("salt", F.pmod("idx", F.lit(salts)))
            .join(far, [*[f"a_{c}" for c in _NODE], "salt"])
            .select(
                *_NODE,
                *[F.col(f"b_{c}").alias(f"a_{c}") for c in _NODE],
                F.concat("segment", "more").alias("segment"),
                F.coalesce("subroot", "far_subroot").alias("subroot"),
            )
        )
        pointers = materialize(there.unionByName(joined), "merkle-pointers")
        distance *= 2
    return pointers


def prove(
    docs: DataFrame,
    fields: list[str],
    id_column: str = "doc_id",
    group: str = "source",
    claim: Column | None = None,
) -> DataFrame:
    """Proof of every row: (id, leaf, claim, subroot, root, path), digests as 32 bytes.

    A leaf is the digest of ``fields`` (:func:`sized`), ascending by id inside its group. ``path`` lists the steps
    from the leaf to the root with the siblings left and right of the way; a step has none where a run has one
    member, and a lone row of a lone group has no step. ``claim`` is a digest to be checked in place of the leaf,
    null for none; it takes no part in the tree.

    Null ids come first, rows with equal ids are ordered by their digest, repeated rows are leaves of their own
    and a null group is a group, ordered first. Texts of any length are hashed where they are read; an empty table has
    no proofs. Other columns are not read, so their names cannot clash.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(group).cast("string").alias("group"),
        row_digest(*[F.col(c) for c in fields]).alias("digest"),
        (claim if claim is not None else F.lit(None).cast("binary")).alias("claim"),
    )
    ranked = with_rank(rows, ["group", "id", "digest"]).drop("n_total")
    groups = ranked.groupBy("group").agg(F.min("row_rank").alias("start"), F.count(F.lit(1)).alias("n"))
    trees = with_rank(groups, ["group"]).select(
        "group", "start", F.col("row_rank").alias("tree"), _height(F.col("n")).alias("height")
    )
    highest, n_trees = trees.agg(F.max("height"), F.count(F.lit(1))).first()
    no_null = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    leaves = (
        lookup_join(
            ranked.withColumn("key", no_null), trees.withColumn("key", no_null).drop("group"), ["key"], "inner", spread=["row_rank"]
        )
        .withColumn("idx", F.col("row_rank") - F.col("start"))
        .select("tree", "height", "idx", "id", "digest", "claim")
    )
    # A row that is alone in its group is that group's root: a run without a digest of its own.
    lone = leaves.filter("height = 0").select(
        "tree", "height", F.lit(0).cast("bigint").alias("idx"), F.array(F.struct("idx", "digest", "id", "claim")).alias("members"),
        F.lit(0).alias("level"), "digest",
    )
    first = _runs(leaves.filter("height > 0"), 0, ["digest", "id", "claim"])
    first = materialize(first.unionByName(lone), "merkle-runs")
    upper = _levels(first.filter("level = 1").drop("members"), 1, highest or 0)
    roots = first.select("tree", "level", "height", "digest")
    for runs in upper:
        roots = roots.unionByName(runs.select("tree", "level", "height", "digest"))
    n_levels = sum(1 for k in range(15) if FANOUT**k < n_trees)
    tops = materialize(
        roots.filter("level = height").select(
            F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.lit(n_levels).alias("height"),
            F.col("tree").alias("idx"), "digest",
        ),
        "merkle-tops",
    )
    over = _levels(tops, 0, n_levels)
    root = (over[-1] if over else tops).select(*_NODE, "digest")
    ways = _jump(_pointers([*upper, *over], root), max(0, (highest or 0) - 1) + n_levels)
    found = first.select(*_known_as(), "members", F.col("level").alias("own")).join(
        ways.select(*_NODE, "segment", "subroot"), _NODE
    )
    out = found.select("members", "own", "segment", "subroot", F.posexplode("members").alias("at", "member"))
    step = F.array(_steps(F.col("members.digest"), F.col("at")))
    # One digest, read from the topmost level.
    top = root.select("digest").first()
    return out.select(
        F.col("member.id").alias("id"),
        F.col("member.digest").alias("leaf"),
        F.col("member.claim").alias("claim"),
        "subroot",
        F.lit(bytes(top[0]) if top else None).cast("binary").alias("root"),
        F.when(F.col("own") == 0, F.col("segment")).otherwise(F.concat(step, "segment")).alias("path"),
    )


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to, as hex text."""
    return F.aggregate(
        path, _hex(leaf), lambda held, s: F.sha2(F.concat(_hex(s["left"]), held, _hex(s["right"])), 256)
    )


def path_digest(path: Column) -> Column:
    """Digest over all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED_EVERY = 5


def tampered_leaf(every: int = TAMPERED_EVERY) -> Column:
    """Leaf of a document whose A-Z were lower-cased, for ids whose checksum ``every`` divides; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(chosen, row_digest(*[lowered if c == "text" else F.col(c) for c in FIELDS]))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The proofs of ``documents`` checked against tampered rows: see ``op11_merkle_manifest``."""
    proofs = prove(docs, FIELDS, claim=tampered_leaf())
    folded = fold_path(F.coalesce("claim", "leaf"), F.col("path"))
    return proofs.select(
        F.col("id").alias("doc_id"),
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
