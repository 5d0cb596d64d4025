"""Manifest proofs, shards and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from rowtide.llm import infilling, merkle, sharding

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_proofs(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of rows in the order of FIELDS, level by level."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(show, r)))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(digests):
        """The root, and of each member its steps (left siblings, right siblings)."""
        ways, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for run in runs:
                for at, (_, below) in enumerate(run):
                    for i in below:
                        ways[i].append(("".join(d for d, _ in run[:at]), "".join(d for d, _ in run[at + 1 :])))
            nodes = [(sha("".join(d for d, _ in run)), [i for _, b in run for i in b]) for run in runs]
        return nodes[0][0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for name in names:
        held = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((held, *tree([leaf(r) for r in held])))
    root, above = tree([top for _, top, _ in made])
    out = []
    for (held, top, ways), up in zip(made, above):
        for r, way in zip(held, ways):
            way = way + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], low(r[4]))) if tampered else leaf(r)
            for left, right in way:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), top, root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, idx string, level int"


def proofs_of(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, merkle.document_manifest(df).collect()), key=str)


def test_manifest(spark):
    pick = random.Random(5)
    texts = ["", None, "Abc é 漢", "LOUD " * 3000, "quiet", "x"]
    rows = [(i, pick.choice(["hot", "hot", "hot", "b"]), pick.choice(["en", None]), pick.choice([None, 3]), pick.choice(texts)) for i in range(700)]
    rows += [(900 + i, f"s{i:02}é", "de", 1, "One") for i in range(25)]  # a row for each of many sources
    rows += [(5, None, None, None, None), (None, "hot", "en", 1, "T"), (None, "hot", "en", 1, "T"), (7, "hot", "en", 2, "again")]
    rows += [rows[3], rows[3], (1001, "", "en", 1, "empty source")]
    got = proofs_of(spark, rows)
    assert got == plain_proofs(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (17, 1), (17, 17)])
def test_manifest_of_few_rows(spark, n, sources):
    rows = [(i * 3, f"s{i % sources}", "en", i, f"Text {i}") for i in range(n)]
    assert proofs_of(spark, rows, 2) == plain_proofs(rows)


def test_manifest_of_no_rows(spark):
    assert proofs_of(spark, []) == []


def test_deep_tree_is_jumped_with_salts(spark):
    """Deep enough for a third doubling, where an ancestor is met by its 16**4 descendants in salted parts."""
    pointers = spark.range(16**2 + 1).select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(1).alias("level"), F.col("id").alias("idx"),
        F.lit(0).cast("bigint").alias("a_tree"), F.lit(2).alias("a_level"), F.expr("id DIV 16").alias("a_idx"),
    )
    rows = pointers
    size, level = 16**2 + 1, 1
    while size > 1 or level < 7:
        size, level = max(1, -(-size // 16)), level + 1
        rows = rows.unionByName(
            spark.range(size).select(
                F.lit(0).cast("bigint").alias("tree"), F.lit(level).alias("level"), F.col("id").alias("idx"),
                F.lit(None if level == 7 else 0).cast("bigint").alias("a_tree"),
                F.lit(None if level == 7 else level + 1).cast("int").alias("a_level"),
                (F.lit(None).cast("bigint") if level == 7 else F.expr("id DIV 16")).alias("a_idx"),
            )
        )
    name = F.when(F.col("a_level").isNull(), F.array().cast(merkle._SEGMENT)).otherwise(
        F.array(F.struct(F.concat_ws(".", "level", "idx").cast("binary").alias("left"), F.lit(b"").alias("right")))
    )
    whole = merkle._jump(rows.withColumns({"segment": name, "subroot": F.lit(b"r")}), 6)
    got = {(r["level"], r["idx"]): (r["a_level"], [bytes(s["left"]).decode() for s in r["segment"]]) for r in whole.collect()}
    assert len(got) == rows.count()
    for (level, idx), (above, way) in got.items():
        want = []
        while level < 7:
            want.append(f"{level}.{idx}")
            level, idx = level + 1, idx // 16
        assert above is None and way == want


def test_proofs_are_paths(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"t{i}", "", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.prove(docs, FIELDS)
    folded = found.select(merkle.fold_path(F.col("leaf"), F.col("path")).alias("f"), F.lower(F.hex("root")).alias("r"), "claim").collect()
    assert all(r["f"] == r["r"] and r["claim"] is None for r in folded)


# --- shards -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_permutation_is_one_and_undone(spark, n):
    size = F.lit(n).cast("bigint")
    rows = spark.range(n).select("id", sharding.place_of(F.col("id"), size).alias("p"))
    got = rows.select("id", "p", sharding.row_at(F.col("p"), size).alias("back")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)
    if n == 1000:
        other = {r["id"]: r["q"] for r in spark.range(n).select("id", sharding.place_of(F.col("id"), size, 1).alias("q")).collect()}
        moved = sum(r["p"] != r["id"] for r in got)
        assert moved > 950 and sum(other[r["id"]] != r["p"] for r in got) > 950
        near = sum(abs(r["p"] - s["p"]) < 20 for r, s in zip(got, got[1:]))
        assert near < 100  # neighbours part


def test_permutation_of_a_large_range(spark):
    n = 50_000_000_000
    size = F.lit(n).cast("bigint")
    ids = spark.range(2000).select((F.col("id") * 24_999_999 + 7).alias("id"))
    got = ids.select("id", sharding.place_of(F.col("id"), size).alias("p")).select("*", sharding.row_at(F.col("p"), size).alias("back")).collect()
    assert all(0 <= r["p"] < n and r["back"] == r["id"] for r in got)
    assert len({r["p"] for r in got}) == 2000
    assert 700 < sum(r["p"] < n // 2 for r in got) < 1300


def test_document_shards(spark, docs, by_id, no_docs):
    df = sharding.shard_documents(docs.withColumn("_size", F.lit("clash")).withColumn("shard", F.lit(9)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == len(by_id) and df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for r in rows:
        data = (by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert sharding.shard_documents(no_docs).collect() == []


def test_shards_of_repeated_and_missing_ids(spark):
    rows = [(None, "a"), (None, None), (1, "a"), (1, "a"), (1, "b"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (sorted(map(tuple, sharding.shard_documents(d, shards=3).collect()), key=str) for d in (df, df.orderBy(F.desc("text")).repartition(2)))
    assert one == two and len(one) == 7
    assert Counter(r[4] for r in one) == {0: 3, 1: 2, 2: 2}


def test_written_shards(spark, docs, tmp_path):
    placed = sharding.with_shards(docs.select("doc_id", "text"), ["doc_id"], 4)
    sharding.write_shards(placed, f"{tmp_path}/shards", 6)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(tuple, back.select(*placed.columns).collect()), key=str) == sorted(map(tuple, placed.collect()), key=str)
    import glob

    import pyarrow.parquet as pq

    for shard in range(4):
        slots = [s for f in sorted(glob.glob(f"{tmp_path}/shards/shard={shard}/*.parquet")) for s in pq.read_table(f)["slot"].to_pylist()]
        assert slots == list(range(len(slots)))


# --- fill in the middle -------------------------------------------------------------------


def plain_infill(doc_id, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    drawn = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), sha(out), sha(text), out)


ODD = ["a\nb\nc", "a\nb\n", "\n", "\n\n\n", "no end", "é\n漢字🙂\nz" * 9, "x <P> y\nz", "<M", "<\nP>", "a<S>", "line\r\nline\x0b\x85 x\n", "long " * 9000, "l\n" * 9000, None, ""]


@pytest.mark.parametrize("frame", [7, 64, 1 << 16])
def test_infill(spark, frame):
    rows = [(i, t, "clash", "n", 5) for i, t in enumerate(ODD * 3)] + [(None, "a\nb\nc\n", "", "", 0), (None, "a\nb\nc\n", "", "", 0), (2, "other\ntext", "", "", 0)]
    rows = [r for r in rows if frame > 7 or len(r[1] or "") < 9000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, frames string, _id int").repartition(3)
    stored = infilling.store_frames(df, frame_bytes=frame)
    assert "frames_" in stored.columns and "text" not in stored.columns
    got = infilling.fill_in_middle(stored, render=True)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_infill(r[0], r[1]) for r in rows), key=str)
    assert infilling.fill_in_middle(infilling.store_frames(df.limit(0))).collect() == []


def test_infill_shares(spark, docs, by_id):
    stored = infilling.store_frames(docs.select("doc_id", "text"))
    for fim, spm in ((0, 50), (60, 0), (100, 100)):
        got = infilling.fill_in_middle(stored, fim_share=fim, spm_share=spm, render=True).collect()
        assert sorted(map(tuple, got), key=str) == sorted((plain_infill(d, t, fim, spm) for d, t in by_id.items()), key=str)


def test_cuts_read_one_frame_each():
    """Placing a cut decompresses the frame that holds it, not the text; all frames together are one zstandard file."""
    text = "".join(f"line {i} é\n" for i in range(20_000)) + "end"
    held = infilling.pack(text, 1 << 12)
    assert len(held["frame_index"]) > 50
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(held["frames"])
    assert whole.decode() == text and held["n"] == 20_001
    units = text.splitlines(keepends=True)
    for k in (0, 1, 777, 19_999, 20_000):
        packed, read = infilling.Packed(held["frames"], held["frame_index"], held["n"]), []
        plain_read = packed._read
        packed._read = lambda i: read.append(i) or plain_read(i)
        before = "".join(units[:k])
        assert packed.cut(k) == (len(before.encode()), len(before)) and len(read) <= 1
    assert infilling.Packed(held["frames"], held["frame_index"], held["n"]).cut(20_001) == (None, None)
