"""Exact copies, repeated passages and near copies against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from rowtide.llm import components, decontaminate, exact, jaccard, suffix_dedup
from rowtide.llm.induced_sort import SuffixQueue, sort_suffixes


def brute_exact(by_id):
    norm = {d: re.sub("[\x20\x09-\x0D]+", " ", t or "") for d, t in by_id.items()}
    size, least = Counter(norm.values()), {}
    for d in sorted(norm):
        least.setdefault(norm[d], d)
    return {
        d: (least[t], size[t], least[t] == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()
    }


def test_exact_dedup(docs, by_id):
    rows = exact.exact_dedup(docs).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows}
    assert len(rows) == len(by_id) and got == brute_exact(by_id)


def test_exact_dedup_edge_cases(spark, docs, no_docs):
    assert exact.exact_dedup(no_docs).collect() == []
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z"), (3, "b"), (3, "a")], "doc_id bigint, text string")
    got = sorted(map(tuple, exact.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted(
        [(1, 1, 4, True), (1, 1, 4, True), (None, 1, 4, False), (None, None, 1, True), (3, 3, 1, True), (3, 1, 4, False)], key=str
    )
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in exact.exact_dedup(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in left.collect()} == kept
    assert sorted(map(tuple, exact.drop_copies(rows).collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, "z"), (3, "b")], key=str)


def test_one_row_of_each_document_stays(spark, docs):
    """Documents delivered twice under an id, and groups without any id, leave one row in both dedup stages."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a", "x"), (1, " a".strip(), "w"), (None, "a", "x"), (None, "z", "x"), (None, "z", "x"), (3, "b", "x"), (3, "a", "x"),
            (5, long, "x"), (5, long, "x"), (None, long + " v", "x"), (7, long + " u", "x"), (None, "q " * 3, "x"), (None, "q  " * 3, "x")]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = corpus_pipeline.drop_exact_copies(spark, many, "")
    got = sorted(((r["doc_id"], r["text"].split()[0], r["lang"]) for r in left.collect()), key=str)
    assert got == sorted([(1, "a", "w"), (None, "z", "x"), (3, "b", "x"), (5, "w0", "x"), (None, "w0", "x"), (7, "w0", "x"), (None, "q", "x")], key=str)
    for kind in ("bigint", "string", "int"):
        near = corpus_pipeline.drop_near_copies(spark, many.withColumn("doc_id", many.doc_id.cast(kind)), "")
        assert near.columns == many.columns and near.schema["doc_id"].dataType.simpleString() == kind
        found = [(str(r["doc_id"]), r["text"]) for r in near.collect()]
        assert len(found) == len(set(found)) and [d for d, t in found if t.startswith("w0")] == ["5"]
        assert sorted(d for d, t in found if t == "z") == ["None"]
    # Near copies none of which has an id: one stays.
    lost = spark.createDataFrame([(None, long), (None, long + " v"), (None, long)], "doc_id bigint, text string")
    assert corpus_pipeline.drop_near_copies(spark, lost, "").count() == 1
    assert sorted(r["doc_id"] for r in exact.drop_repeats(docs).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_exact_dedup_is_native(docs):
    plan = exact.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_order(text, cap):
    data = text.tobytes()
    order = sorted(range(len(data)), key=lambda i: data[i:])
    common = [0] * len(data)
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :], data[order[k] :]
        while common[k] < min(len(a), len(b), cap) and a[common[k]] == b[common[k]]:
            common[k] += 1
    return order, common


@pytest.mark.parametrize("bounds", [{}, {"memory_items": 3}, {"base_items": 1}, {"memory_items": 3, "base_items": 1}])
def test_induced_sorting(bounds):
    pick = np.random.default_rng(4)
    for _ in range(250):
        text = pick.integers(0, pick.choice([2, 3, 30]), pick.integers(0, 60)).astype(np.uint8)
        if pick.random() < 0.4 and len(text) > 3:
            text = np.resize(text[: pick.integers(1, len(text))], len(text))
        cap = int(pick.choice([5, 50, 255]))
        order, common = sort_suffixes(text, cap, **bounds)
        assert (order.tolist(), common.tolist()) == brute_order(text, cap)


def test_queue_goes_to_disk_and_keeps_order():
    queue = SuffixQueue(4)
    for k in range(5):
        queue.push(7, np.arange(3 * k, 3 * k + 3, dtype=np.int32), np.full(3, k, dtype=np.uint8))
    assert queue.file is not None
    taken = list(queue.take(7))
    assert np.concatenate([p for p, _ in taken]).tolist() == list(range(15))
    queue.close()


def brute_repeats(by_id, width):
    data = {d: (t or "").encode() for d, t in by_id.items()}
    first = {}
    for d in sorted(data):
        for k in range(len(data[d]) - width + 1):
            first.setdefault(data[d][k : k + width], d)
    out = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < d:
                gone[k : k + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("bounds", [{}, {"bucket_bytes": 9000, "shard_bytes": 9000}, {"bucket_bytes": 9000, "shard_bytes": 9000, "hot": 3}])
def test_suffix_dedup(docs, by_id, bounds):
    rows = suffix_dedup.remove_repeats(docs, **bounds).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    want = brute_repeats(by_id, 50)
    assert len(rows) == len(by_id) and got == want and sum(w[1] for w in want.values()) > 1000


def test_suffix_dedup_edge_cases(spark, no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []
    text = "q" * 20 + "abcdefghij" * 8
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (9, "-" + text)], "doc_id bigint, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(rows).select("doc_id", "n_removed").collect()), key=str)
    assert got == sorted([(5, 0), (5, 0), (None, 0), (9, 100)], key=str)
    row = suffix_dedup.remove_repeats(rows).filter("doc_id is null").first()
    assert (row["n_bytes"], row["n_spans"], row["kept_sha256"], row["spans"]) == (100, 0, hashlib.sha256(text.encode()).hexdigest(), "")


@pytest.mark.parametrize("bounds", [{}, {"bucket_bytes": 300, "shard_bytes": 300}])
def test_suffix_dedup_of_one_id_with_two_texts(spark, bounds):
    """Each row loses what is found in its own text, and rows of one id leave each other alone."""
    pick = np.random.default_rng(3)
    a, b, c = ("".join(map(chr, pick.integers(97, 123, 120))) for _ in range(3))
    texts = [(1, a), (5, a + "xyz"), (5, b), (5, a[20:] + b), (5, a + "xyz"), (7, c + b), (7, c), (None, a), (8, None), (9, "")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(rows, **bounds).select("doc_id", "n_bytes", "n_removed", "spans").collect()
    want = [(1, 120, 0, ""), (5, 123, 120, "0:120"), (5, 120, 0, ""), (5, 220, 100, "0:100"), (5, 123, 120, "0:120"),
            (7, 240, 120, "120:240"), (7, 120, 0, ""), (None, 120, 0, ""), (8, 0, 0, ""), (9, 0, 0, "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shard_sorts_on_disk_at_the_registered_bounds(monkeypatch):
    """A repeated stretch of 400 KB among unique text goes through queues on disk; ids as by a dict of strings."""
    pick = np.random.default_rng(5)
    text = pick.integers(97, 123, 1_200_000, dtype=np.uint8)
    text[700_013:1_100_013] = text[100_000:500_000]
    ids = np.repeat(np.array([4, 9]), 600_000)
    is_start = np.ones(len(text), dtype=bool)
    is_start[600_000 - 49 : 600_000] = is_start[-49:] = False
    files = []
    close = SuffixQueue.close
    monkeypatch.setattr(SuffixQueue, "close", lambda queue: (files.append(queue.end), close(queue)))
    got = suffix_dedup.least_ids(text, is_start, ids, 50)
    assert sum(files) > 0
    data, first = text.tobytes(), {}
    for k in np.flatnonzero(is_start).tolist():
        first.setdefault(data[k : k + 50], 4 if k < 600_000 else 9)
    want = [first[data[k : k + 50]] for k in np.flatnonzero(is_start).tolist()]
    assert got[is_start].tolist() == want and want.count(4) == 600_000 - 49 + 400_000 - 49


def brute_components(by_id, size, num, den):
    word = re.compile("[^\x20\x09-\x0D]+")
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in by_id.items():
        w = word.findall((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1))))
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(docs, by_id, size, num, den):
    rows = jaccard.jaccard_components(docs, size=size, num=num, den=den, bucket_bytes=9000, shard_bytes=9000).collect()
    want = brute_components(by_id, size, num, den)
    assert len(rows) == len(by_id)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert any(d != c for d, (_, c) in want.items())


def test_near_copies_of_a_hot_group(spark, monkeypatch):
    """Many near copies that link through few centres; small blocks force several per posting list."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    pick = np.random.default_rng(8)
    texts = {}
    for d in range(60):
        words = list(base)
        for k in pick.choice(60, size=int(pick.integers(0, 3)), replace=False):
            words[k] = f"v{int(pick.integers(0, 4))}"
        texts[d] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(rows, size=3, num=85, den=100).collect()}
    assert got == brute_components(texts, 3, 85, 100)


def test_jaccard_edge_cases(spark, docs, no_docs):
    assert jaccard.jaccard_components(no_docs).collect() == []
    rows = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "A  b c"), (7, "a b c"), (8, None), (2, "a b")], "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(4, 1, 4), (4, 1, 4), (None, 1, 4), (7, 1, 4), (8, 0, 8), (2, 1, 2)], key=str)
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() < docs.count()


def test_components(spark):
    pick = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in pick.integers(0, 40, (25, 2))] + [(100 + i, 101 + i) for i in range(12)] + [(200, k) for k in range(201, 230)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    for node in around:
        seen, todo = {node}, [node]
        while todo:
            for x in around[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[node] == min(seen)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_jaccard_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    alone = [f"x{i}" for i in range(40)]
    listed = [(5, base), (3, near), (9, alone)] + [(None, base)] * 40 + [(None, near)] * 40 + [(None, [f"y{i}" for i in range(30)])] * 40
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in listed], "doc_id bigint, text string")
    found = jaccard.jaccard_components(docs, bucket_bytes=1000).collect()
    with_id = {(r.doc_id, r.component_id) for r in found if r.doc_id is not None}
    assert with_id == {(5, 3), (3, 3), (9, 9)}
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["3"] * 80 + ["None"] * 40


def test_benchmark_blocks_are_built_one_at_a_time(spark):
    items = spark.createDataFrame([(str(i), f"item {i} has words") for i in range(40)], "item_id string, text string")
    blocks = decontaminate.benchmark_blocks(items, "item_id", "text", block_bytes=100)
    assert iter(blocks) is blocks
    names = [name for block in blocks for name in block.names]
    assert sorted(names) == sorted(str(i) for i in range(40))
