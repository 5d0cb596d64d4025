"""Preference formatting against a plain model; the pipeline's stages against the operators' definitions."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowtide.llm import chat
from tests_llm_brute import brute_components, brute_exact, brute_hits


def plain_pair(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    prompt = show(chosen[:k])

    def spans(turns):
        at, out = len(prompt), []
        for role, text in turns:
            start = at + len(f"<|im_start|>{role}\n")
            if role == "assistant":
                out.append(f"{start}:{start + len(text) + len('<|im_end|>')}")
            at += len(show([(role, text)]))
        return ",".join(out)

    return (k, prompt, show(chosen[k:]), show(rejected[k:]), spans(chosen[k:]), spans(rejected[k:]))


def test_preferences(spark):
    pick = random.Random(4)
    pairs = []
    for i in range(60):
        turns = lambda n: [(pick.choice(["user", "assistant"]), pick.choice(["", "a", "é🙂", "b\nc"])) for _ in range(n)]
        shared = turns(pick.randint(0, 3))
        pairs.append((i // 2, shared + turns(pick.randint(0, 3)), shared + turns(pick.randint(0, 3)), "clash"))
    pairs.append((99, None, [("user", "x")], "clash"))
    schema = "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    df = chat.format_preferences(spark.createDataFrame(pairs, schema))
    assert sorted(map(tuple, df.collect())) == sorted((i, *plain_pair(c or [], r or [])) for i, c, r, _ in pairs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_preferences(spark.createDataFrame([], schema)).collect() == []


def test_reply_pairs(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "q"), (1, 2, "user", "more"), (2, 0, None, None), (2, 0, "assistant", "yo"), (3, 0, "user", "z"),
            (None, 0, "user", "lost"), (4, 1, "assistant", "hi"), (4, 0, "user", "q"), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: ([tuple(t) for t in r["chosen"]], [tuple(t) for t in r["rejected"]]) for r in chat.next_reply_pairs(turns).collect()}
    assert got == {
        1: ([("user", "q"), ("assistant", "hi")], [("user", "q"), ("assistant", "yo")]),
        2: ([("assistant", "yo")], [("assistant", "hi")]),
        4: ([("user", "q"), ("assistant", "hi")], [("user", "q"), ("assistant", "hi")]),
    }


def test_next_reply_pairs_bridge_gaps(spark):
    """Sparse ids, neighbours without a reply and the last id all get another conversation's reply."""
    rows = [(10, 0, "user", "q"), (10, 1, "assistant", "a"), (20, 0, "user", "z"), (30, 0, "assistant", "b"),
            (70, 0, "user", "w"), (70, 1, "assistant", "c"), (70, 2, "user", "more"), (None, 0, "assistant", "lost")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for df in (turns, turns.withColumn("conv_id", F.concat(F.lit("k"), "conv_id"))):
        got = {str(r["pair_id"]).strip("k"): [tuple(t) for t in r["rejected"]] for r in chat.next_reply_pairs(df).collect()}
        assert got == {
            "10": [("user", "q"), ("assistant", "b")],
            "30": [("assistant", "c")],
            "70": [("user", "w"), ("assistant", "a")],
        }
    alone = chat.next_reply_pairs(turns.filter("conv_id <= 20")).collect()
    assert [(r["pair_id"], [tuple(t) for t in r["rejected"]]) for r in alone] == [(10, [("user", "q")])]
    assert chat.next_reply_pairs(turns.limit(0)).collect() == []


def test_op10_leaves_no_reply_out(spark, tmp_path):
    rows = [(i * 10, t, role, f"{role} {i}") for i in range(5) for t, role in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: r["rejected"] for r in entry.queries()["op10_preference_pairs"](spark, str(tmp_path)).collect()}
    assert got == {i * 10: f"<|im_start|>assistant\nassistant {(i + 1) % 5}<|im_end|>\n" for i in range(5)}


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def folder(spark, docs, by_id, tmp_path_factory):
    """A table folder with the small documents and a benchmark that some of them contain."""
    path = tmp_path_factory.mktemp("sf")
    long = [t for t in by_id.values() if t and 25 < len(t.split()) < 200 and len(t) < 2000]
    items = [(1, " ".join(long[4].split()[2:22])), (2, long[9])]
    docs.select("doc_id", "text", "lang").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_pipeline(spark, folder, by_id):
    path, items = folder
    left = {d: t for d, t in by_id.items() if t and any(c.isalpha() for c in t)}
    exact = brute_exact(left)
    left = {d: t for d, t in left.items() if exact[d][2]}
    near = brute_components(left, 5, 80, 100)
    left = {d: t for d, t in left.items() if near[d][1] == d}
    clean = {d: t for d, t in left.items() if not brute_hits(t, items)[4]}
    assert len(clean) < len(left) < len(by_id)
    rows = corpus_pipeline.run(spark, path)
    assert rows.columns == ["doc_id", "text", "lang", "piece_ids", "n_pieces", "round_trip"]
    got = {r["doc_id"]: r["text"] for r in rows.filter("round_trip").collect()}
    assert got == clean
