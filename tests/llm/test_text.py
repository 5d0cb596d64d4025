"""Personal data, pages, contamination, token counts, pieces and languages against brute force or the libraries."""

import hashlib
import html
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rowtide.llm import bpe_count, decontaminate, html_text, language, pii, sentence_pieces

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[1]]))


def test_base_spans():
    pick = random.Random(3)
    bits = ["a", "b@", "@", ".", "1", "23", "255", "+", "-", " ", "(", ")", "c.d", "_", "%", "é", ".1", "4111 1111 1111 1111", "+1 (255) 555-8013"]
    for _ in range(4000):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 20)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.fixture(scope="module")
def field():
    return pii.SemiMarkovField().fit(pii.training_examples(["the quick brown fox jumps over lazy dogs"], 500), epochs=4)


def test_field_decodes_the_best_cut(field):
    """Dynamic programming against every cut of short runs."""
    for text in ("10.0.0.1", "+1 (255) 555-8013", "12 34.5"):
        cut, found = field.lattice(text, 0, len(text))
        score = {(i, j): s for i, j, s, _ in found}
        best = (-np.inf, None)

        def walk(at, label, total, spans):
            nonlocal best
            if at == len(cut):
                if total > best[0]:
                    best = (total, spans)
                return
            walk(at + 1, 0, total + field.transitions[label, 0], spans)
            for (i, j), s in score.items():
                if i == at:
                    for k in range(4):
                        walk(j, k + 1, total + field.transitions[label, k + 1] + s[k], [*spans, (cut[i][0], pii.KINDS[k], cut[j - 1][1])])

        walk(0, 0, 0.0, [])
        assert field.decode(text, 0, len(text)) == best[1]


def test_field_adds_what_the_patterns_miss_and_leaves_plain_numbers(field):
    found = lambda t: [t[a:b] for a, _, b in pii.all_spans(t, field)[1]]
    assert found("write to john.smith at mail dot example dot com please") == ["john.smith at mail dot example dot com"]
    for name in ("anna.meier", "jo", "hans_p.klein42", "a.b.smith"):
        for at, dot in ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) ")):
            assert found(f"write to {name}{at}posthaus{dot}de today") == [f"{name}{at}posthaus{dot}de"]
    assert found("call (255) 555-8013 now") == ["(255) 555-8013"]
    for plain in ("on 2024-01-15 we met", "version 1.2.3 and 10.5", "pages 12-34", "@user hello", "he came at 5"):
        assert found(plain) == []


def test_runs_of_any_length_are_read_whole(field):
    """A number behind thousands of others, wherever a block of 4,096 characters would end."""
    for many in (700, 815, 818, 819, 820, 2000):
        text = "1234 " * many + "415-555-0134 end"
        assert [r for r in pii.runs(text)] == [(0, len(text) - 4)]
        assert pii.all_spans(text, field)[1][-1] == (5 * many, "phone", 5 * many + 12)
    long = "x" * 5000 + "@" + "y" * 5000
    assert pii.all_spans(long + " a@b.de " + "." * 9000, field)[1][-1][1] == "email"


def test_personal_data_query(spark, docs, by_id, no_docs, field):
    rows = pii.find_personal_data(docs, field).collect()
    assert len(rows) == len(by_id)
    for r in rows:
        base = brute_spans(by_id[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s[1] == kind for s in base)
    assert pii.find_personal_data(no_docs, field).collect() == []
    one = spark.createDataFrame([(1, "é +1 (255) 555-8013 x@y.de"), (1, "é +1 (255) 555-8013 x@y.de")], "doc_id bigint, text string")
    assert [r["spans"] for r in pii.find_personal_data(one, field).collect()] == ["phone:2:19,email:20:26"] * 2
    assert pii.fit_field(no_docs) is not None


def page(title, paragraphs):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    return (
        f"<html><head><title>{title}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>home</a></li><li><a href='/b'>news</a></li>"
        f"<li><a href='/c'>more</a></li></ul></nav><!-- x --><div class=\"ad\">buy this now please</div><article><h1>{title}</h1>{body}</article>"
        f"<div class='comments'><div class='comment'><b>bob</b><p>nice words from me</p></div></div><footer>&copy; us &middot; all</footer></body></html>"
    )


@pytest.fixture(scope="module")
def model():
    pick = random.Random(1)
    words = "alpha beta gamma delta omega sigma tau rho one two three".split()
    made = [page("Title of it", [" ".join(pick.choice(words) for _ in range(pick.randint(8, 60))) for _ in range(5)]) for _ in range(40)]
    return html_text.fit_layouts(made)


def test_page_reading():
    read = lambda h: [t for _, t in html_text.read_page(h)[1]]
    assert read("<p>x<p>y") == ["x", "y"] and read("a<b>b</b>c") == ["abc"] and read("<li>1<li>2") == ["1", "2"]
    assert read("a &amp; b&lt;c &copy &am;") == ["a & b<c © &am;"] and read("<!-- a --><p> z \n z</p>") == ["z z"]
    assert read("<p><b>one<br>two<p>three</p>") == ["one two", "three"] and read("<script>x</script><style>p{}</style>") == []
    assert read("") == [] and read("<") == ["<"] and read("<div>" * 3000 + "x") == ["x"]


def test_silent_subtrees_do_not_cut_the_page():
    read = lambda h: [t for _, t in html_text.read_page(h)[1]]
    # Closed ones are left out whole, with the tags in them.
    assert read("<p>a <svg><g><title>t</title><text>x</text></g></svg>b</p>") == ["a b"]
    assert read("<p>a <select><option>x<option>y</select>b</p><p>c</p>") == ["a b", "c"]
    assert read("<div>a <template><div><p>x<li>y</div></template>b</div>") == ["a b"]
    assert read("<svg><foreignObject><p>x</p></foreignObject></svg><p>a</p>") == ["a"]
    assert read("<template><script></template></script><select><option>x</select></template>a") == ["a"]
    assert read("<select><div>x</div></select><p>a</p>") == ["a"]
    # A self-closed svg is empty, and so are self-closed elements in one.
    assert read("<p>a<svg width='1'/>b</p><p>c</p>") == ["ab", "c"]
    assert read("<svg><title/><style/><path d='M0'/></svg><p>a</p>") == ["a"]
    # Unclosed ones end with the block around them, an svg or a select also at the next HTML block.
    assert read("<p>a<svg><path><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert read("<form><select><option>x</form><p>a</p>") == ["a"]
    assert read("<select><option>x<p>a</p><select><option>y</select><p>b</p>") == ["a", "b"]
    assert read("<div><template><b>x</div><p>a</p>") == ["a"]
    assert read("<a href='#'><svg></a><p>a</p>") == ["a"]
    assert read("<svg><g>x") == [] and read("<div>a</div><select><option>x") == ["a"]


def test_decoding_has_no_contradictions(model):
    pick = random.Random(9)
    for _ in range(30):
        made = html_text._page(pick, ["some words here &amp; there"] * pick.randint(1, 6), ["a", "b", "word"])
        nodes, _ = html_text.read_page(made)
        logit = np.array([pick.gauss(0, 3) for _ in nodes])
        kept = html_text.decode(nodes, logit)
        assert all(not kept[i] or v.parent < 0 or kept[v.parent] for i, v in enumerate(nodes))
    # Against all labellings of a small tree.
    nodes = html_text.read_page("<div><p>a</p><ul><li>b</li></ul></div>")[0]
    for _ in range(50):
        logit = np.array([pick.gauss(0, 2) for _ in nodes])
        value = lambda kept: sum(-np.logaddexp(0, -x if k else x) for k, x in zip(kept, logit))
        best = max(
            value(kept)
            for kept in ([bool(m >> i & 1) for i in range(len(nodes))] for m in range(2 ** len(nodes)))
            if all(not kept[i] or v.parent < 0 or kept[v.parent] for i, v in enumerate(nodes))
        )
        assert value(html_text.decode(nodes, logit)) == pytest.approx(best)


def test_main_text(spark, model):
    paragraphs = ["first words of the story & more <here>", "second part of a longer story with many words in it", "third part, which ends the story"]
    rows = [(1, "u", page("A title", paragraphs)), (1, "u", page("A title", paragraphs)), (2, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(map(tuple, html_text.extract_pages(pages, model).collect()), key=str)
    want = "\n\n".join(["A title", *paragraphs])
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.extract_pages(pages.limit(0), model).collect() == []
    assert html_text.fit_pages(pages.limit(0)) is not None


def test_main_text_on_held_out_layouts(model):
    pick = random.Random(77)
    words = "river stone cloud paper window garden silver morning evening table".split()
    good = total = 0
    for _ in range(120):
        made = html_text._page(pick, [html_text._words(pick, words, 6, 50) for _ in range(pick.randint(2, 8))], words)
        nodes, label = html_text._labelled(made)
        if label is None:
            continue
        kept = html_text.decode(nodes, model.trees.logit(html_text.features(nodes, model.vocabulary)))
        plain = made.replace("\0", "").replace("\1", "").replace(" data-main>", ">")
        blocks = html_text.read_page(plain)[1]
        good += sum(kept[n] == label[n] for n, _ in blocks)
        total += len(blocks)
    assert good / total > 0.97


def brute_hits(text, items):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    mine = word.findall((text or "").translate(lower))
    hit, found = set(), set()
    for item, t in items:
        w = word.findall((t or "").translate(lower))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(mine) - size + 1):
                if mine[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(mine), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(mine)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, docs, by_id, block_bytes):
    long = [t for t in by_id.values() if t and 20 < len(t.split()) < 200 and len(t) < 2000]
    items = [(1, " ".join(long[0].split()[3:20])), (10, long[1].upper()), (2, "the"), (3, None), (4, ""), (5, "…!"), (6, "b b b b b b b b b b b b b b"), (10, long[2])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.find_contamination(docs, benchmark, block_bytes=block_bytes).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert len(rows) == len(by_id) and got == {d: brute_hits(t, items) for d, t in by_id.items()}
    for r in rows:
        spans = [tuple(map(int, s.split("-"))) for s in r["spans"].split(",") if s]
        assert sum(b - a for a, b in spans) == r["n_hit"]


def test_contamination_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, none).filter("contaminated OR n_items > 0").count() == 0
    assert decontaminate.find_contamination(no_docs, none).collect() == []
    kept = decontaminate.find_contamination(docs, none, keep=True)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == docs.count()


@pytest.fixture(scope="module")
def strange():
    pick = random.Random(6)
    bits = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'ll", "é", "漢", "٣", "½", "<|endoftext|>", "<s>", "\x00", "🙂", "the", "ing", "1", "....", "====", "▁"]
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 18))) for _ in range(1500)] + ["ab" * 900, " " * 300, "a" * 700]


def test_token_counts(docs, by_id, no_docs, strange):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    counter = bpe_count.MergeCounter(path)
    assert [counter.count(t) for t in strange] == [size(t) for t in strange]
    rows = bpe_count.count_tokens(docs, path).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {
        d: (len((t or "").encode()), size(t), size(t) > 512) for d, t in by_id.items()
    }
    assert len(rows) == len(by_id) and bpe_count.count_tokens(no_docs, path).collect() == []


def test_pieces_equal_the_library(docs, by_id, no_docs, strange):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    viterbi = sentence_pieces.StreamingViterbi(sentence_pieces.PieceModel(path))
    for t in strange:
        ids = viterbi.encode(t)
        assert ids == library.encode(t), t
        assert viterbi.decode(ids) == library.decode(ids), t
    rows = sentence_pieces.encode_documents(docs, path).collect()
    assert {r["doc_id"]: (r["ids"], r["n_ids"]) for r in rows} == {d: (i := library.encode(t or ""), len(i)) for d, t in by_id.items()}
    assert all(r["round_trip"] for r in rows) and sentence_pieces.encode_documents(no_docs, path).collect() == []
    kept = sentence_pieces.encode_documents(docs, path, keep=True)
    assert kept.columns[: len(docs.columns)] == docs.columns


def test_unigram_lattice_equals_full_viterbi():
    """Committing early gives the path that a search over the whole text gives."""
    model = sentence_pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    model.kind = sentence_pieces.UNIGRAM
    stream = sentence_pieces.StreamingViterbi(model)
    pick = random.Random(2)
    for _ in range(60):
        text = "".join(pick.choice("etaoinshr漢") for _ in range(pick.randint(0, 250)))
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - model.longest), end):
                part = text[start:end]
                if part in model.ids or end - start == 1:
                    total = best[start][0] + model.score.get(part, model.worst)
                    if best[end] is None or total > best[end][0]:
                        best[end] = (total, start)
        assert sum(model.score.get(p, model.worst) for p in stream.cut(text)) == pytest.approx(best[-1][0])


SPOKEN = {
    "en": "the of and to in is that with for was on are by this have from they which would there",
    "de": "der die und das ist nicht ein zu den mit von sich auf dem für eine wird auch werden über",
    "fr": "le la les des est dans une pour que qui sur avec pas plus ce sont mais été même leurs",
}


def spoken(n, seed):
    pick = random.Random(seed)
    return [(i, (lang := list(SPOKEN)[i % 3]), " ".join(pick.choice(SPOKEN[lang].split()) for _ in range(pick.randint(3, 40)))) for i in range(n)]


def test_language_on_held_out_rows(spark, no_docs):
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in spoken(240, 1)], "doc_id bigint, text string, lang string")
    model = language.fit_language(docs)
    assert model.languages == ["de", "en", "fr"]
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "", "en"), (1002, "12 ... !", "en"), (1002, "the of and", None)], docs.schema)
    rows = language.identify_language(docs.union(odd), model).collect()
    want = {i: lang for i, lang, _ in spoken(240, 1)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert len(held) > 20 and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.95
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows if r["doc_id"] >= 1000) == [(1000, "und"), (1001, "und"), (1002, "en"), (1002, "und")]
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 244
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    empty = language.fit_language(no_docs)
    assert {r["lang_pred"] for r in language.identify_language(docs, empty).collect()} == {"und"}
    assert language.identify_language(no_docs, model).collect() == []


def test_batched_margins_equal_single_ones(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in spoken(90, 2)], "doc_id bigint, text string, lang string")
    model = language.fit_language(docs)
    texts = [t for _, _, t in spoken(30, 5)]
    together, _ = model.margins(texts)
    for t, row in zip(texts, together):
        alone = np.zeros(len(model.trust))
        data = language.padded(t)
        two, three = language.byte_ngrams(np.frombuffer(data, dtype=np.uint8))
        for b, w in enumerate(model.weights):
            alone[b] = w[two].astype(float).sum() + w[three + language.BUCKETS].astype(float).sum()
        assert np.allclose(alone, row, atol=1e-3)


def test_codewords_are_apart():
    for n in (2, 3, 5, 12):
        code = language.codewords(n).astype(int)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n and (np.abs(code.sum(0)) < n).all()
