"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit, over hashed byte n-grams, tells the
languages whose bit is set from those whose bit is not. A text gets the language whose codeword loses
least against the predicted bits, each bit weighted by how well it is told apart in training; when two
codewords are nearly as good, the text is flagged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rowtide.llm.common import arrow_map, column, free_names

BUCKETS = 1 << 16
# The only sample of this operator: labelled rows per language the classifiers are fitted on.
ROWS_PER_LANGUAGE = 600
SMOOTHING = 0.05
# Two codewords nearer than this (difference of the decoded probabilities) are flagged.
AMBIGUOUS = 0.2
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
# Texts are scored in slices of this size; working memory is about 30 bytes a byte of it.
SLICE_BYTES = 1 << 20


def byte_ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigrams and trigrams that start at each byte; the last bytes have none."""
    wide = data.astype(np.uint32)
    two = (wide[:-1] << 8) | wide[1:]
    three = (two[:-1] << 8) | wide[2:]
    return two, ((three * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint32)


def padded(text: str) -> bytes:
    """Lower case with white space around, so that word starts and ends are n-grams too."""
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def codewords(n_languages: int) -> np.ndarray:
    """One row of +1/-1 per language, columns pairwise different and never constant.

    Up to five languages get every possible two-way split; more get a fixed pseudo-random code of
    length ``10 * log2(n)`` chosen for a large smallest distance.
    """
    if n_languages == 1:
        return np.ones((1, 1), dtype=np.int8)
    if n_languages <= 5:
        splits = np.arange(1, 2 ** (n_languages - 1))
        bits = (splits[None, :] >> np.arange(n_languages)[:, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    length = int(np.ceil(10 * np.log2(n_languages)))
    best, distance = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1, 1], size=(n_languages, length)).astype(np.int8)
        apart = (length - (code.astype(int) @ code.T.astype(int))) // 2
        nearest = apart[~np.eye(n_languages, dtype=bool)].min()
        mixed = (np.abs(code.sum(0)) < n_languages).all()
        if mixed and nearest > distance:
            best, distance = code, nearest
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x (2 * BUCKETS): log odds of an n-gram for a set bit
    trust: np.ndarray  # bits: weight of each bit in decoding
    known: np.ndarray  # 2 * BUCKETS: n-grams seen in training

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log odds of every bit, and the number of known n-grams, for each text."""
        parts = [padded(t) for t in texts]
        out, seen = np.zeros((len(texts), len(self.trust))), np.zeros(len(texts), dtype=np.int64)
        # Slices of a text share two bytes, so every n-gram lies whole in the slice in which it starts.
        group, owner, size = [], [], 0
        for i, part in enumerate(parts):
            for at in range(0, len(part), SLICE_BYTES):
                piece = part[at : at + SLICE_BYTES + 2]
                if size and size + len(piece) > SLICE_BYTES:
                    self._add(group, owner, out, seen)
                    group, owner, size = [], [], 0
                group.append((piece, len(piece) == SLICE_BYTES + 2))
                owner.append(i)
                size += len(piece)
        self._add(group, owner, out, seen)
        return out, seen

    def _add(self, group: list[tuple[bytes, bool]], owner: list[int], out: np.ndarray, seen: np.ndarray) -> None:
        """Add the log odds and known n-grams of slices to those of their texts."""
        parts = [piece for piece, _ in group]
        goes_on = np.array([full for _, full in group])
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        data = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8)
        two, three = byte_ngrams(data)
        n = int(lengths.sum())
        two, three = two[:n], three[:n] + np.uint32(BUCKETS)
        # N-grams that would reach into the next text count for nobody.
        ends = starts + lengths
        skip_two = np.concatenate((ends - 1, ends[goes_on] - 2))
        skip_three = np.concatenate((ends - 1, ends - 2))
        for b, w in enumerate(self.weights):
            a, c = w[two], w[three]
            a[skip_two] = 0
            c[skip_three] = 0
            np.add.at(out[:, b], owner, np.add.reduceat(a + c, starts, dtype=np.float64))
        met = self.known[two].astype(np.int32)
        met[skip_two] = 0
        np.add.at(seen, owner, np.add.reduceat(met, starts))

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probability of every language from the weighted logistic loss of its codeword."""
        agreement = margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -agreement) * self.trust).sum(2) / self.trust.sum()
        good = np.exp(-(loss - loss.min(1, keepdims=True)))
        return good / good.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity flag of each text."""
        label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        flag = np.ones(len(texts), dtype=bool)
        spoken = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not spoken or not self.languages:
            return label, score, flag
        margins, seen = self.margins([texts[i] for i in spoken])
        chance = self.decode(margins)
        order = np.argsort(-chance, axis=1, kind="stable")
        for row, i in enumerate(spoken):
            first = order[row, 0]
            label[i], score[i] = self.languages[first], chance[row, first]
            second = chance[row, order[row, 1]] if len(self.languages) > 1 else 0.0
            flag[i] = seen[row] == 0 or chance[row, first] - second < AMBIGUOUS
        return label, score, flag


def held_out(id_column: str):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, id_column: str, text: str, lang: str, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language, the ones of smallest hash.

    Rates from the label counts thin the rows out before any window sees them.
    """
    labelled = docs.filter(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(id_column), F.lit(False))
    ).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id_column, lang).alias("order"))
    counts = labelled.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("count"))
    narrow = labelled.join(F.broadcast(counts), "lang").filter(
        F.pmod("order", F.lit(1 << 20)) <= share * (1 << 20)
    )
    first = Window.partitionBy("lang").orderBy("order")
    return (
        narrow.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= per_language).select("lang", "text")
    )


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """N-gram frequencies of one language, every row with the same weight."""
    total = np.zeros(2 * BUCKETS)
    for t in rows["text"]:
        two, three = byte_ngrams(np.frombuffer(padded(t), dtype=np.uint8))
        counts = np.bincount(two, minlength=2 * BUCKETS) + np.bincount(
            three + np.uint32(BUCKETS), minlength=2 * BUCKETS
        )
        total += counts / max(1, counts.sum())
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "counts": [total.astype(np.float32).tobytes()]})


def fit_language(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit the bit classifiers on a bounded sample of labelled rows.

    The driver receives one fixed-size count vector per language. Without any labelled row the model
    knows no language and predicts ``und`` for everything.
    """
    sample = training_rows(docs, id_column, text, lang, per_language)
    vectors = sample.groupBy("lang").applyInPandas(_summed, "lang string, counts binary").collect()
    vectors = sorted(vectors, key=lambda r: r["lang"])
    languages = [r["lang"] for r in vectors]
    if not languages:
        empty = np.zeros((0, 0))
        return LanguageModel([], empty, empty, np.ones(0), np.zeros(2 * BUCKETS, dtype=bool))
    raw = np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in vectors], dtype=np.float64)
    share = np.empty_like(raw)
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        mass = raw[:, half] / np.maximum(raw[:, half].sum(1, keepdims=True), 1e-12)
        floor = SMOOTHING / BUCKETS
        share[:, half] = (mass + floor) / (1 + SMOOTHING)
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], 2 * BUCKETS), dtype=np.float32)
    trust = np.ones(code.shape[1])
    if len(languages) > 1:
        for b in range(code.shape[1]):
            on, off = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
            odds = np.log(on) - np.log(off)
            weights[b] = odds
            # How far apart the two sides are, in nats an n-gram: bits that tell little weigh little.
            trust[b] = ((on - off) * odds).sum()
    return LanguageModel(languages, code, weights, trust / trust.max(), raw.sum(0) > 0)


def identify_language(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text: str = "text", keep: bool = False
) -> DataFrame:
    """Language of every whole text: (id, held_out, lang_pred, score, ambiguous).

    ``lang_pred`` is ``und`` with score 0 and the flag set when the text is null, empty or has no letter.
    With ``keep`` all columns of ``docs`` are returned, followed by the prediction and the flag.
    Rows are not moved: copies and repeated ids get the same answer one by one. Labels, sources and ids are
    not read by the prediction.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x 2 * BUCKETS floats, whatever the input
    label_name, flag_name = free_names(docs, "_lang_pred", "_ambiguous")

    def run(piece):
        label, score, flag = shared.value.predict(column(piece, text).to_pylist())
        if keep:
            made = {name: column(piece, name) for name in piece.schema.names}
            return made | {label_name: label, flag_name: flag.tolist()}
        return {
            id_column: column(piece, id_column),
            "held_out": column(piece, "held_out"),
            "lang_pred": label,
            "score": score.tolist(),
            "ambiguous": flag.tolist(),
        }

    if keep:
        from pyspark.sql.types import BooleanType, StringType, StructType

        schema = StructType([*docs.schema.fields]).add(label_name, StringType()).add(flag_name, BooleanType())
        return arrow_map(docs, run, text, schema)
    rows = docs.select(id_column, F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), text)
    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_map(
        rows, run, text, f"{id_column} {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
