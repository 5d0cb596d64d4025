"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has one node per character boundary and one edge per vocabulary piece. A node keeps one
surviving back-pointer. Only a window of boundaries as long as the longest piece can still be extended; as
soon as the survivors of the whole window run through one common boundary, the ids before it are final and
are emitted, so memory does not grow with the text.

Edge weights follow the model file. A unigram model adds the pieces' scores. A BPE model allows piece ``b`` after
piece ``a`` only when merging the two pieces' text alone gives exactly ``a, b``; the one path on which every
neighbouring pair is allowed is the BPE encoding, so every boundary has at most one survivor.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowtide.llm.common import arrow_map, column, texts_of

SPACE = "▁"
# Pairs of pieces whose merging is remembered: 9 bytes each in the table, about 150 each in the dictionary.
TABLE_PAIRS = 1 << 20
CACHE_PAIRS = 1 << 16
# Words up to this length go through the lattice together, so many of one length at a time.
BATCH_CHARS = 64
BATCH_WORDS = 1 << 15
# Longer texts are split word by word, so that their words are never all held at once.
LONG_CHARS = 1 << 20
# No piece holds a space mark after another character, so all paths meet in front of a word's mark.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, BYTE, USER_DEFINED, UNUSED = 1, 2, 6, 4, 5
BPE, UNIGRAM = 2, 1
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces, scores and normalisation flags of a SentencePiece file, read with the library's own parser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normal = proto.normalizer_spec
        if len(normal.precompiled_charsmap) or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models with identity normalisation and escaped white space are supported")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.kind = proto.trainer_spec.model_type
        self.texts = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, UNUSED)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.ids))
        # Ends of longer pieces: before any other text no piece can begin and end at the same boundary.
        self.suffixes = {p[k:] for p in self.ids for k in range(1, len(p))}
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that span words are not supported")


def merge_pair(text: str, score: dict[str, float]) -> list[str]:
    """Greedy merging of a short text: always the best-scored neighbouring pair, leftmost among equals."""
    parts = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(i, j):
        made = parts[i] + parts[j]
        if made in score:
            heapq.heappush(heap, (-score[made], i, j, made))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, made = heapq.heappop(heap)
        if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != made:
            continue
        parts[i], parts[j] = made, ""
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p]


class StreamingViterbi:
    def __init__(self, model: PieceModel):
        self.model = model
        self.allowed: dict[tuple[str, str], bool] = {}
        self.lattice = WordLattice(model) if model.kind == BPE else None

    def compatible(self, left: str, right: str) -> bool:
        known = self.allowed.get((left, right))
        if known is None:
            if len(self.allowed) > CACHE_PAIRS:
                self.allowed.clear()
            known = merge_pair(left + right, self.model.score) == [left, right]
            self.allowed[left, right] = known
        return known

    def cut(self, text: str):
        """Yield the pieces of ``text``; unknown characters come as themselves.

        Each boundary looks back over the pieces that end there, at most ``longest`` characters, and keeps its
        best survivor. ``front`` starts as the boundaries that a future path can still leave from.
        """
        model, longest, n = self.model, self.model.longest, len(text)
        ids, suffixes, bpe, allowed = model.ids, model.suffixes, model.kind == BPE, self.allowed
        # Survivors: boundary -> (boundary before, piece, path score).
        back: dict[int, tuple[int, str, float]] = {0: (-1, "", 0.0)}
        done = 0
        for end in range(1, n + 1):
            edges = []
            for start in range(end - 1, max(done, end - longest) - 1, -1):
                piece = text[start:end]
                if start in back and (piece in ids or start == end - 1):
                    edges.append((start, piece))
                if piece not in suffixes:
                    break  # no longer piece ends here
            if bpe:
                for start, piece in reversed(edges):
                    previous = back[start][1]
                    fits = allowed.get((previous, piece))
                    if fits is None:
                        fits = start == 0 or piece not in ids or previous not in ids or self.compatible(previous, piece)
                    if fits:
                        back[end] = (start, piece, 0.0)
                        break
            else:
                for start, piece in edges:
                    score = back[start][2] + model.score.get(piece, model.worst)
                    if end not in back or score >= back[end][2]:
                        back[end] = (start, piece, score)
            if end - done >= 2 * longest:
                # Follow the survivors back until they have merged into one boundary.
                front = {b for b in back if b > end - longest}
                while len(front) > 1:
                    latest = max(front)
                    front.remove(latest)
                    front.add(back[latest][0])
                meet = front.pop()
                if meet > done:
                    yield from self._path(back, meet, done)
                    for b in range(done, meet):
                        back.pop(b, None)
                    done = meet
        yield from self._path(back, n, done)

    @staticmethod
    def _path(back: dict, at: int, stop: int) -> list[str]:
        path = []
        while at > stop:
            at, piece, _ = back[at]
            path.append(piece)
        return path[::-1]

    def word_ids(self, word: str) -> tuple[int, ...]:
        model, out = self.model, []
        for piece in self.cut(word):
            if piece in model.ids:
                out.append(model.ids[piece])
            elif model.bytes:
                out += [model.bytes[b] for b in piece.encode("utf-8", "replace")]
            else:
                out.append(model.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, word by word (in front of a word's mark all survivors meet): all ids, and where each text's end.

        Every distinct word is cut once; a text is then a list of word numbers, so memory goes with the distinct words.
        """
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        placed, ends = array("q"), [0]
        for text in texts:
            if text:
                marked = self.model.prefix + text.replace(" ", SPACE)
                words = WORD.findall(marked) if len(marked) < LONG_CHARS else (m.group() for m in WORD.finditer(marked))
                placed.extend(map(number.__getitem__, words))
            ends.append(len(placed))
        flat, starts, sizes = self.word_table(list(number))
        at = np.frombuffer(placed, dtype=np.int64) if placed else np.zeros(0, np.int64)
        past = np.concatenate(([0], np.cumsum(sizes[at])))
        # Position inside all ids, less where the word begins, plus where the word's ids lie.
        take = np.arange(past[-1]) + np.repeat(starts[at] - past[:-1], sizes[at])
        return flat[take], past[np.array(ends)]

    def word_table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, where each word's start, and how many it has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        shared = lengths <= BATCH_CHARS if self.lattice else np.zeros(len(words), dtype=bool)
        order, flat, sizes = [], [], []
        for i in np.flatnonzero(~shared):
            order.append(np.array([i]))
            flat.append(np.array(self.word_ids(words[i]), dtype=np.int32))
            sizes.append(np.array([len(flat[-1])]))
        for length in np.unique(lengths[shared]):
            same = np.flatnonzero(shared & (lengths == length))
            for at in range(0, len(same), BATCH_WORDS):
                some = same[at : at + BATCH_WORDS]
                ids, n_ids = self.lattice.cut([words[i] for i in some], int(length))
                order.append(some)
                flat.append(ids)
                sizes.append(n_ids)
        n_ids, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if order:
            place, size = np.concatenate(order), np.concatenate(sizes)
            n_ids[place], starts[place] = size, np.cumsum(size) - size
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), starts, n_ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8."""
        model = self.model
        pieces = model.texts
        if model.byte_of.keys().isdisjoint(ids) and model.unknown not in ids:
            return self._plain("".join([pieces[i] for i in ids]))
        out, pending = [], bytearray()
        for i in ids:
            b = model.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(pieces[i] if i != model.unknown else " ⁇ ")
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return self._plain("".join(out))

    def _plain(self, text: str) -> str:
        """Text without the leading mark the encoder added, marks as spaces."""
        if self.model.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


class WordLattice:
    """The same Viterbi for many words of one length at once: every step is an array operation over the words.

    Pieces are found by walking a trie from every boundary. Words are at most ``BATCH_CHARS`` long, so the window of
    open boundaries is the whole word.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.n_pieces = len(model.texts)
        nodes, piece = {"": 0}, [-1]
        for text, i in model.ids.items():
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    nodes[text[:k]] = len(piece)
                    piece.append(-1)
            piece[nodes[text]] = i
        edges = sorted((nodes[t[:-1]] << 21 | ord(t[-1]), node) for t, node in nodes.items() if t)
        self.edges = np.array([k for k, _ in edges], dtype=np.int64)
        self.into = np.array([node for _, node in edges], dtype=np.int32)
        self.piece = np.array(piece, dtype=np.int32)
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _pieces(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By start and end: the words that have a piece there, and its id."""
        found, length = {}, codes.shape[1]
        for start in range(length):
            rows, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
            for end in range(start + 1, length + 1):
                key = node << 21 | codes[rows, end - 1]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                known = self.edges[at] == key
                rows, node = rows[known], self.into[at[known]].astype(np.int64)
                if not len(rows):
                    break
                piece = self.piece[node]
                whole = piece >= 0
                if whole.any():
                    found[start, end] = rows[whole], piece[whole]
        return found

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_pieces + right
        at = np.searchsorted(self.pairs, key)
        missing = np.ones(len(key), dtype=bool)
        inside = at < len(self.pairs)
        missing[inside] = self.pairs[at[inside]] != key[inside]
        if missing.any():
            new = np.unique(key[missing])
            texts, score = self.model.texts, self.model.score
            said = []
            for k in new.tolist():
                pair = [texts[k // self.n_pieces], texts[k % self.n_pieces]]
                said.append(merge_pair("".join(pair), score) == pair)
            if len(self.pairs) > TABLE_PAIRS:
                self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
                return self._compatible(left, right)
            spot = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, spot, new), np.insert(self.fits, spot, said)
            at = np.searchsorted(self.pairs, key)
        return self.fits[at]

    def cut(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, in their order, and how many each has."""
        n, model = len(words), self.model
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, length).astype(np.int64)
        found = self._pieces(codes)
        # Survivors: the piece that ends at a boundary (-1 none yet, n_pieces a character without a piece) and its start.
        last = np.full((length + 1, n), -1, dtype=np.int32)
        back = np.zeros((length + 1, n), dtype=np.int16)
        for end in range(1, length + 1):
            for start in range(max(0, end - model.longest), end):
                rows, piece = found.get((start, end), (np.zeros(0, np.int64), np.zeros(0, np.int32)))
                if start == end - 1:  # any character is an edge, known or not
                    single = np.full(n, self.n_pieces, dtype=np.int32)
                    single[rows] = piece
                    rows, piece = np.arange(n), single
                open_ = last[end, rows] < 0
                if start:
                    open_ &= last[start, rows] >= 0
                rows, piece = rows[open_], piece[open_]
                if not len(rows):
                    continue
                if start:
                    before = last[start, rows]
                    fits = (before == self.n_pieces) | (piece == self.n_pieces)
                    ask = ~fits
                    fits[ask] = self._compatible(before[ask], piece[ask])
                    rows, piece = rows[fits], piece[fits]
                last[end, rows], back[end, rows] = piece, start
        return self._paths(words, last, back)

    def _paths(self, words: list[str], last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.arange(len(words)), np.full(len(words), last.shape[0] - 1)
        held, ids = [], []
        while len(rows):
            held.append(rows)
            ids.append(last[at, rows])
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        rows, flat = np.concatenate(held[::-1]), np.concatenate(ids[::-1])
        flat = flat[np.argsort(rows, kind="stable")]
        sizes = np.bincount(rows, minlength=len(words))
        if (flat < self.n_pieces).all():
            return flat, sizes
        starts, out, done = np.cumsum(sizes) - sizes, [], 0
        for i in np.unique(np.repeat(np.arange(len(words)), sizes)[flat == self.n_pieces]):
            end = starts[i] + sizes[i]
            spelled = self._spelled(words[i], flat[starts[i] : end])
            out += [flat[done : starts[i]], spelled]
            sizes[i], done = len(spelled), end
        return np.concatenate([*out, flat[done:]]), sizes

    def _spelled(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece as the pieces of their bytes."""
        model, made, at = self.model, [], 0
        for i in ids.tolist():
            if i < self.n_pieces:
                made.append(i)
                at += len(model.texts[i])
                continue
            made += [model.bytes[b] for b in word[at].encode("utf-8", "replace")] if model.bytes else [model.unknown]
            at += 1
        return np.array(made, dtype=np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> StreamingViterbi:
    """The encoder of a worker process. What it keeps between tasks is the model and a bounded table of pairs."""
    return StreamingViterbi(PieceModel(path))


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", keep: bool = False
) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back.

    Returns (id, ids, n_ids, round_trip); with ``keep`` the columns of ``docs`` and then ``piece_ids``,
    ``n_pieces``, ``round_trip``, which replace columns of the same names. Null and empty texts have no ids
    and round-trip to the empty text. A text that itself holds the mark U+2581 decodes to a space there, so
    it does not round-trip. Rows are not moved; repeated rows are encoded one by one. ``path`` must exist on
    every worker.
    """
    names = ("piece_ids", "n_pieces", "round_trip") if keep else ("ids", "n_ids", "round_trip")
    base = docs.drop(*names) if keep else docs.select(id_column, text)
    fields = [f for f in base.schema.fields if keep or f.name == id_column]

    def run(piece):
        viterbi = encoder(path)
        texts = texts_of(piece, text)
        ids, ends = viterbi.encode_all(texts)
        made = {f.name: column(piece, f.name) for f in fields}
        made[names[0]] = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids, type=pa.int32()))
        made[names[1]] = np.diff(ends).tolist()
        made[names[2]] = [viterbi.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts)]
        return made

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

    schema = StructType(fields).add(names[0], ArrayType(IntegerType())).add(names[1], LongType())
    return arrow_map(base, run, text, schema.add(names[2], BooleanType()))
