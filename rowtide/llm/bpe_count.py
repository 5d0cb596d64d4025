"""Token counts of byte-level BPE: heap and linked list, no ids are made."""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from rowtide.llm.common import arrow_map, column, texts_of

# Fixed value: the split pattern of byte-level BPE. White space is the Unicode property, as in the library.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHE_WORDS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text under a merge list.

    Words are cached, because their counts do not depend on the context; the cache is emptied when it
    holds ``CACHE_WORDS`` words, so memory is bounded whatever the input.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.specials = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        symbols = byte_symbols()
        number = {s: i for i, s in enumerate(symbols)}
        for left, right in merges:
            number.setdefault(left + right, len(number))
        # (left symbol, right symbol) as one integer -> (rank, merged symbol)
        self.base = len(number) + 1
        self.rank = {}
        for r, (left, right) in enumerate(merges):
            self.rank.setdefault(number[left] * self.base + number[right], (r, number[left + right]))
        self.words: dict[str, int] = {}
        self.split = regex.compile(SPLIT)

    def merge_count(self, data: bytes) -> int:
        """Tokens of one word: pop the adjacent pair of lowest rank until none is left."""
        n = len(data)
        if n < 2:
            return n
        rank, base = self.rank, self.base
        symbol, after, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank.get(symbol[i] * base + symbol[i + 1])
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two was merged into another pair meanwhile
            symbol[i], symbol[j] = made, -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get(made * base + symbol[k])
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get(symbol[h] * base + made)
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return n - merged

    def _plain(self, text: str) -> int:
        found, words = self.split.findall(text), self.words
        try:
            return sum(map(words.__getitem__, found))
        except KeyError:
            if len(words) > CACHE_WORDS:
                words.clear()
            for word in set(found).difference(words):
                words[word] = self.merge_count(word.encode("utf-8"))
            return sum(map(words.__getitem__, found))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    Equals the library's encoding of the file at ``path`` without added special tokens; a special
    string inside a text is one token. Null and empty texts have no bytes and no tokens. Rows are not
    moved, so repeated rows are simply counted again; other columns are not read. ``path`` must exist
    on every worker.
    """
    kept: list[MergeCounter] = []

    def run(piece):
        if not kept:
            kept.append(MergeCounter(path))
        texts = texts_of(piece, text)
        counts = [kept[0].count(t) for t in texts]
        return {
            id_column: column(piece, id_column),
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    docs = docs.select(id_column, text)
    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_map(docs, run, text, f"{id_column} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
