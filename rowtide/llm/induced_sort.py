"""External induced sorting of suffixes with common-prefix lengths.

Suffixes are typed L (larger than the next suffix) or S. The S* suffixes (S after L) are sorted by naming their
substrings and, where names repeat, by recursion on the string of names. All others are induced: taking
suffixes in order, each offers the suffix one symbol longer to the queue of that symbol, first upwards for the
L suffixes, then downwards for the S suffixes. The queues carry (position, common prefix with the entry
before) and are processed symbol by symbol in blocks; what exceeds the memory bound waits on disk. The common
prefix of an induced suffix is one more than the least common prefix between its source and the source of the
entry before it in the same queue.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

BLOCK = 1 << 16
MEMORY_ITEMS = 1 << 24  # queued suffixes held in memory by one sort
BASE_ITEMS = 1 << 22  # strings of names up to this length are sorted in memory


class SuffixQueue:
    """Priority queue over symbols; entries of one symbol keep their order. Blocks beyond the bound go to disk."""

    def __init__(self, memory_items: int):
        self.memory_items = memory_items
        self.held = 0
        self.blocks: dict[int, list] = defaultdict(list)
        self.file = None
        self.end = 0

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        blocks = self.blocks[symbol]
        if self.held + len(positions) > self.memory_items:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(self.end)
            self.file.write(positions.tobytes())
            self.file.write(common.tobytes())
            blocks.append((self.end, len(positions), positions.dtype))
            self.end += positions.nbytes + common.nbytes
        else:
            self.held += len(positions)
            blocks.append((positions, common))

    def take(self, symbol: int):
        """The entries queued for a symbol so far, in blocks of about ``BLOCK``; later pushes start anew."""
        waiting, held = [], 0
        for block in self.blocks.pop(symbol, []):
            waiting.append(self._load(block))
            held += len(waiting[-1][0])
            if held >= BLOCK:
                yield _joined(waiting)
                waiting, held = [], 0
        if waiting:
            yield _joined(waiting)

    def waits(self, symbol: int) -> bool:
        return symbol in self.blocks

    def _load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            self.held -= len(block[0])
            return block
        at, n, kind = block
        self.file.seek(at)
        positions = np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind)
        return positions, np.frombuffer(self.file.read(n), dtype=np.uint8)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _joined(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    if len(blocks) == 1:
        return blocks[0]
    return np.concatenate([p for p, _ in blocks]), np.concatenate([c for _, c in blocks])


def runs_and_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of equal symbols from each position on, and whether the suffix is of type S."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    sizes = np.diff(np.concatenate(([-1], ends)))
    run = np.repeat(ends, sizes) - np.arange(n) + 1
    smaller = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)  # the end of the text is smallest
    return run, np.repeat(smaller, sizes)


def doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffix order of a string of names by prefix doubling in memory; ties beyond ``depth`` names stay."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        rank, step = fresh, step * 2
        if rank.max() == n or step >= n or (depth is not None and step >= depth):
            return order


def substring_names(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of the substring from each S* position to the next one, both included.

    Of equal symbols the one of type L comes first, as it does in the order of suffixes.
    """
    n, wide = len(text), text.dtype.itemsize > 1
    past = np.append(stars[1:] + 1, n)
    rank = np.zeros(len(stars), dtype=np.int64)
    offset, open_ = 0, np.arange(len(stars))
    width = 1 if wide else 6
    while len(open_):
        at, left = stars[open_] + offset, past[open_] - stars[open_] - offset
        # Symbols are shifted by one, so a substring that ends sorts before one that goes on.
        chunk = np.zeros(len(open_), dtype=np.int64)
        for k in range(width):
            there = k < left
            symbol = np.zeros(len(open_), dtype=np.int64)
            place = at[there] + k
            symbol[there] = text[place].astype(np.int64) * 2 + s_type[place] + 1
            chunk = symbol if width == 1 else chunk * 513 + symbol
        order = np.lexsort((chunk, rank[open_]))
        r, c = rank[open_][order], chunk[order]
        change = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        # New ranks keep the old ones apart: position of the group's first member among the open ones.
        fresh = np.empty(len(open_), dtype=np.int64)
        first = np.concatenate(([0], np.flatnonzero(change) + 1))
        size = np.diff(np.append(first, len(open_)))
        base_first = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1))
        within = np.repeat(first, size) - np.repeat(base_first, np.diff(np.append(base_first, len(open_))))
        fresh[order] = r + within
        rank[open_] = fresh
        alone = np.empty(len(open_), dtype=bool)
        alone[order] = np.repeat(size == 1, size)
        open_ = open_[~alone & (left >= width)]  # one that ends here differs from one that goes on
        offset += width
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before in ``order``, at most ``cap``."""
    n = len(text)
    out = np.zeros(len(order), dtype=np.uint8)
    live = np.arange(1, len(order))
    a, b = order[:-1].copy(), order[1:].copy()
    for depth in range(cap):
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), dtype=bool)
        same[inside] = text[a[inside]] == text[b[inside]]
        live, a, b = live[same], a[same] + 1, b[same] + 1
        if not len(live):
            break
        out[live] = depth + 1
    return out


def _least_between(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``common[first..last]`` for many ranges, by a table of doubling spans."""
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), dtype=np.uint8)
    row, size = common, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = level == k
        out[mine] = np.minimum(row[first[mine]], row[last[mine] - size + 1])
        if len(row) > size:
            row = np.minimum(row[:-size], row[size:])
        size *= 2
    return out


class _Inducer:
    """One pass of induction: offers the longer suffixes of scanned blocks to a queue."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, wanted_s: bool, cap: int, memory_items: int):
        self.text, self.s_type, self.wanted_s, self.cap = text, s_type, wanted_s, cap
        self.queue = SuffixQueue(memory_items)
        # Least common prefix scanned since the last entry of each queue; absent: the queue is empty.
        self.since: dict[int, int] = {}

    def scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        for at in range(0, len(positions), BLOCK):
            self._scan(positions[at : at + BLOCK], common[at : at + BLOCK])

    def _scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        before = positions - 1
        there = before >= 0
        there[there] = self.s_type[before[there]] == self.wanted_s
        index = np.flatnonzero(there)
        least_all = int(common.min())
        if not len(index):
            for symbol in self.since:
                self.since[symbol] = min(self.since[symbol], least_all)
            return
        before = before[index]
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        index, before, symbols = index[order], before[order], symbols[order]
        starts = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1))
        first = np.empty(len(index), dtype=np.int64)
        first[1:] = index[:-1] + 1
        first[starts] = 0  # from the start of the block, joined with what was scanned before
        made = np.minimum(_least_between(common, first, index).astype(np.int64) + 1, self.cap)
        stops = np.append(starts[1:], len(index))
        tails = np.full(len(starts), 255, dtype=np.int64)
        after = index[stops - 1] + 1
        open_tail = after < len(common)
        if open_tail.any():
            tails[open_tail] = _least_between(common, after[open_tail], np.full(int(open_tail.sum()), len(common) - 1))
        found = symbols[starts].tolist()
        touched = set(found)
        for symbol in self.since:
            if symbol not in touched:
                self.since[symbol] = min(self.since[symbol], least_all)
        for k, symbol in enumerate(found):
            a, b = starts[k], stops[k]
            if symbol in self.since:
                made[a] = min(made[a], self.since[symbol] + 1, self.cap)
            else:
                made[a] = 0
            self.queue.push(symbol, before[a:b], made[a:b].astype(np.uint8))
            self.since[symbol] = int(tails[k])


def sort_suffixes(
    text: np.ndarray, cap: int = 255, depth: int | None = None, memory_items: int = MEMORY_ITEMS, base_items: int = BASE_ITEMS
) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` and common prefix of each suffix with the one before, at most ``cap``.

    With ``depth`` the order is exact for the first ``depth`` symbols only, which is all that common
    prefixes up to ``depth`` need. An empty text has an empty order.
    """
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    if n < 2:
        return np.arange(n, dtype=kind), np.zeros(n, dtype=np.uint8)
    run, s_type = runs_and_types(text)
    stars = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(stars):
        names = substring_names(text, s_type, stars)
        if len(np.unique(names)) == len(stars):
            order = np.argsort(names)
        elif len(stars) <= base_items:
            order = doubled(names, depth)
        else:
            dense = np.unique(names, return_inverse=True)[1].astype(np.int64)
            order, _ = sort_suffixes(dense, 1, depth, memory_items, base_items)
        stars = stars[order].astype(kind)
        star_common = common_prefixes(text, stars, cap)
    else:
        star_common = np.zeros(0, dtype=np.uint8)
        stars = stars.astype(kind)

    # Upwards: L suffixes from the end of the text, from smaller L suffixes and from S* suffixes.
    up = _Inducer(text, s_type, False, cap, memory_items)
    up.queue.push(int(text[n - 1]), np.array([n - 1], dtype=kind), np.zeros(1, dtype=np.uint8))
    up.since[int(text[n - 1])] = 0  # nothing else shares more than the empty end with the last symbol
    star_symbols = text[stars]
    star_starts = np.searchsorted(star_symbols, np.unique(star_symbols)) if len(stars) else []
    star_of = {int(star_symbols[a]): (a, b) for a, b in zip(star_starts, np.append(star_starts[1:], len(stars)))} if len(stars) else {}
    kept = SuffixQueue(memory_items)
    symbols = np.unique(text).tolist()
    l_last: dict[int, int] = {}
    for symbol in symbols:
        new_bucket = True
        while up.queue.waits(symbol):
            for positions, common in up.queue.take(symbol):
                if new_bucket:
                    common = common.copy()
                    common[0] = 0
                    new_bucket = False
                kept.push(symbol, positions, common)
                l_last[symbol] = int(positions[-1])
                up.scan(positions, common)
        if symbol in star_of:
            a, b = star_of[symbol]
            common = star_common[a:b].copy()
            common[0] = min(run[l_last[symbol]], run[stars[a]], cap) if symbol in l_last else 0
            up.scan(stars[a:b], common)
    up.queue.close()

    # Downwards: S suffixes from larger suffixes of either type. ``common`` is then with the entry after.
    down = _Inducer(text, s_type, True, cap, memory_items)
    order = np.empty(n, dtype=kind)
    out = np.zeros(n, dtype=np.uint8)
    end = n
    for symbol in reversed(symbols):
        top, s_first = end, None
        while down.queue.waits(symbol):
            for positions, common in down.queue.take(symbol):
                if end == top:
                    common = common.copy()
                    common[0] = 0
                m = len(positions)
                order[end - m : end] = positions[::-1]
                # common[k] is shared by entry k and the one scanned before it, its successor in order.
                if end < top:
                    out[end] = common[0]
                out[end - m + 1 : end] = common[1:][::-1]
                end -= m
                s_first = int(positions[-1])
                down.scan(positions, common)
        blocks = list(kept.take(symbol))
        if blocks:
            positions, common = _joined(blocks)
            m = len(positions)
            if s_first is not None:
                border = min(run[positions[-1]], run[s_first], cap)
                out[end] = border
            else:
                border = 0
            order[end - m : end] = positions
            out[end - m : end] = common
            end -= m
            down.scan(positions[::-1], np.concatenate((np.array([border], dtype=np.uint8), common[:0:-1])))
    down.queue.close()
    kept.close()
    return order, out
