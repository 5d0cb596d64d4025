"""Fill-in-middle from seekable compressed texts.

A text is stored as independent zstandard frames with an index of cumulative units, so a cut at unit k decompresses the
one frame that holds it, and outputs are streamed frame by frame. Their concatenation is a plain zstandard file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from rowtide.llm.common import arrow_map, column, free_names

FRAME_BYTES = 1 << 16
LEVEL = 3
SEED = 7
# Of 100 texts, so many are transformed at all, and of 100 transformed ones so many put the suffix first.
FIM_SHARE = 100
SPM_SHARE = 50

# The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)

# Of each frame: where it starts in the compressed and in the plain text, and the line ends and code points before it.
INDEX = "array<struct<offset:bigint,at:bigint,ends:bigint,chars:bigint>>"
STORED = f"frames binary, frame_index {INDEX}, n bigint, marked boolean"


def _boundary(data: bytes, at: int) -> int:
    """The last start of a code point at or before ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def n_chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8"))


def pack(text: str, size: int = FRAME_BYTES) -> dict:
    """A text as frames of about ``size`` bytes with their index; its lines are its units."""
    data = text.encode("utf-8")
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    out, index, at, offset, ends, chars = [], [], 0, 0, 0, 0
    while at < len(data):
        stop = _boundary(data, min(at + size, len(data)))
        part = data[at:stop]
        frame = compress(part)
        index.append({"offset": offset, "at": at, "ends": ends, "chars": chars})
        out.append(frame)
        at, offset = stop, offset + len(frame)
        ends, chars = ends + part.count(b"\n"), chars + n_chars(part)
    return {
        "frames": b"".join(out),
        "frame_index": index,
        "n": ends + (1 if data and not data.endswith(b"\n") else 0),
        "marked": any(m in data for m in MARKERS),
    }


class Packed:
    """One stored text, read by frames."""

    def __init__(self, frames: bytes, index: list[dict], n: int):
        self.frames, self.index, self.n = memoryview(frames), index, n
        self._decompress = zstandard.ZstdDecompressor().decompress
        self._held = -1, b""

    def frame(self, i: int) -> bytes:
        """One frame's bytes; the last one asked for is kept, never more."""
        if self._held[0] != i:
            self._held = i, self._read(i)
        return self._held[1]

    def _read(self, i: int) -> bytes:
        end = self.index[i + 1]["offset"] if i + 1 < len(self.index) else len(self.frames)
        return self._decompress(self.frames[self.index[i]["offset"] : end])

    def cut(self, units: int) -> tuple[int | None, int | None]:
        """Byte and code point right after the first ``units`` units; None stands for the end of the text."""
        if units == 0:
            return 0, 0
        low, high = 0, len(self.index) - 1
        while low < high:  # the last frame that starts behind fewer line ends
            middle = (low + high + 1) // 2
            if self.index[middle]["ends"] < units:
                low = middle
            else:
                high = middle - 1
        held, data, at = self.index[low], self.frame(low), 0
        for _ in range(units - held["ends"]):
            at = data.find(b"\n", at) + 1
            if at == 0:  # the last unit has no line end
                return None, None
        return held["at"] + at, held["chars"] + n_chars(data[:at])

    def size(self) -> tuple[int, int]:
        """Bytes and code points of the whole text."""
        if not self.index:
            return 0, 0
        last = self.frame(len(self.index) - 1)
        return self.index[-1]["at"] + len(last), self.index[-1]["chars"] + n_chars(last)

    def part(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        for i, held in enumerate(self.index):
            after = self.index[i + 1]["at"] if i + 1 < len(self.index) else None
            if held["at"] >= end:
                return
            if start < end and (after is None or after > start):
                yield self.frame(i)[max(0, start - held["at"]) : end - held["at"]]


def choose(key: bytes, n: int, plain: bool, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> tuple[str, int, int]:
    """Form and the two cuts of a text of ``n`` units, drawn from the digest of ``key``."""
    drawn = hashlib.sha256(key).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if plain or h[2] % 100 >= fim_share:
        return "plain", first, last
    return ("spm" if h[3] % 100 < spm_share else "psm"), first, last


def output_stream(text: Packed, form: str, first: int, last: int) -> Callable[[], Iterator[bytes]]:
    """The output as a stream that can be started again; ``first`` and ``last`` are the byte cuts."""
    end = text.size()[0]
    prefix, middle, suffix = (0, first), (first, last), (last, end)
    if form == "plain":
        return lambda: text.part(0, end)
    order = [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle] if form == "psm" else [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]

    def stream():
        for piece in order:
            if isinstance(piece, bytes):
                yield piece
            else:
                yield from text.part(*piece)

    return stream


def _find(stream: Iterator[bytes], marker: bytes) -> int:
    """Where the marker starts in a stream, also across its pieces."""
    before, tail = 0, b""
    for piece in stream:
        held = tail + piece
        at = held.find(marker)
        if at >= 0:
            return before + at
        keep = held[-(len(marker) - 1) :]
        before, tail = before + len(held) - len(keep), keep
    raise ValueError("marker not found")


def _range(stream: Iterator[bytes], start: int, end: int | None) -> Iterator[bytes]:
    at = 0
    for piece in stream:
        cut = piece[max(0, start - at) : None if end is None else max(0, end - at)]
        if cut:
            yield cut
        at += len(piece)


def restored_stream(stream: Callable[[], Iterator[bytes]], form: str) -> Iterator[bytes]:
    """The text rebuilt from nothing but an output and its form."""
    if form == "plain":
        yield from stream()
        return
    second = _find(stream(), SUFFIX if form == "psm" else PREFIX)
    third = _find(stream(), MIDDLE)
    here, there = (3, second), (second + 3, third)
    prefix, suffix = (here, there) if form == "psm" else (there, here)
    for part in (prefix, (third + 3, None), suffix):
        yield from _range(stream(), *part)


def _digest(stream: Iterator[bytes]) -> str:
    made = hashlib.sha256()
    for piece in stream:
        made.update(piece)
    return made.hexdigest()


def store_frames(docs: DataFrame, text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The rows with their text replaced by its frames and index: other columns, frames, frame_index, n, marked.

    A null text is empty and has no frame. A row is held once while it is packed, whatever its length; after that it is only
    read frame by frame. Columns of ``docs`` that bear the new names are lengthened by ``_`` first.
    """
    names = ["frames", "frame_index", "n", "marked"]
    rest = [c for c in docs.columns if c != text]
    kept = [c if c not in names else free_names(docs, c)[0] for c in rest]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(rest, kept)], F.col(text).alias(text))
    schema = rows.drop(text).schema
    for field in StructType.fromDDL(STORED):
        schema = schema.add(field)

    def run(piece):
        packed = [pack(t or "", frame_bytes) for t in column(piece, text).to_pylist()]
        return {**{c: column(piece, c) for c in kept}, **{c: [p[c] for p in packed] for c in names}}

    return arrow_map(rows, run, text, schema)


def _planned(piece, id_column, seed, fim_share, spm_share):
    """Every stored text of a batch with its form and cuts."""
    index, counts, marked = (column(piece, c).to_pylist() for c in ("frame_index", "n", "marked"))
    frames = column(piece, "frames")
    for i, key in enumerate(column(piece, id_column).to_pylist()):
        text = Packed(frames[i].as_py(), index[i], counts[i])
        plain = marked[i] or not index[i]
        form, first, last = choose(f"{seed}:{'' if key is None else key}".encode(), counts[i], plain, fim_share, spm_share)
        end = text.size()
        cuts = [tuple(e if c is None else c for c, e in zip(text.cut(k), end)) for k in (first, last)] if form != "plain" else None
        yield text, form, cuts


def fill_in_middle(
    stored: DataFrame,
    id_column: str = "doc_id",
    seed: int = SEED,
    fim_share: int = FIM_SHARE,
    spm_share: int = SPM_SHARE,
    render: bool = False,
) -> DataFrame:
    """Form, cuts and digests of every stored text; with ``render`` the output text as well.

    Returns (id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]). Only the frames of the two
    cuts are decompressed to place them; digests are taken over streams of frames, and ``restored_sha256`` over the text
    rebuilt from the output and its form. Empty texts and texts that hold a marker are plain, without
    cuts. A null id draws as the empty string; rows that repeat an id draw alike; an empty table gives an empty result.
    """
    fields = f"n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string{', output string' if render else ''}"
    schema = stored.select(F.col(id_column).alias("_id")).schema
    for field in StructType.fromDDL(fields):
        schema = schema.add(field)

    def run(piece):
        out = {f.name: [] for f in schema.fields if f.name not in ("_id", "n")}
        for text, form, cuts in _planned(piece, "_id", seed, fim_share, spm_share):
            (first, before), (last, upto) = cuts or ((0, 0), (0, 0))
            stream = output_stream(text, form, first, last)
            out["form"].append(form)
            out["prefix_chars"].append(before if cuts else None)
            out["middle_chars"].append(upto - before if cuts else None)
            out["output_sha256"].append(_digest(stream()))
            out["restored_sha256"].append(_digest(restored_stream(stream, form)))
            if render:
                out["output"].append(b"".join(stream()).decode("utf-8"))
        return {"_id": column(piece, "_id"), "n": column(piece, "n"), **out}

    rows = stored.select(F.col(id_column).alias("_id"), "frames", "frame_index", "n", "marked")
    return arrow_map(rows, run, "frames", schema).withColumnRenamed("_id", id_column)
