"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field reads *runs*: stretches that could hold an address or a number. A run is cut into tokens, and
candidate segments of up to ``MAX_TOKENS`` tokens are scored as whole spans. Dynamic programming over
boundaries and types picks the best cut; everything outside runs is certain to be plain text, so a document
of any length costs time in proportion to its length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from rowtide.llm.common import arrow_map, column, hash_sample, sha256_hex, texts_of

KINDS = ("email", "ip", "card", "phone")  # fixed order of the report
ORDER = {k: i for i, k in enumerate(KINDS)}

# --- base patterns ---------------------------------------------------------------------------------

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at-sign is looked at once, so long words cost no retries."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Chains of numbers and dots are taken four numbers at a time, as leftmost matches are."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", chain.group())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            values = [chain.group()[a:b].lstrip("0") or "0" for a, b in four]
            if all(len(v) <= 3 and int(v) <= 255 for v in values):
                yield chain.start() + four[0][0], chain.start() + four[3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        digits = only_digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start, then kind in the fixed order."""
    found = [(a, kind, b) for kind, finder in FINDERS.items() for a, b in finder(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[1]]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


# --- the field ---------------------------------------------------------------------------------------

MAX_TOKENS = 24
MAX_DIGITS = 19
_AT = r"(?:@|[ ]?[\[({](?:at|AT)[\])}][ ]?|[ ](?:at|AT)[ ])"
_DOT = r"(?:\.|[ ]?[\[({](?:dot|DOT|\.)[\])}][ ]?|[ ](?:dot|DOT)[ ])"
# Possessive repeats: a run is never tried again from inside.
RUN = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"
    r"|[+(]?[0-9]++(?:[ ()./\[\]-]{1,3}+[0-9]++)*+"
)
# Cheap test for a stretch worth matching RUN at.
SPOT = re.compile(r"[0-9@]|[ ]?[\[({](?:at|AT)[\])}]|[ ](?:at|AT)[ ]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
LABELS = ("none", *KINDS)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches the field reads, of any length: at least four digits, or an at-sign plain or spelled.

    The part before an at-sign has at most 64 characters, as in addresses.
    """
    end = 0
    spot = SPOT.search(text)
    while spot:
        # The run starts at or before the spot, never inside the one before.
        start = spot.start()
        while start > end and start > spot.start() - 64 and not text[start - 1].isspace():
            start -= 1
        found = RUN.search(text, start)
        if not found:
            return  # nor is there one from any later spot
        following = max(found.end(), spot.end())
        run = found.group()
        if sum("0" <= c <= "9" for c in run) >= 4 or not run[0].isdigit() and "+" != run[0] != "(":
            yield found.span()
        end = following
        spot = SPOT.search(text, following)


def tokens(run: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(run)]


def segments_from(run: str, cut: list[tuple[int, int]], i: int) -> Iterator[int]:
    """Where a span from token ``i`` may end (token past it): with a word or a number, as it begins or with a sign."""
    first = run[cut[i][0]]
    if first.isalnum() or first in "+(":
        digits, worded = 0, False
        for j in range(i + 1, min(len(cut), i + MAX_TOKENS) + 1):
            a, b = cut[j - 1]
            worded |= run[a].isalpha()
            digits += (b - a) * run[a].isdigit()
            if digits > MAX_DIGITS and not worded:
                break  # longer than any number of the four kinds
            if run[b - 1].isalnum():
                yield j


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span and of the characters at its sides."""
    span = text[start:end]
    left, right = text[start - 1 : start], text[end : end + 1]
    parts = TOKEN.findall(span)
    digits = only_digits(span)
    numbers = [p for p in parts if p[0].isdigit()]
    words = [p for p in parts if p[0].isalpha()]
    shape = " ".join(f"9{len(p)}" if p[0].isdigit() else "a" if p[0].isalpha() else p for p in parts[:24])
    lower = span.lower()
    made = [
        "bias",
        f"digits={min(len(digits), 20)}",
        f"numbers={min(len(numbers), 6)}",
        f"words={min(len(words), 4)}",
        f"sep={''.join(sorted({p for p in parts if not p[0].isalnum()}))[:6]}",
        f"first={'9' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
        f"glued={left.isalnum()}{right.isalnum()}",
        f"left={left if not left.isalnum() else 'a'}",
        f"right={right if not right.isalnum() else 'a'}",
        f"more={bool(re.match(r'[ ()./-]{1,2}[0-9]|[.@-][A-Za-z0-9]', text[end : end + 3]))}",
        f"before={bool(re.search(r'[0-9A-Za-z][(]?[-./@+%_]$|[0-9][ ]$', text[max(0, start - 3) : start]))}",
    ]
    if not words:
        made += [f"shape={shape}", f"luhn={12 <= len(digits) <= 19 and luhn(digits)}"]
        small = len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
        made.append(f"quad={small}")
        made.append(f"plus={span[0] == '+'} paren={'(' in span}")
    else:
        at = "@" in span or bool(re.search(r"[\[({ ]at[\])} ]", lower))
        dots = "." in span or bool(re.search(r"[\[({ ]dot[\])} ]", lower))
        made.append(f"at={at} dot={dots} pure={bool(re.fullmatch(r'[a-z]+', lower))}")
        made.append(f"spelled={'@' not in span} top={min(len(words[-1]), 8)} ends={parts[-1][0].isalpha()}")
    return made


class SemiMarkovField:
    """First-order semi-Markov conditional random field over ``LABELS``, log-linear in span features."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.transitions = np.zeros((len(LABELS), len(LABELS)))

    def scored(self, text: str, start: int, run: str, cut: list[tuple[int, int]], i: int):
        """The segments from token ``i`` of a run: (first, past, kind scores, features)."""
        for j in segments_from(run, cut, i):
            features = span_features(text, start + cut[i][0], start + cut[j - 1][1])
            score = np.zeros(len(KINDS))
            for f in features:
                w = self.weights.get(f)
                if w is not None:
                    score += w
            yield i, j, score, features

    def lattice(self, text: str, start: int, end: int):
        """Tokens of a run and all its scored segments."""
        run = text[start:end]
        cut = tokens(run)
        return cut, [segment for i in range(len(cut)) for segment in self.scored(text, start, run, cut, i)]

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, str, int]]:
        """The best cut of a run into typed spans and plain tokens.

        Only the scores of the last ``MAX_TOKENS`` boundaries are held; of the others two small numbers a label stay,
        the length of the last piece and the label before it, so a run may be as long as its text.
        """
        run = text[start:end]
        cut = tokens(run)
        n, m, ring = len(cut), len(LABELS), MAX_TOKENS + 1
        best = np.full((ring, m), -np.inf)
        best[0, 0] = 0.0
        length, before = np.zeros((n + 1, m), dtype=np.int8), np.zeros((n + 1, m), dtype=np.int8)
        for i in range(n):
            here = best[i % ring]
            all_ways = here[:, None] + self.transitions
            into, came = all_ways.max(0), all_ways.argmax(0)
            here[:] = -np.inf  # the place of boundary i + ring from now on
            following = best[(i + 1) % ring]
            following[0] = into[0]
            length[i + 1, 0], before[i + 1, 0] = 1, came[0]
            for _, j, score, _ in self.scored(text, start, run, cut, i):
                value = into[1:] + score
                for k in np.flatnonzero(value > best[j % ring, 1:]) + 1:
                    best[j % ring, k] = value[k - 1]
                    length[j, k], before[j, k] = j - i, came[k]
        spans, j, y = [], n, int(best[n % ring].argmax())
        while j > 0:
            i = j - int(length[j, y])
            if y:
                spans.append((start + cut[i][0], LABELS[y], start + cut[j - 1][1]))
            j, y = i, int(before[j, y])
        return spans[::-1]

    def gradient(self, text: str, start: int, end: int, gold: list[tuple[int, str, int]]):
        """Expected minus observed counts of the run's features under the present weights."""
        cut, found = self.lattice(text, start, end)
        n, m = len(cut), len(LABELS)
        forward = np.full((n + 1, m), -np.inf)
        forward[0, 0] = 0.0
        into = np.empty((n + 1, m))
        ending: list[list] = [[] for _ in range(n + 1)]
        leaving: list[list] = [[] for _ in range(n + 1)]
        for item in found:
            ending[item[1]].append(item)
            leaving[item[0]].append(item)
        for j in range(n + 1):
            if j:
                forward[j, 0] = into[j - 1, 0]
                for i, _, score, _ in ending[j]:
                    forward[j, 1:] = np.logaddexp(forward[j, 1:], into[i, 1:] + score)
            into[j] = np.logaddexp.reduce(forward[j][:, None] + self.transitions, axis=0)
        total = np.logaddexp.reduce(forward[n])
        backward = np.full((n + 1, m), -np.inf)
        backward[n] = 0.0
        step = np.full((n + 1, m), -np.inf)  # best-sum of what follows a boundary, by the next label
        pairs = np.zeros((m, m))
        for i in range(n - 1, -1, -1):
            step[i, 0] = backward[i + 1, 0]
            for _, j, score, _ in leaving[i]:
                step[i, 1:] = np.logaddexp(step[i, 1:], score + backward[j, 1:])
            way = self.transitions + step[i][None, :]
            backward[i] = np.logaddexp.reduce(way, axis=1)
            pairs += np.exp(forward[i][:, None] + way - total)
        counts: dict[str, np.ndarray] = {}
        truth = {(a, b): ORDER[k] for a, k, b in gold}
        for i, j, score, features in found:
            chance = np.exp(into[i, 1:] + score + backward[j, 1:] - total)
            k = truth.get((start + cut[i][0], start + cut[j - 1][1]))
            if k is not None:
                chance[k] -= 1.0
            if np.abs(chance).max() > 1e-4:
                for f in features:
                    counts[f] = counts[f] + chance if f in counts else chance.copy()
        # Observed transitions of the gold cut.
        marks = {a: (ORDER[k] + 1, b) for a, k, b in gold}
        i, y = 0, 0
        while i < n:
            label, stop = marks.get(start + cut[i][0], (0, start + cut[i][1]))
            pairs[y, label] -= 1.0
            y = label
            while i < n and start + cut[i][1] <= stop:
                i += 1
        return counts, pairs

    def fit(self, examples, epochs: int = 6, rate: float = 0.5, decay: float = 1e-3) -> "SemiMarkovField":
        """AdaGrad on the log-likelihood of (text, start, end, gold spans)."""
        power: dict[str, np.ndarray] = {}
        pair_power = np.full_like(self.transitions, 1e-6)
        order = random.Random(7)
        for _ in range(epochs):
            order.shuffle(examples)
            for text, start, end, gold in examples:
                counts, pairs = self.gradient(text, start, end, gold)
                for f, g in counts.items():
                    w = self.weights.setdefault(f, np.zeros(len(KINDS)))
                    g = g + decay * w
                    p = power.setdefault(f, np.full(len(KINDS), 1e-6))
                    p += g * g
                    w -= rate * g / np.sqrt(p + 0.1)
                pair_power += pairs * pairs
                self.transitions -= rate * pairs / np.sqrt(pair_power + 0.1)
        return self


# --- training ----------------------------------------------------------------------------------------

# Bound of the sample that lends the training sentences their words: documents, and characters of each.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 4000


def _card(pick: random.Random) -> str:
    body = "".join(pick.choice("0123456789") for _ in range(15))
    body = pick.choice("3456") + body[1:]
    return next(body + d for d in "0123456789" if luhn(body + d))


def _positive(pick: random.Random) -> tuple[str, str]:
    """A value of one kind, as the base patterns know it or in a way people write to dodge them."""
    kind = pick.choice(KINDS)
    name, second = ("".join(pick.choice("abcdefghiklmnoprstuvw") for _ in range(pick.randint(2, 9))) for _ in range(2))
    host = "".join(pick.choice("abcdefghiklmnoprstuvw") for _ in range(pick.randint(3, 8)))
    top = pick.choice(["com", "org", "net", "de", "fr", "es", "io"])
    if kind == "email":
        name += pick.choice(["", "", f"{pick.choice('._-')}{second}", f".{second[0]}.{second}"])
        name += pick.choice(["", "", str(pick.randint(1, 99)), f".{pick.randint(1, 99)}"])
        mid = pick.choice(["", f"mail{pick.randint(1, 9)}"])
        at, dot = pick.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("(at)", "."), ("[at]", ".")])
        return kind, name + at + dot.join(p for p in (mid, host, top) if p)
    if kind == "ip":
        dot = pick.choice([".", ".", ".", "[.]", "(.)"])
        return kind, dot.join(str(pick.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits, gap = _card(pick), pick.choice(["", " ", "-", ".", "/"])
        return kind, gap.join(digits[i : i + 4] for i in range(0, 16, 4))
    a, b, c = pick.randint(200, 989), pick.randint(200, 989), pick.randint(0, 9999)
    return kind, pick.choice([f"+1 ({a}) {b}-{c:04}", f"({a}) {b}-{c:04}", f"{a}-{b}-{c:04}", f"+{pick.randint(20, 99)} {a} {b}{c:04}", f"{a}.{b}.{c:04}", f"+1-{a}-{b}-{c:04}"])


def _negative(pick: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    r = pick.randint
    hexes = "".join(pick.choice("0123456789abcdef") for _ in range(r(16, 40)))
    return pick.choice([
        f"{r(1900, 2099)}-{r(1, 12):02}-{r(1, 28):02}", f"{r(1, 28):02}/{r(1, 12):02}/{r(1900, 2099)}", f"{r(1900, 2099)}",
        f"{r(0, 23):02}.{r(0, 59):02}", f"{r(1, 9)}.{r(0, 20)}.{r(0, 20)}", f"{r(1, 999)}.{r(0, 99):02}", f"{r(1000, 999999)}",
        f"{r(1, 9)} {r(100, 999)} {r(100, 999)}", f"{r(10**9, 10**10 - 1)}", f"{r(10**11, 10**13)}", f'"{hexes}"', hexes,
        f"{r(1, 99)} at {r(1, 99)}", f"{r(1, 400)}-{r(401, 900)}", f"978-{r(0, 9)}-{r(10, 99)}-{r(100000, 999999)}-{r(0, 9)}",
        f"{r(256, 999)}.{r(256, 999)}.{r(256, 999)}.{r(256, 999)}", f"{r(1900, 2099)} {r(1900, 2099)} {r(1900, 2099)}", "{} at {}",
        " ".join(str(r(1, 99)) for _ in range(r(4, 9))), f"{r(1000, 9999)} {r(1000, 9999)}", f"({r(1900, 2099)})",
        " ".join(f"{r(1, 9)}-{r(0, 9)}" for _ in range(r(2, 5))), " ".join(str(r(1000, 9999)) for _ in range(r(3, 5))),
        "-".join(str(r(1, 255)) for _ in range(4)), " ".join(str(r(100, 255)) for _ in range(4)),
    ])


def training_examples(texts: list[str], n: int = 1500) -> list:
    """Sentences of words from the sample with one value each, and runs of the sample with their base spans."""
    pick = random.Random(11)
    words = [w for t in texts for w in t.split()[:80] if w.isalpha()] or ["word"]
    made = []

    def add(text, gold):
        for start, end in runs(text):
            inside = [g for g in gold if g[0] >= start and g[2] <= end]
            if len(inside) == sum(g[0] < end and g[2] > start for g in gold):
                edges = {p for a, b in tokens(text[start:end]) for p in (start + a, start + b)}
                if all(g[0] in edges and g[2] in edges for g in inside):
                    made.append((text, start, end, inside))

    for i in range(n):
        left, right = pick.choice(words), pick.choice(words)
        if i % 2:
            kind, value = _positive(pick)
        else:
            kind, value = None, _negative(pick).replace("{}", pick.choice(words))
        value_start = len(left) + 1
        text = f"{left} {value}{pick.choice(['', '.', ',', ''])} {right}"
        add(text, [(value_start, kind, value_start + len(value))] if kind else [])
    for t in texts:
        taken = []
        for span in base_spans(t):
            if not taken or span[0] >= taken[-1][2]:
                taken.append(span)
        add(t, taken)
    return made


def fit_field(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> SemiMarkovField:
    """Train on made-up values in words of at most ``sample_docs`` documents.

    The sample is the rows of smallest hash among the texts of at most ``SAMPLE_CHARS`` characters; an empty
    table trains on the made-up values alone.
    """
    return SemiMarkovField().fit(training_examples(hash_sample(docs, text, sample_docs, SAMPLE_CHARS)))


def all_spans(text: str, field: SemiMarkovField) -> tuple[list, list]:
    """Base spans, and base spans with those the field adds where no base span lies."""
    base = base_spans(text)
    extra, low = [], 0
    for start, end in runs(text):
        while low < len(base) and base[low][2] <= start:
            low += 1
        past = low
        while past < len(base) and base[past][0] < end:
            past += 1
        near = base[low:past]
        for span in field.decode(text, start, end):
            if not any(s[0] < span[2] and s[2] > span[0] for s in near):
                extra.append(span)
    return base, sorted(base + extra, key=lambda s: (s[0], ORDER[s[1]]))


def find_personal_data(
    docs: DataFrame, field: SemiMarkovField, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added). The counts and the hash are
    of the base spans; ``spans`` holds all of them, ``kind:start:end`` in code points, end exclusive. Null and
    empty texts have no spans. A run of numbers or signs is read whole however long it is. Rows are not moved: repeated rows are read one by one, and other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand weights

    def run(piece):
        made: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
        for t in texts_of(piece, text):
            base, every = all_spans(t, shared.value)
            for kind in KINDS:
                made[f"n_{kind}"].append(sum(s[1] == kind for s in base))
            made["base_sha256"].append(sha256_hex(joined(base).encode()))
            made["spans"].append(joined(every))
            made["n_added"].append(len(every) - len(base))
        return {id_column: column(piece, id_column)} | made

    docs = docs.select(id_column, text)
    kind = docs.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return arrow_map(docs, run, text, f"{id_column} {kind}, {counts}, base_sha256 string, spans string, n_added bigint")
