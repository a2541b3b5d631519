"""Personal data: base patterns and a semi-Markov conditional random field.

The patterns give the base spans, which always stay.  The field adds spans the
patterns cannot see (a phone number without its country sign, an obfuscated
address).  It scores whole segments of up to MOST_TOKENS tokens by features of the
segment, and a dynamic program chooses boundaries and types together.

Segments must hold a digit or an at sign and stay within a line.  Far from either
mark, every token can only be outside, so the program runs on regions of the tokens
that a segment with a mark can reach; with first-order scores a token that no
candidate covers cuts the chain, and the regions' solutions are the text's.  Weights are learned from a bounded sample of the given texts.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import fold, small, utf8

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# --- fixed values: the base patterns ------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs and the look-behind only save retries: a run of digits that
# fails from its start fails from each later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign ends exactly one run of local characters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start; failing matches are dropped."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text) is None:
        return found
    for m in _IP.finditer(text):
        # A part's value, without turning a very long run of digits into a number.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def listed(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


# --- segments ------------------------------------------------------------------
MOST_TOKENS = 16
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\S\n]+|\n|[^\w\s]|_|[^\W0-9]+", re.UNICODE)
_MARK = re.compile(r"[0-9@]")
_LABELS = KINDS


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every segment with a mark; disjoint, in order.

    A segment that holds a mark cannot reach over MOST_TOKENS - 1 tokens to its
    sides, nor out of its line.  Regions begin and end between tokens.
    """
    mark = _MARK.search(text)
    while mark:
        low = text.rfind("\n", 0, mark.start()) + 1
        high = text.find("\n", low)
        high = len(text) if high < 0 else high
        borders = [m.start() for m in _TOKEN.finditer(text, low, high)]
        marks = [n for n, a in enumerate(borders) if text[a] in "@0123456789"]
        borders.append(high)
        start = end = -1
        for n in marks:
            if start >= 0 and n - MOST_TOKENS + 1 > end:
                yield borders[start], borders[end]
                start = -1
            if start < 0:
                start = max(n - MOST_TOKENS + 1, 0)
            end = min(n + MOST_TOKENS, len(borders) - 1)
        yield borders[start], borders[end]
        mark = _MARK.search(text, high)


@dataclass
class Region:
    """Tokens of a region and the segments that may be entities."""

    offset: int
    tokens: list[tuple[int, int]]
    candidates: list[tuple[int, int]]
    text: str
    features: dict[tuple[int, int], list[str]] = field(default_factory=dict)


def region_of(text: str, low: int, high: int) -> Region:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, low, high)]
    candidates = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        marks = 0
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            b, e = tokens[j]
            if text[b] == "\n" or e - b > 64:
                break
            marks += text[b] in "@0123456789"
            if marks and text[b].isalnum():
                candidates.append((i, j + 1))
    # Segments that cut a word in two are never entities.
    whole = [
        (i, j)
        for i, j in candidates
        if not (tokens[i][0] > 0 and text[tokens[i][0] - 1].isalnum() and text[tokens[i][0]].isalnum())
        and not (tokens[j - 1][1] < len(text) and text[tokens[j - 1][1]].isalnum())
    ]
    return Region(low, tokens, whole, text)


_SHAPES = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))


def segment_features(region: Region, i: int, j: int) -> list[str]:
    """Features of the whole segment and of its edges."""
    known = region.features.get((i, j))
    if known is not None:
        return known
    text, a, b = region.text, region.tokens[i][0], region.tokens[j - 1][1]
    body = text[a:b]
    shape = body
    for pattern, letter in _SHAPES:
        shape = pattern.sub(letter, shape)
    groups = re.findall(r"[0-9]+", body)
    digits = "".join(groups)
    letters = any(c.isalpha() for c in body)
    before = text[a - 1] if a else "^"
    after = text[b] if b < len(text) else "$"
    feats = [
        "bias",
        "shape=" + shape[:24],
        f"digits={min(len(digits), 24)}",
        f"letters={letters}",
        f"groups={min(len(groups), 8)}",
        "lengths=" + ",".join(str(min(len(g), 9)) for g in groups[:5]),
        f"plus={body[0] == '+'}/{len(digits) >= 8}",
        f"at={body.count('@') == 1 and '.' in body.partition('@')[2]}",
        f"octets={len(groups) == 4 and body.count('.') == 3 and not letters and all(len(g) <= 3 and int(g) < 256 for g in groups)}",
        f"luhn={16 <= len(digits) <= 19 and not letters and luhn(digits)}",
        "before=" + ("d" if before.isdigit() else "a" if before.isalpha() else "s" if before.isspace() else before),
        "after=" + ("d" if after.isdigit() else "a" if after.isalpha() else "s" if after.isspace() else after),
        "next=" + ("d" if b + 1 < len(text) and text[b + 1].isdigit() else "o") + ("s" if after.isspace() else "j"),
        "prev=" + ("d" if a > 1 and text[a - 2].isdigit() else "o") + ("s" if before.isspace() else "j"),
        "quote=" + str(before in "\"'=:/#" or after in "\"'=:/"),
    ]
    region.features[i, j] = feats
    return feats


class SegmentField:
    """Semi-Markov conditional random field over regions.

    ``weights`` maps (label, feature) to a weight; tokens outside segments score 0.
    """

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights if weights is not None else {}

    def scores(self, region: Region) -> dict[int, list[tuple[int, str, float]]]:
        """By end token: (start token, label, score) of each candidate segment."""
        get, out = self.weights.get, {}
        for i, j in region.candidates:
            feats = segment_features(region, i, j)
            row = out.setdefault(j, [])
            for label in _LABELS:
                row.append((i, label, sum(get((label, f), 0.0) for f in feats)))
        return out

    def best(self, region: Region, least: float = 0.0) -> list[Span]:
        """The most likely segmentation (dynamic program over ends)."""
        ends, n = self.scores(region), len(region.tokens)
        value, choice = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, label, score in ends.get(j, ()):
                if score > least and value[i] + score > value[j]:
                    value[j], choice[j] = value[i] + score, (i, label)
        spans, j = [], n
        while j > 0:
            if choice[j] is None:
                j -= 1
                continue
            i, label = choice[j]
            spans.append((label, region.tokens[i][0], region.tokens[j - 1][1]))
            j = i
        return spans[::-1]

    def _expectations(self, region: Region) -> dict[tuple[int, int, str], float]:
        """Posterior of each candidate segment (forward and backward sums)."""
        ends, n = self.scores(region), len(region.tokens)
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [forward[j - 1]] + [forward[i] + s for i, _, s in ends.get(j, ())]
            top = max(terms)
            forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        starts: dict[int, list[tuple[int, float]]] = {}
        for j, row in ends.items():
            for i, _, s in row:
                starts.setdefault(i, []).append((j, s))
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1]] + [backward[j] + s for j, s in starts.get(i, ())]
            top = max(terms)
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        return {
            (i, j, label): math.exp(forward[i] + s + backward[j] - forward[n]) for j, row in ends.items() for i, label, s in row
        }

    def learn(self, examples: list[tuple[Region, set[Span]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Stochastic gradient on the conditional likelihood, in a fixed order."""
        order = random.Random(7)
        for epoch in range(epochs):
            order.shuffle(examples)
            step = rate / (1 + epoch)
            for region, gold in examples:
                for (i, j, label), p in self._expectations(region).items():
                    true = (label, region.tokens[i][0], region.tokens[j - 1][1]) in gold
                    change = step * (true - p)
                    if abs(change) > 1e-3 * step:
                        for f in segment_features(region, i, j):
                            key = (label, f)
                            self.weights[key] = self.weights.get(key, 0.0) * (1 - decay) + change


# --- training examples ---------------------------------------------------------
def _variant(kind: str, body: str, rng: random.Random) -> str:
    """The same datum in a form that the base patterns miss."""
    digits = re.sub(r"\D", "", body)
    if kind == "phone":
        tail = digits[-10:]
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "({}){}-{}", "{}.{}.{}"]).format(tail[:3], tail[3:6], tail[6:])
    if kind == "card":
        four = [digits[n : n + 4] for n in range(0, len(digits), 4)]
        return rng.choice(["  ", ".", " - "]).join(four)
    if kind == "email":
        return body.replace("@", rng.choice([" @ ", "(@)", " [@] ", "@ "]))
    return body.replace(".", rng.choice(["-", " . "]), 3)


def examples_from(texts: list[str], seed: int = 11) -> list[tuple[Region, set[Span]]]:
    """Regions with their base spans as labels, and copies with variants put in."""
    rng, out = random.Random(seed), []
    for text in texts:
        base = base_spans(text)
        for low, high in list(regions(text))[:8]:
            inside = [s for s in base if low <= s[1] and s[2] <= high]
            piece = text[low:high]
            out.append((region_of(piece, 0, len(piece)), {(k, a - low, b - low) for k, a, b in inside}))
            for kind, a, b in inside:
                changed = _variant(kind, text[a:b], rng)
                piece = text[low:a] + changed + text[b:high]
                others = {
                    (k, s - low + (len(changed) - (b - a)) * (s >= b), e - low + (len(changed) - (b - a)) * (s >= b))
                    for k, s, e in inside
                    if (k, s, e) != (kind, a, b) and (e <= a or s >= b)
                }
                out.append((region_of(piece, 0, len(piece)), others | {(kind, a - low, a - low + len(changed))}))
    return out


#: Documents that the weights are learned from, at most.
SAMPLE = 150
#: Score a segment needs before it may be chosen (log odds against "outside").
LEAST_SCORE = 1.5
#: Shape counts of the synthetic examples used next to the sample.
_SYNTHETIC = 200


def synthetic_texts(rng: random.Random) -> list[str]:
    """Plain sentences with data of each kind and with harmless numbers."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = "4" + some(14)
        return head + next(d for d in "0123456789" if luhn(head + d))

    makers = (
        lambda: f"{word()}.{some(2)}@{word()}.{word()}.com",
        lambda: f"{word()}@{word()}.org",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+{rng.randint(1, 99)} ({some(3)}) {some(3)}-{some(4)}",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"in {rng.randint(1900, 2030)}, {some(rng.randint(1, 7))} of {some(rng.randint(1, 5))}",
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: f"{some(4)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} at {some(2)}:{some(2)}",
        lambda: f"id {some(rng.randint(9, 22))}",
    )
    texts = []
    for n in range(_SYNTHETIC):
        middle = makers[n % len(makers)]()
        texts.append(" ".join([word() for _ in range(5)] + [middle] + [word() for _ in range(5)]) + rng.choice(["", ".", ", ", "***"]))
    return texts


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> SegmentField:
    """Learn from at most ``sample`` texts with marks, the first by the id's crc32."""
    marked = docs.where(F.col(text).rlike("[0-9@]")).select(fold(key).alias("_order"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    # Ids first, then the sampled texts' marked stretches only: whole texts stay on the executors.
    chosen = marked.where("_id is not null").select("_order", "_id").distinct().orderBy("_order", "_id").limit(sample)
    stretch = F.regexp_extract_all("_text", F.lit(r"((?s).{0,40}[0-9@].{0,120})"), 1)
    first = marked.join(F.broadcast(chosen.select("_id")), "_id").select(F.slice(stretch, 1, 8).alias("pieces")).collect()
    texts = sorted(piece for row in first for piece in row.pieces or ())
    model = SegmentField()
    model.learn(examples_from(synthetic_texts(random.Random(5)) + texts))
    return model


def find_spans(text: str, model: SegmentField) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for low, high in regions(text):
        for kind, a, b in model.best(region_of(text, low, high), LEAST_SCORE):
            if not any(a < y and x < b for x, y in taken):
                added.append((kind, a, b))
    return base, base + added


_COUNTS = [f"n_{k}" for k in KINDS]
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _detect(model: SegmentField):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS}
            digests, spans = [empty] * n, [""] * n
            for row, body in enumerate(batch.column(1).to_pylist()):
                if not body or _MARK.search(body) is None:
                    continue
                base, every = find_spans(body, model)
                for kind, _, _ in base:
                    counts[kind][row] += 1
                if base:
                    digests[row] = hashlib.sha256(listed(base).encode()).hexdigest()
                spans[row] = listed(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(spans)],
                names=["doc_id", *_COUNTS, "base_sha256", "spans"],
            )

    return run


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", model: SegmentField | None = None) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans.

    Spans are code point offsets, end exclusive, ``kind:start:end`` by kind, then
    start.  A null text is empty and holds nothing.  Repeated rows and ids are each
    reported; a null id stays null; texts of any length are read whole.  Without
    documents the result is empty.  Other columns are not read.
    """
    model = model or train(docs, text, key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(_detect(model), RESULT)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", model: SegmentField | None = None) -> DataFrame:
    """``docs`` with every span found replaced by its kind; same columns and rows.

    ``n_chars``, where present, is the new length.  Null texts stay null.
    """
    model = model or train(docs, text, key)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bodies = batch.column(place).to_pylist()
            for row, body in enumerate(bodies):
                if body and _MARK.search(body):
                    bodies[row] = redact_text(body, find_spans(body, model)[1])
            yield batch.set_column(place, batch.schema.field(place), pa.array(bodies, batch.schema.field(place).type))

    changed = docs.mapInArrow(run, docs.schema)
    return changed.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
