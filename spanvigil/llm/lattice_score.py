"""Subword lattice likelihood: a document's probability over all segmentations.

An existing subword vocabulary is the lattice's alphabet; its pieces' weights are
counts of the training texts, smoothed towards the vocabulary's own ranks.  The
probability of a word sums over every way to cut it into pieces, by a forward
recursion in log space; single bytes are pieces too, so every word has one.  Pieces
do not cross blanks, so a document's probability is the product over its words and
an end sign, and each distinct word is solved once.

Documents are dealt into buckets of bounded size, words into blocks.  A bucket sends
each block its distinct words with their counts (so the most frequent word is one
entry per bucket), and gets counts and log probabilities back in the same order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import pieces, text_bytes, utf8
from spanvigil.session import drop_table, materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BUCKET_BYTES = 24 << 20
FOLDS, HELD_FOLD = 5, 1
#: Weight of the rank prior, in counts per piece.
PRIOR = 0.5
_MARK = "▁".encode()


def _block_of(word: bytes, blocks: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % blocks


def _by_block(words: set[bytes], blocks: int) -> dict[int, list[bytes]]:
    """The words of each block in sorted order: the order answers come back in."""
    out: dict[int, list[bytes]] = {}
    for word in sorted(words):
        out.setdefault(_block_of(word, blocks), []).append(word)
    return out


def _requests(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        words: set[bytes] = set()
        for text, held in zip(table.column("body").to_pylist(), table.column("held_out").to_pylist()):
            found = text.lower().split()
            if held:
                words.update(found)
            else:
                counts.update(found)
        words.update(counts)
        bucket = table.column("bucket")[0].as_py()
        parts = _by_block(words, blocks)
        return pa.table(
            {
                "block": pa.array(list(parts), pa.int32()),
                "bucket": pa.array([bucket] * len(parts), pa.int32()),
                "words": pa.array([b" ".join(p) for p in parts.values()], pa.binary()),
                "counts": pa.array([np.array([counts[w] for w in p], np.int32).tobytes() for p in parts.values()], pa.binary()),
            }
        )

    return run


def _totals(table: pa.Table) -> dict[bytes, int]:
    totals: dict[bytes, int] = {}
    for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
        for word, n in zip(words.split(b" "), np.frombuffer(counts, np.int32).tolist()):
            totals[word] = totals.get(word, 0) + n
    return totals


#: Rows of the statistics next to the pieces' counts.
_TOKENS, _TYPES = -1, -2


def _statistics(model: bytes):
    def run(table: pa.Table) -> pa.Table:
        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        known = [(w, n) for w, n in _totals(table).items() if n]
        counts = np.zeros(spm.get_piece_size(), np.int64)
        for a in range(0, len(known), 20_000):
            part = known[a : a + 20_000]
            cut = spm.encode([w.decode("utf-8", "replace") for w, _ in part], num_threads=1)
            ids = np.fromiter((i for row in cut for i in row), np.int64)
            weights = np.repeat([n for _, n in part], [len(row) for row in cut])
            counts += np.bincount(ids, weights=weights, minlength=len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        return pa.table(
            {
                "piece": pa.array([*used.tolist(), _TOKENS, _TYPES], pa.int32()),
                "n": pa.array([*counts[used].tolist(), sum(n for _, n in known), len(known)], pa.int64()),
            }
        )

    return run


class Lattice:
    """Log probabilities of pieces, keyed by their bytes."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.longest = max(map(len, weights), default=1)
        self.starts = {w[:n] for w in weights for n in range(1, len(w) + 1)}

    @classmethod
    def learned(cls, model: bytes, counts: dict[int, int], ends: int) -> tuple[Lattice, float]:
        """The lattice and the end sign's log10 probability.

        A byte piece and the letter of the same byte are one string; their shares add up.
        """
        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = spm.get_piece_size()
        usable = [i for i in range(size) if not (spm.is_unknown(i) or spm.is_control(i) or spm.is_unused(i))]
        # The vocabulary's scores fall with the rank; the prior falls as a word's frequency does.
        prior = {i: 1.0 / (2.7 + max(0.0, -spm.get_score(i))) for i in usable}
        scale = PRIOR * len(usable) / sum(prior.values())
        total = sum(counts.get(i, 0) for i in usable) + PRIOR * len(usable) + ends + PRIOR
        weights: dict[bytes, float] = {}
        for i in usable:
            name = spm.id_to_piece(i)
            text = bytes([int(name[3:-1], 16)]) if spm.is_byte(i) else name.encode()
            weights[text] = weights.get(text, 0.0) + (counts.get(i, 0) + scale * prior[i]) / total
        return cls({t: math.log(p) for t, p in weights.items()}), math.log10((ends + PRIOR) / total)

    def log10(self, word: bytes) -> float:
        """Marginal probability of a word over all segmentations."""
        text, weights, starts = _MARK + word, self.weights, self.starts
        n, longest = len(text), self.longest
        arriving: list[list[float] | None] = [None] * (n + 1)
        arriving[0] = [0.0]
        for i in range(n):
            terms = arriving[i]
            if terms is None:
                continue
            arriving[i] = None
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + math.log(sum([math.exp(t - top) for t in terms]))
            for j in range(i + 1, min(i + longest, n) + 1):
                part = text[i:j]
                if part not in starts:
                    break
                weight = weights.get(part)
                if weight is not None:
                    if arriving[j] is None:
                        arriving[j] = [here + weight]
                    else:
                        arriving[j].append(here + weight)
        terms = arriving[n]
        top = max(terms)
        return (top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10)


def _answers(lattice: Lattice):
    def run(table: pa.Table) -> pa.Table:
        totals = _totals(table)
        scores = {w: lattice.log10(w) for w in totals}
        parts = [x.split(b" ") for x in table.column("words").to_pylist()]
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "block": table.column("block"),
                "counts": pa.array([np.array([totals[w] for w in p], np.int64).tobytes() for p in parts], pa.binary()),
                "scores": pa.array([np.array([scores[w] for w in p], np.float32).tobytes() for p in parts], pa.binary()),
            }
        )

    return run


def _scored(blocks: int, tokens: int, types: int, ends: int, end_score: float):
    bottom = math.log10(tokens + 0.5 * (types + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        bodies = [t.lower() for t in docs.column("body").to_pylist()]
        words: set[bytes] = set()
        for body in bodies:
            words.update(body.split())
        parts = _by_block(words, blocks)
        found = {b: (c, s) for b, c, s in zip(*(answers.column(x).to_pylist() for x in ("block", "counts", "scores")))}
        place, counts, scores = {}, [np.array([ends], np.int64)], [np.array([end_score])]
        for block, part in parts.items():
            c, s = found[block]
            for word in part:
                place[word] = len(place) + 1
            counts.append(np.frombuffer(c, np.int64))
            scores.append(np.frombuffer(s, np.float32).astype(np.float64))
        counts, scores = np.concatenate(counts), np.concatenate(scores)
        base = np.log10(counts + 0.5) - bottom
        rows = []
        for body in bodies:
            split = body.split()
            at = np.fromiter(map(place.__getitem__, split), np.int64, len(split))
            at = np.append(at, 0)
            rows.append((len(at), int((counts[at] > 0).sum()), float(base[at].sum()), float(scores[at].sum())))
        n_tokens, known, bases, totals = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            {
                "doc_id": docs.column("id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(rows), pa.int64()),
                "base_score": pa.array(bases, pa.float64()),
                "score": pa.array(totals, pa.float64()),
            }
        )

    return run


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def lattice_scores(
    docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per document: token counts, base score and lattice score (RESULT).

    Words are lowered A-Z; each text ends with an end sign, so an empty or null text
    is one token.  A null id is dealt as the empty string, stays null, and is scored
    like any other; repeated rows are documents of their own.  Where no training text
    exists, counts are 0 and the smoothed shares decide.  An empty table gives an
    empty result; other columns are not read.
    """
    with open(vocabulary, "rb") as handle:  # on the driver; half a megabyte goes along with the tasks
        model = handle.read()
    blocks = pieces(text_bytes(docs, text), bucket_bytes)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % FOLDS == HELD_FOLD
    dealt = docs.select(
        F.col(key).cast("long").alias("id"),
        held.alias("held_out"),
        utf8(text).alias("body"),
        # By text as well: rows that repeat an id need not share a bucket.
        F.pmod(F.xxhash64(name, text), F.lit(blocks)).cast("int").alias("bucket"),
    )
    requests = materialise(
        dealt.groupBy("bucket").applyInArrow(_requests(blocks), "block int, bucket int, words binary, counts binary")
    )
    statistics = requests.groupBy("block").applyInArrow(_statistics(model), "piece int, n long")
    # At most a row per piece of the vocabulary.
    sums = {r.piece: r.n for r in statistics.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    ends = docs.select(held.alias("h")).where("not h").count()
    tokens = (sums.pop(_TOKENS, 0) or 0) + ends
    types = (sums.pop(_TYPES, 0) or 0) + (ends > 0)
    lattice, end_score = Lattice.learned(model, sums, ends)
    answers = requests.groupBy("block").applyInArrow(_answers(lattice), "bucket int, block int, counts binary, scores binary")
    return (
        dealt.groupBy("bucket")
        .cogroup(answers.groupBy("bucket"))
        .applyInArrow(_scored(blocks, tokens, types, ends, end_score), RESULT)
    )
