"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds (runs of ``SEED`` words).
For each pair that shares one, the longest unmarked common run is marked again
and again (running Karp-Rabin hashes find the seeds, equal words confirm them), so
a passage whose parts were reordered is still covered part by part.  A pair counts
when the tiles cover at least ``coverage`` of the item's words.

Documents are never shuffled: each task compares its texts with a block of the
benchmark.  Blocks hold a bounded number of bytes, whatever the benchmark's size;
a larger one only means more passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import WordHashes, each, pieces, rolling, text_bytes, utf8

#: Words of the shortest tile.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Benchmark bytes that one pass holds in memory.
BLOCK_BYTES = 8 << 20
#: Pairs of equal seeds that a task holds at a time.
PAIRS_HELD = 1 << 18

RESULT = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double"


class _Unknown(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class BenchmarkBlock:
    """Word codes and seed index of some items."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = SEED):
        self.codes = _Unknown()
        self.ids, self.words = [], []
        for item, text in items:
            words = text.lower().split()
            if words:
                self.ids.append(item)
                self.words.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], np.int64))
        hashes = WordHashes()
        self.spread = np.array([0] + [hashes[w] for w in self.codes], np.uint64)
        #: Per seed length: sorted hashes with the item and place of each.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for n, words in enumerate(self.words):
            by_length.setdefault(min(seed, len(words)), []).append(n)
        for length, members in by_length.items():
            parts = [rolling(self.spread[self.words[n]], length) for n in members]
            values = np.concatenate(parts)
            owner = np.repeat(members, [len(p) for p in parts])
            place = np.concatenate([np.arange(len(p)) for p in parts])
            order = np.argsort(values, kind="stable")
            self.seeds[length] = values[order], owner[order], place[order]

    def pairs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Items that share seeds with a text: (item, seed length, item places, text
        places) of the places where a run of seeds begins.

        Seed pairs are made for some text places at a time and joined to runs at once,
        so a text and an item that repeat one word hold a row per diagonal and not one
        per pair of places.
        """
        for length, (values, owner, place) in self.seeds.items():
            found = rolling(self.spread[codes], length)
            low = np.searchsorted(values, found)
            hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == found)
            if not len(hit):
                continue
            low, high = low[hit], np.searchsorted(values, found[hit], side="right")
            n = high - low
            share = np.cumsum(n) // PAIRS_HELD
            parts = []
            for cut in np.split(np.arange(len(hit)), np.flatnonzero(share[1:] != share[:-1]) + 1):
                own = n[cut]
                at = np.repeat(low[cut] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                parts.append(_joined(owner[at], place[at], np.repeat(hit[cut], own), np.ones(len(at), np.int64)))
            items, i, j, _ = parts[0] if len(parts) == 1 else _joined(*(np.concatenate(column) for column in zip(*parts)))
            begins = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
            for first, last in zip(begins, np.r_[begins[1:], len(items)]):
                yield int(items[first]), length, i[first:last], j[first:last]


def _joined(items: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of seeds (item, item place, text place, seeds) with those that continue
    another one joined to it; ordered by item, diagonal and place."""
    order = np.lexsort((i, j - i, items))
    items, i, j, n = items[order], i[order], j[order], n[order]
    apart = (items[1:] != items[:-1]) | ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != (i + n)[:-1])
    begins = np.flatnonzero(np.r_[True, apart])
    return items[begins], i[begins], j[begins], np.add.reduceat(n, begins)


def _runs(item: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, item start, text start): the words that agree from
    each start on, words and not only hashes being compared."""
    runs = []
    for a, b in zip(i.tolist(), j.tolist()):
        length = min(len(item) - a, len(text) - b)
        differ = np.flatnonzero(item[a : a + length] != text[b : b + length])
        length = int(differ[0]) if len(differ) else length
        if length >= seed:
            runs.append((length, a, b))
    return runs


def tile(item: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles, longest first; ties go to the earlier item place, then text place."""
    heap = [(-n, a, b) for n, a, b in _runs(item, text, i, j, seed)]
    heapq.heapify(heap)
    marked_item, marked_text = np.zeros(len(item), bool), set()
    tiles, left = [], len(item)
    while heap and left >= 1:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not marked_item[a + k] and (b + k) not in marked_text for k in range(n)]
        if all(free):
            marked_item[a : a + n] = True
            marked_text.update(range(b, b + n))
            tiles.append((n, a, b))
            left -= n
            continue
        start = None
        for k in range(n + 1):
            if k < n and free[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= seed:
                    heapq.heappush(heap, (-(k - start), a + start, b + start))
                start = None
    return tiles


def _search(block: BenchmarkBlock, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = block.codes.__getitem__
        for batch in batches:
            out: list[tuple] = []
            for key, text in each(batch, 0, 1):
                words = text.lower().split()
                codes = np.fromiter(map(look, words), np.int64, len(words))
                for n, seed, i, j in block.pairs(codes):
                    item = block.words[n]
                    tiles = tile(item, codes, i, j, seed)
                    covered = sum(t[0] for t in tiles)
                    if covered >= coverage * len(item):
                        out.append((key, block.ids[n], len(item), covered, len(tiles), covered / len(item)))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64() if x == 5 else pa.int64()) for x, c in enumerate(columns)],
                names=[part.split()[0] for part in RESULT.split(", ")],
            )

    return run


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item whose tiles cover the item (RESULT).

    Words are compared with A-Z lowered.  An item shorter than a seed must occur
    whole.  Null or empty texts and items match nothing; an item of any length is
    compared with whole texts, however often either repeats its words.  Repeated rows of either table give a row each; null
    keys stay null.  Without documents or items the result is empty.
    """
    blocks = pieces(text_bytes(benchmark, item_text), block_bytes, least=1)
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), utf8(item_text).alias("body"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("body"))
    found = None
    for n in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == n).collect()  # at most about block_bytes
        block = BenchmarkBlock(sorted(((r.item, bytes(r.body)) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        hits = rows.mapInArrow(_search(block, coverage), RESULT) if block.ids else rows.mapInArrow(_none, RESULT)
        found = hits if found is None else found.unionByName(hits)
    return found


def _none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        yield from ()
