"""Spelling variants by blocked Gram matrices of letter counts.

One edit changes a word's letter counts by a squared distance of at most two, and
its length by at most one.  Words are blocked by length and, within a length, by how
many letters they have of each of a few letter classes: one edit moves a word to the
same block or to one that differs by a letter in one class or in two, so only those
pairs of blocks can hold neighbours.  For each such pair a product of the two
letter-count matrices gives all squared distances at once; pairs within the bound
are compared letter by letter.  Blocks are cut into tiles, so that no product and no
row grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.session import drop_table, materialise

#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF; after lower-casing, 26 + 64 of them.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))

#: Letters fall into classes by code point.
CLASSES = 6

#: Words and letters of a tile, words of a product's right side at most.
TILE_WORDS, TILE_LETTERS, SIDE_WORDS = 1024, 1 << 20, 4096

#: A run whose id has a checksum that 97 divides loses a letter.
MISSPELT = 97

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the vocabulary; a null text has no words, a null id is written as nothing."""
    runs = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    found = found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    found = found.select("run", h.alias("h"), F.char_length("run").alias("length"))
    at = (F.col("h") % F.col("length")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("length")))
    words = found.select(F.when(F.col("h") % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _block(word: Column) -> Column:
    classes = ["".join(c for c in LETTERS if ord(c) % CLASSES == k) for k in range(CLASSES)]
    length = F.char_length(word)
    return F.array(*[length - F.char_length(F.translate(word, letters, "")) for letters in classes])


def _moves() -> list[list[int]]:
    """From a block to itself and to those of its neighbours that take it as right side.

    Of two blocks of equal length one does, of two lengths the shorter does.
    """
    zero = [0] * CLASSES
    moves = [zero]
    for i in range(CLASSES):
        moves.append([-(k == i) for k in range(CLASSES)])
        moves += [[(k == i) - (k == j) for k in range(CLASSES)] for j in range(i + 1, CLASSES)]
    return moves


def _tiles(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, tile, words, counts`` and ``block, n_tiles``."""
    blocked = words.withColumn("block", _block(F.col("word")))
    sizes = blocked.groupBy("block").agg(F.count("*").alias("n_words"), F.max(F.char_length("word")).alias("length"))
    each = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), (F.lit(TILE_LETTERS) / F.col("length")).cast("int")))
    sizes = materialise(sizes.select("block", F.ceil(F.col("n_words") / each).cast("int").alias("n_tiles")))
    tile = F.pmod(F.xxhash64("word"), F.col("n_tiles")).cast("int").alias("tile")
    dealt = blocked.join(sizes, "block").groupBy("block", tile).agg(F.collect_list(F.struct("word", "n")).alias("w"))
    return materialise(dealt.select("block", "tile", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))), sizes


class _Tile:
    """Letters, letter counts and squared norms of words of one length."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts, self.length = words, counts, len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), self.length)
        kind = np.float32 if self.length <= 4096 else np.float64  # sums of products stay exact
        cells = self.letters.astype(np.intp) + 256 * np.arange(len(words))[:, None]
        vectors = np.bincount(cells.ravel(), minlength=256 * len(words)).reshape(len(words), 256)
        self.vectors = vectors.astype(kind)
        self.norms = (self.vectors**2).sum(1)


def _near(a: _Tile, b: _Tile, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that one edit tells apart; ``b`` is as long as ``a`` or one longer."""
    used = np.flatnonzero(a.vectors.any(0) | b.vectors.any(0))
    product = a.vectors[:, used] @ b.vectors[:, used].T
    wanted = (a.norms[:, None] + b.norms[None, :] - (2 if a.length == b.length else 1)) / 2
    i, j = np.nonzero(product == wanted)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    kept = []
    for at in range(0, len(i), 1 + (1 << 22) // b.length):
        x, y = a.letters[i[at : at + 1 + (1 << 22) // b.length]], b.letters[j[at : at + 1 + (1 << 22) // b.length]]
        if a.length == b.length:
            kept.append((x != y).sum(1) == 1)
        else:
            before, after = x == y[:, :-1], x == y[:, 1:]
            # Equal up to some place, and equal from there on after the letter left out.
            head = np.logical_and.accumulate(before, 1).sum(1)
            tail = np.logical_and.accumulate(after[:, ::-1], 1).sum(1)
            kept.append(head + tail >= a.length)
    good = np.concatenate(kept)
    return i[good], j[good]


class _Best:
    """Per word of a tile: how many neighbours, and the most frequent of them."""

    def __init__(self, tile: _Tile):
        self.tile, self.found = tile, {}

    def add(self, i: np.ndarray, other: _Tile, j: np.ndarray) -> None:
        counts = other.counts[j]
        for place in np.lexsort((-counts, i)):
            mine, n, word = int(i[place]), int(counts[place]), other.words[j[place]]
            k, best = self.found.get(mine, (0, (0, "")))
            better = n > best[0] or n == best[0] and word < best[1]
            self.found[mine] = (k + 1, (n, word) if better else best)

    def rows(self) -> Iterator[tuple[str, int, int, str]]:
        for place, (k, (n, word)) in self.found.items():
            yield self.tile.words[place], k, n, word


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows hold a left and a right tile; rows of one left tile follow each other."""
    left, best, name, out = None, None, None, []

    def send() -> pa.RecordBatch:
        words, near, n, forms = zip(*out) if out else ((), (), (), ())
        out.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n_near": pa.array(near, pa.int64()), "form_n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string())})

    for batch in batches:
        for row in range(batch.num_rows):
            cell = lambda c: batch.column(batch.schema.get_field_index(c))[row]
            key = (cell("block").as_py(), cell("tile").as_py())
            if key != name:
                if best is not None:
                    out.extend(best.rows())
                name = key
                left = _Tile(cell("words").as_py(), cell("counts").values.to_numpy(zero_copy_only=False))
                best = _Best(left)
            if cell("same").as_py():
                i, j = _near(left, left, True)
                best.add(i, left, j)
                best.add(j, left, i)
            else:
                words, counts = cell("right_words").as_py(), cell("right_counts").values.to_numpy(zero_copy_only=False)
                right = _Tile(words, counts)
                i, j = _near(left, right, False)
                best.add(i, right, j)
                other = _Best(right)
                other.add(j, left, i)
                out.extend(other.rows())
            if len(out) > 20_000:
                yield send()
    if best is not None:
        out.extend(best.rows())
    yield send()


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form`` of words that have a near word; ``form`` is the most frequent of them.

    ``words`` has distinct ``word`` and ``n``.  Equal counts go to the word that is
    smaller in code-point order.
    """
    tiles, sizes = _tiles(words)
    moved = F.explode(F.array(*[F.array(*map(F.lit, m)) for m in _moves()]))
    right = tiles.select("block", F.col("tile").alias("right_tile"), F.col("words").alias("right_words"), F.col("counts").alias("right_counts"), moved.alias("move"))
    own = F.forall("move", lambda x: x == 0)
    right = right.select(
        F.zip_with("block", "move", lambda x, y: x + y).alias("block"), own.alias("own"), "right_tile", "right_words", "right_counts"
    ).where(~F.exists("block", lambda x: x < 0))
    last = F.when(F.col("own"), F.col("right_tile")).otherwise(F.col("n_tiles") - 1)
    right = right.join(sizes, "block").withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    same = F.col("own") & (F.col("tile") == F.col("right_tile"))
    nothing = [F.when(~same, F.col(c)).alias(c) for c in ("right_words", "right_counts")]
    pairs = right.select("block", "tile", same.alias("same"), *nothing).join(tiles, ["block", "tile"])
    parts = pairs.mapInArrow(_products, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the last, twice as far in each round."""
    current = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = current.join(onward, "root", "left")
        following = materialise(
            stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        )
        drop_table(current)
        current = following
    return current.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of the vocabulary.

    A word's form is its most frequent near word if that occurs at least ``ratio``
    times as often.  Null and empty texts have no words; a row counts as often as it
    is repeated; an empty table has no vocabulary and gives no rows.
    """
    words = materialise(word_counts(docs))
    near = neighbours(words)
    common = F.col("form_n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", F.when(common, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("form_n")).alias("form_n")
    )
    judged = materialise(judged)
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
