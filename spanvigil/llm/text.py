"""Words, hashes and table helpers that the operators share.

A word is a run of characters other than the ASCII blanks ``\\x20 \\x09-\\x0D``.
On UTF-8 bytes that is exactly ``bytes.split()``, and ``bytes.lower()`` lowers
exactly A-Z, so tasks work on bytes and never decode a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contract blanks as a Java regular expression class.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str) -> Column:
    """crc32 of the id's decimal text, as the contracts deal documents out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def text_bytes(frame: DataFrame, column: str) -> int:
    """Bytes of all texts: a full scan whose only use is to size partitions."""
    total = frame.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0]
    return int(total or 0)


def pieces(total: int, each: int, least: int = 8) -> int:
    """Number of bounded groups for ``total`` units."""
    return max(least, math.ceil(total / each))


class WordHashes(dict):
    """64-bit hash of a word; remembers the words of a task up to a bound.

    A remembered word takes some 150 bytes beyond its own; long ones are not kept.
    """

    BOUND, LONGEST = 60_000, 40

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.BOUND:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(hashes: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of k words: a polynomial modulo 2**64, then mixed."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(seed | 1)
    for j in range(k):
        out *= factor
        out += hashes[j : j + n]
    return mixed(out)


def columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(name)) for name in names]


def each(batch: pa.RecordBatch, *places: int) -> Iterator[tuple]:
    """Rows of a batch as Python values, one at a time.

    ``to_pylist`` would hold a second copy of all the batch's texts; here a text is
    copied when its row comes and goes with it.
    """
    taken = [batch.column(place) for place in places]
    for row in range(batch.num_rows):
        yield tuple(column[row].as_py() for column in taken)


def small(batches: Iterable[pa.RecordBatch], byte_bound: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about so many bytes, one row at least.

    A task that copies a slice's texts then holds that much and not a whole batch.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * byte_bound // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
