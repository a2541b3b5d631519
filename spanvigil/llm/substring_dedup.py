"""Substring dedup by a compacted de Bruijn graph of token k-mers.

A passage counts when WINDOW consecutive words start in an earlier document too.

1. Each text's k-mers of K words are thinned to minimizers: of every WINDOW words,
   the smallest k-mer hash stays.  Equal windows keep the same k-mer, so whatever
   repeats shares nodes (``_minimizers``).
2. Nodes found in two documents and their neighbourhood in the texts are the graph:
   an edge is a step from one node to the next with its distance.  Nonbranching
   paths are compacted by pointer jumping, a join per doubling (``unitigs``).
3. A document's nodes on one path become one span with source coordinates.
4. A shared window's smallest k-mer is a node of a span.  The windows with such a
   k-mer are checked on the text itself: their hash finds the earliest document.

Hot passages meet only in minima and joins, never in a gathered group; what is
gathered per document is bounded by its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.llm.text import WordHashes, each, rolling, signed, utf8
from spanvigil.session import drop_table, materialise

WINDOW = 50
K = 15


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width``, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minimizers(hashes: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are smallest in some window (all ties)."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kmers, width = rolling(hashes, k), window - k + 1
    least = _sliding(kmers, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    # A k-mer stays if it equals the largest of the minima of its windows.
    held = np.flatnonzero(kmers == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
    return held, kmers[held]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        counts, prints, marks, places, kmers = [], [], [], [], []
        for key, text in zip(ids, batch.column(1).to_pylist()):
            words = text.split()
            counts.append(len(words))
            prints.append(hashlib.sha256(b" ".join(words)).digest())
            marks.append(_mark(prints[-1]))
            at, values = minimizers(hashes.of(words)) if key is not None and len(words) >= WINDOW else minimizers(np.empty(0))
            places.append(at.astype(np.int32))
            kmers.append(signed(values))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array(marks, pa.int64()),
                pa.array(places, pa.list_(pa.int32())),
                pa.array(kmers, pa.list_(pa.int64())),
            ],
            names=["id", "n_words", "print", "mark", "places", "kmers"],
        )


def _mark(digest: bytes) -> int:
    """What tells rows that repeat an id apart, in eight bytes."""
    return int.from_bytes(digest[:8], "little", signed=True)


def unitigs(edges: DataFrame) -> DataFrame:
    """Compact nonbranching paths: ``node, head, offset`` for nodes behind a head.

    ``edges`` are distinct ``u, v, gap``.  A step is followed when it is the only way
    out of u and the only way into v.  Each round doubles the distance that a node
    looks back, until all look at the head of their path.  Nodes of a closed ring
    have no head; they are left out and so stay paths of their own.
    """
    out = edges.groupBy("u").agg(F.count("*").alias("outs"))
    into = edges.groupBy("v").agg(F.count("*").alias("ins"))
    steps = edges.join(out.where("outs = 1"), "u").join(into.where("ins = 1"), "v").where("u <> v")
    state = materialise(steps.select(F.col("v").alias("node"), F.col("u").alias("head"), F.col("gap").cast("long").alias("offset")))
    nodes, reach = state.count(), 1
    while reach <= 2 * max(nodes, 1):
        back = state.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("offset").alias("_offset"))
        following = materialise(
            state.join(back, "head", "left").select(
                "node",
                F.coalesce("_head", "head").alias("head"),
                (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"),
                F.col("_head").isNotNull().alias("moved"),
            )
        )
        drop_table(state)
        moved = following.where("moved").limit(1).count()
        state, reach = following, 2 * reach
        if not moved:
            break
    return state.where("not moved").select("node", "head", "offset") if "moved" in state.columns else state


def _reached(kmers: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Windows whose smallest k-mer lies between the first and last node of a span."""
    width = WINDOW - K + 1
    held = np.zeros(len(kmers), bool)
    for span in spans:
        held[span["start"] : span["end"] + 1] = True
    least = _sliding(kmers, width, np.minimum)
    inside = _sliding(np.where(held, kmers, np.uint64(2**64 - 1)), width, np.minimum)
    return np.flatnonzero(least == inside)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that a document's spans reach."""
    hashes = WordHashes()
    for batch in batches:
        marks, places, values = [], [], []
        for text, spans in each(batch, 1, 2):
            words = text.split()
            marks.append(_mark(hashlib.sha256(b" ".join(words)).digest()))
            found = hashes.of(words)
            at = _reached(rolling(found, K), spans) if len(words) >= WINDOW else np.empty(0, np.int64)
            places.append(at.astype(np.int32))
            values.append(signed(rolling(found, WINDOW)[at] if len(at) else np.empty(0, np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(marks, pa.int64()),
                pa.array(places, pa.list_(pa.int32())),
                pa.array(values, pa.list_(pa.int64())),
            ],
            names=["id", "body", "mark", "places", "windows"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests = [], []
        for text, starts in each(batch, 2, 3):
            words = text.split()
            steps = np.zeros(len(words) + 1, np.int64)
            starts = np.array(starts, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + WINDOW, -1)
            gone = np.cumsum(steps)[:-1] > 0
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests)],
            names=["id", "mark", "n_removed", "digest"],
        )


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur under two ids, with the smallest (map-side minima)."""
    ends = rows.groupBy(key).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return ends.where("first_id < last_id").select(key, "first_id")


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word goes when one of the windows over it starts in a document with a smaller
    id as well; windows are judged on the input.  Null texts are empty, and the
    digest of nothing is that of the empty string.  A row with a null id keeps all
    its words and removes none elsewhere.  Rows that repeat an id are each returned;
    they do not remove from each other.  An empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body"))
    first = materialise(
        rows.mapInArrow(_minimizers, "id long, n_words long, print binary, mark long, places array<int>, kmers array<long>")
    )
    nodes = first.where("size(kmers) > 0").select("id", "places", F.posexplode("kmers").alias("nth", "node"))
    nodes = nodes.select("id", "node", "nth", F.get("places", F.col("nth")).alias("place"))
    repeated = _shared(nodes, "node")
    hits = materialise(nodes.join(repeated.select("node"), "node"))
    summary = materialise(first.select("id", "n_words", "print", "mark"))
    drop_table(first)

    along = Window.partitionBy("id").orderBy("nth", "place")
    steps = hits.select(
        F.col("node").alias("u"),
        F.lead("node").over(along).alias("v"),
        (F.lead("place").over(along) - F.col("place")).alias("gap"),
        (F.lead("nth").over(along) - F.col("nth")).alias("by"),
    ).where("by = 1")
    paths = unitigs(materialise(steps.select("u", "v", "gap").distinct()))
    placed = hits.join(paths, "node", "left").select(
        "id", "place", F.coalesce("head", "node").alias("head"), (F.col("place") - F.coalesce("offset", F.lit(0))).alias("origin")
    )
    spans = placed.groupBy("id", "head", "origin").agg(
        F.min("place").cast("int").alias("start"), F.max("place").cast("int").alias("end")
    )
    of_document = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    checked = materialise(
        rows.join(of_document, "id")
        .select("id", "body", "spans")
        .mapInArrow(_windows, "id long, body binary, mark long, places array<int>, windows array<long>")
    )
    drop_table(hits)
    windows = checked.where("size(windows) > 0").select("id", "mark", F.explode(F.arrays_zip("places", "windows")).alias("w"))
    windows = windows.select("id", "mark", F.col("w.places").alias("place"), F.col("w.windows").alias("window"))
    early = _shared(windows, "window")
    late = windows.join(early, "window").where("first_id < id")
    starts = late.groupBy("id", "mark").agg(F.collect_set("place").alias("starts"))
    bodies = checked.select("id", "mark", "body").dropDuplicates(["id", "mark"])
    cut = bodies.join(starts, ["id", "mark"]).select("id", "mark", "body", "starts")
    results = cut.mapInArrow(_cut, "id long, mark long, n_removed long, digest string")
    return (
        summary.join(results, ["id", "mark"], "left")
        .select(
            F.col("id").alias(key),
            "n_words",
            F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
            F.coalesce("digest", F.lower(F.hex("print"))).alias("kept_sha256"),
        )
    )
