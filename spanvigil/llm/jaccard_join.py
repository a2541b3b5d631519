"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The incidence matrix has a row per document and a column per hashed shingle.
Only a part of each row can matter.  Sort a row of n shingles in an order that all
rows share: two rows with Jaccard similarity t have one of their first
``n - ceil(t n) + 1`` entries in common, and l of their first ``n - ceil(t n) + l``.

1. Tasks keep such a head of each row by hash order, in chunks of documents
   (``_chunks``).
2. The columns are dealt into blocks, which sum how many documents hold each
   shingle (``_frequencies``); a chunk sends a column once, with its count, so the
   hottest column brings one entry per chunk.
3. Back at the chunk, l shared entries are needed, so a row's l-1 most frequent ones
   may be skipped; a row that then has no shared entry left links with nothing
   (``_index``).  Most rows end here, those that only share a short passage too.
4. The rows left go through 2 and 3 with their whole sets.  Frequencies are now
   exact among all that could link: the rarest ``n - ceil(t n) + 1`` entries are the
   index, and entries nobody else has bound the overlap from above.
5. Rows that meet in a column are compared: first each with the column's most
   central row (the fewest entries of its own), then, a few times, those outside the
   column's largest component with another row of it.  That joins large groups of
   near copies by a few comparisons per row.
6. Last come all pairs of one column whose rows are in different components still,
   unless a bound rules the link out: the sizes, the entries' places, or the distances
   to the column's first centre (Jaccard distance obeys the triangle inequality).

Every pair that could link shares an indexed column, and is either compared or
already connected, so components are exact up to 64-bit hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.components import connected_components
from spanvigil.llm.text import WordHashes, each, pieces, rolling, signed, text_bytes, utf8
from spanvigil.session import drop_table, materialise

WIDTH = 5
#: Further rounds of comparing with one row per column, at most.
ROUNDS = 4
#: Similarity as whole percent: links hold when 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Text bytes of a chunk of documents, and of the texts behind one block of columns.
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
#: Text bytes behind one task that writes a table of pairs, edges or labels: a few
#: rows need not be written by as many tasks as the session has shuffle partitions.
TASK_BYTES = 2 << 20

_CHUNK = "chunk long, ids array<long>, sets array<long>, sizes array<int>, heads binary"


def shingles(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a short text is one shingle, an empty one none."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.of(words)
    if len(words) < width:
        return rolling(values, len(words), seed=0xD6E8FEB86659FD93 + 2 * len(words))
    return np.unique(rolling(values, width))


def _extra(sizes: np.ndarray) -> np.ndarray:
    """Shared head entries beyond the first that a linked pair must have."""
    return sizes * 8 // 100


def head_lengths(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-sizes * PERCENT // 100) + _extra(sizes) + 1, 0)


def kept_lengths(sizes: np.ndarray) -> np.ndarray:
    """Head entries to index: a partner may be as small as PERCENT of the row."""
    smallest = -(-sizes * PERCENT // 100)
    return head_lengths(sizes) - _extra(smallest)


def set_key(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes(), seed=len(values))


def _chunks(width: int, chunk_bytes: int, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, keys, sizes, heads, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            body = np.concatenate(heads).tobytes() if heads else b""
            # The table is written before it is used, so a chunk's name only has to be unlike the others.
            name = xxhash.xxh3_64_intdigest(body, seed=xxhash.xxh3_64_intdigest(repr(ids).encode())) >> 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([signed(np.array(keys, np.uint64))], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([body], pa.binary()),
                ],
                names=["chunk", "ids", "sets", "sizes", "heads"],
            )

        for batch in batches:
            for key, text in each(batch, 0, 1):
                values = shingles(text.lower().split(), hashes, width)
                n = len(values)
                ids.append(key)
                keys.append(set_key(values))
                sizes.append(n)
                if key is not None and n:
                    heads.append(values if whole else values[: int(head_lengths(np.array([n]))[0])])
                held += len(text) + 1
                if held >= chunk_bytes:
                    yield flush()
                    ids, keys, sizes, heads, held = [], [], [], [], 0
        if ids:
            yield flush()

    return run


def _requests(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, counts = np.unique(np.frombuffer(body, np.uint64), return_counts=True)
                counts = np.minimum(counts, 255).astype(np.uint8)
                block = (tokens % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                tokens, counts, block = tokens[order], counts[order], block[order]
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
                ends = np.r_[cuts[1:], len(block)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[cuts], pa.int32()),
                        pa.array(np.full(len(cuts), chunk), pa.int64()),
                        pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    ],
                    names=["block", "chunk", "tokens", "counts"],
                )

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Document counts of one block's shared shingles, returned to each chunk."""
    chunks = table.column("chunk").to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    distinct, where = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)
    found, tokens, sums, start = [], [], [], 0
    for chunk, part in zip(chunks, parts):
        total = totals[where[start : start + len(part)]]
        start += len(part)
        shared = total > 1
        if shared.any():
            found.append(chunk)
            tokens.append(part[shared].tobytes())
            sums.append(total[shared].tobytes())
    return pa.table(
        [pa.array(found, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sums, pa.binary())],
        names=["chunk", "tokens", "totals"],
    )


def _placed(answers: pa.Table, chunk: pa.Table, whole: bool):
    """Row number, token, frequency of a chunk's entries, rarest first in each row."""
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("tokens").to_pylist()])
    totals = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("totals").to_pylist()])
    order = np.argsort(tokens)
    tokens, totals = tokens[order], totals[order]
    row = chunk.slice(0, 1).to_pylist()[0]
    sizes = np.array(row["sizes"], np.int64)
    usable = np.array([key is not None for key in row["ids"]], bool)
    lengths = np.where(usable, sizes if whole else head_lengths(sizes), 0)
    owner = np.repeat(np.arange(len(sizes)), lengths)
    heads = np.frombuffer(row["heads"], np.uint64)
    at = np.minimum(np.searchsorted(tokens, heads), len(tokens) - 1)
    total = np.where(tokens[at] == heads, totals[at], 1)
    order = np.lexsort((heads, total, owner))
    place = np.arange(len(heads)) - (np.cumsum(lengths) - lengths)[owner]  # lexsort keeps each row's span
    return owner, place, heads[order], total[order], sizes, np.array(row["sets"], np.int64)


def _survivors(answers: pa.Table, chunk: pa.Table) -> pa.Table:
    """Rows whose head, without its most frequent entries, shares one with others."""
    if not answers.num_rows or not chunk.num_rows:
        return pa.table({"node": pa.array([], pa.int64())})
    owner, place, _, total, sizes, sets = _placed(answers, chunk, whole=False)
    keep = (total > 1) & (place < kept_lengths(sizes)[owner])
    return pa.table({"node": pa.array(np.unique(sets[owner[keep]]), pa.int64())})


_INDEX = "token long, node long, size int, own int, place int"


def _index(answers: pa.Table, chunk: pa.Table) -> pa.Table:
    """The rarest shared entries of each whole row, with their places among all of it
    and the count nobody shares."""
    if not answers.num_rows or not chunk.num_rows:
        columns = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        return pa.table(columns, names=["token", "node", "size", "own", "place"])
    owner, place, tokens, total, sizes, sets = _placed(answers, chunk, whole=True)
    own = np.bincount(owner, weights=total == 1, minlength=len(sizes)).astype(np.int32)
    keep = (total > 1) & (place < (sizes - -(-sizes * PERCENT // 100) + 1)[owner])
    owner, tokens, place = owner[keep], tokens[keep], place[keep]
    return pa.table(
        {
            "token": pa.array(signed(tokens), pa.int64()),
            "node": pa.array(sets[owner], pa.int64()),
            "size": pa.array(sizes[owner].astype(np.int32), pa.int32()),
            "own": pa.array(own[owner], pa.int32()),
            "place": pa.array(place.astype(np.int32), pa.int32()),
        }
    )


def _with_frequencies(chunks: DataFrame, blocks: int, finish, schema: str) -> DataFrame:
    requests = chunks.select("chunk", "heads").mapInArrow(
        _requests(blocks), "block int, chunk long, tokens binary, counts binary"
    )
    answers = requests.groupBy("block").applyInArrow(_frequencies, "chunk long, tokens binary, totals binary")
    return answers.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(finish, schema)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole row of a chunk by itself."""
    for batch in batches:
        for sets, sizes, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ends = np.cumsum(sizes) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.int64()), pa.array([body[b - 8 * n : b] for n, b in zip(sizes, ends.tolist())], pa.binary())],
                names=["node", "members"],
            )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(i).to_pylist() for i in (2, 3))
        distances, linked = [], []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            overlap = int((y[at] == x).sum())
            union = len(x) + len(y) - overlap
            distances.append(1 - overlap / union)
            linked.append(100 * overlap >= PERCENT * union)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(distances, pa.float64()), pa.array(linked, pa.bool_())],
            names=["a", "b", "distance", "linked"],
        )


def _compared(pairs: DataFrame, chunks: DataFrame, tasks: int) -> DataFrame:
    """Pairs of sets (a, b) with their distance and whether they link."""
    sets = chunks.select("sets", "sizes", "heads").mapInArrow(_members, "node long, members binary")
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    # The many-sided end first: its set moves once per pair, the centre's once in all.
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialise(both.coalesce(tasks).mapInArrow(_overlaps, "a long, b long, distance double, linked boolean"))


def _apart(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Index entries of the columns whose rows are in more than one component."""
    named = index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return named.join(split.select("token"), "token", "left_semi")


def _untested(pairs: DataFrame, tested: DataFrame, tasks: int) -> DataFrame:
    """Pairs, once each way round, that have not been compared."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialise(once.join(done, ["a", "b"], "left_anti").coalesce(tasks))


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links.  A text without words
    (or null) has no shingles and links with nothing: its component is itself.  A
    row with a null id is returned with a null component and takes no part in
    links.  Rows that repeat an id are returned each; an id whose rows differ in
    text joins the components of all of them only through its smallest id.  Ties
    need no rule: the result does not depend on any order.  An empty table gives
    an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("_id"), utf8(text).alias("_text"))
    total = text_bytes(docs, text)
    blocks, tasks = pieces(total, BLOCK_BYTES), pieces(total, TASK_BYTES)
    heads = materialise(rows.mapInArrow(_chunks(width, CHUNK_BYTES), _CHUNK))
    left = materialise(_with_frequencies(heads, blocks, _survivors, "node long").distinct())
    members = materialise(
        heads.select(F.inline(F.arrays_zip("ids", "sets", "sizes"))).select(
            F.col("ids").alias("_id"), F.col("sets").alias("node"), F.col("sizes").alias("size")
        )
    )
    drop_table(heads)
    # Equal sets are one row from here on, under their smallest id.
    classes = materialise(members.where("_id is not null and size > 0").groupBy("node").agg(F.min("_id").alias("first_id")))

    wanted = classes.join(left, "node", "left_semi").select(F.col("first_id").alias("_id"))
    texts = rows.join(wanted.hint("merge"), "_id", "left_semi").select("_id", "_text")
    chunks = materialise(texts.coalesce(tasks).mapInArrow(_chunks(width, CHUNK_BYTES, whole=True), _CHUNK))
    index = materialise(_with_frequencies(chunks, blocks, _index, _INDEX).distinct())

    # A link needs an overlap of 80 / 180 of both sizes.  Where a pair's rarest common
    # entry is met, that is all either row has left: entries before it are not shared.
    able = f"{100 + PERCENT} * least(size - place, other_size - other_place) >= {PERCENT} * (size + other_size)"
    centres = (
        index.groupBy("token")
        .agg(F.min(F.struct((F.col("own") / F.col("size")).alias("share"), "node", "size", "place")).alias("centre"))
        .select(
            "token",
            F.col("centre.node").alias("other"),
            F.col("centre.size").alias("other_size"),
            F.col("centre.place").alias("other_place"),
        )
    )
    star = index.join(centres, "token").where("node <> other").where(able)
    first = _compared(star.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), chunks, tasks)
    tested, labels = first, materialise(connected_components(first.where("linked"), tasks=tasks).coalesce(tasks))

    def joined(links: DataFrame) -> DataFrame:
        """The labels with further links; a component so far is the star of its label."""
        so_far = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        return connected_components(so_far.unionByName(links.where("linked").select("a", "b")), tasks=tasks)

    for number in range(ROUNDS + 1):
        apart = materialise(_apart(index, labels).coalesce(tasks))
        if number == ROUNDS:
            break
        main = apart.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(
            F.max(F.struct("n", "label"))["label"].alias("main")
        )
        marked = apart.join(main, "token")
        picked = marked.where("label = main").groupBy("token").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "size", "place")).alias("row")
        )
        again = picked.select("token", *[F.col(f"row.{c}").alias(f"other_{c}") for c in ("node", "size", "place")])
        met = marked.where("label <> main").join(again, "token").where(able)
        pairs = met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()
        found = _compared(_untested(pairs, tested, tasks), chunks, tasks)
        tested = tested.unionByName(found)
        if found.where("linked").isEmpty():
            break
        labels = materialise(joined(found).coalesce(tasks))

    # Distances to the column's first centre; unknown where a bound spared the comparison.
    to_centre = first.select(F.col("a").alias("node"), F.col("b").alias("other"), "distance")
    apart = apart.join(centres.select("token", "other"), "token").join(to_centre, ["node", "other"], "left")
    from_centre = F.when(F.col("node") == F.col("other"), F.lit(0.0)).otherwise(F.col("distance"))
    apart = materialise(apart.withColumn("distance", from_centre).drop("other").coalesce(tasks))
    others = apart.select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "size", "place", "label", "distance")])
    near = f"coalesce(abs(distance - other_distance), 0) <= {(100 - PERCENT) / 100 + 1e-9}"
    met = apart.join(others, "token").where("node < other_node and label <> other_label").where(able).where(near)
    late = _compared(_untested(met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct(), tested, tasks), chunks, tasks)
    if not late.where("linked").isEmpty():
        labels = joined(late)
    ids = labels.join(classes, "node").groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = labels.join(ids, "label").select("node", "component_id")
    of_class = classes.join(of_node, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("_component"))
    return members.join(of_class, "node", "left").select(
        F.col("_id").alias(key),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.when(F.col("size") > 0, F.col("_component")).otherwise(F.col("_id"))).alias("component_id"),
    )
