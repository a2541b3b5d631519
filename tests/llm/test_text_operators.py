"""Quality rules, Jaccard join, substring dedup, lattice and mixing next to brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanvigil.llm import components, jaccard_join, lattice_score, mixing, quality_rules, substring_dedup
from spanvigil.llm.components import connected_components
from spanvigil.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def in_any_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- quality rules -------------------------------------------------------------
def base_rules(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(spark, small_docs, small_rows):
    trusted = spark.createDataFrame([(7,), (7,), (None,)], "doc_id long")
    out = quality_rules.quality_rules(small_docs, trusted)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert in_any_order(got) == in_any_order((i, *base_rules(t)) for i, t in small_rows)


def test_ratio_prefers_the_target(spark):
    good = [(n, " ".join(f"alpha{(n + k * k) % 97} beta{(k * n) % 89}" for k in range(60))) for n in range(20)]
    bad = [(100 + n, " ".join(f"junk{(n * 7 + k * k) % 97}$$ spam{(k * n) % 89}" for k in range(60))) for n in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    trusted = spark.createDataFrame([(n,) for n in range(20)], "doc_id long")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted).collect()}
    assert all(rows[n].score > rows[100 + n].score for n in range(20))
    assert all(rows[n].kept for n in range(1, 20)) and not any(rows[100 + n].kept for n in range(20))


def test_ratio_is_the_log_share(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    table = quality_rules.ratio_table(docs, spark.createDataFrame([(1,)], "doc_id long"), buckets=64)
    ratios = {r.bucket: r.ratio for r in table.collect()}
    hashed = docs.selectExpr("pmod(xxhash64('a'), 64) a", "pmod(xxhash64('b'), 64) b",
                             "pmod(xxhash64(xxhash64('a'), xxhash64('b')), 64) ab",
                             "pmod(xxhash64(xxhash64('b'), xxhash64('a')), 64) ba").first()
    raw, target = Counter(), Counter()
    for part, grams in ((True, "a b a ab ba"), (False, "b")):
        for gram in grams.split():
            raw[hashed[gram]] += 1
            target[hashed[gram]] += part
    for bucket in range(64):
        want = math.log((target[bucket] + 1) / (5 + 64)) - math.log((raw[bucket] + 1) / (6 + 64))
        assert ratios[bucket] == pytest.approx(want)


def test_ratio_without_target(spark, small_docs):
    out = quality_rules.quality_rules(small_docs, spark.createDataFrame([], "doc_id long"))
    assert out.where("score <> 0").count() == 0


# --- n-gram Jaccard join --------------------------------------------------------
def jaccard_brute(rows):
    sets = []
    for i, t in rows:
        w = lowered(t)
        w = words(w)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def test_jaccard(small_docs, small_rows):
    got = jaccard_join.jaccard_components(small_docs).select("doc_id", "n_shingles", "component_id").collect()
    want = [r for r in jaccard_brute(small_rows)]
    assert in_any_order(got) == in_any_order(want)


def test_jaccard_chains_and_common_passages(spark):
    """Chains of near copies, and many short texts that share one passage."""
    import random

    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base = [], fresh(100)
    for n in range(40):
        rows.append((n, " ".join(base)))
        at = rng.randrange(97)
        base = base[:at] + fresh(1) + base[at + 1 :]
    passage = fresh(60)
    rows += [(100 + n, " ".join(fresh(rng.randint(5, 60)) + passage)) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert in_any_order(got) == in_any_order(jaccard_brute(rows))


def test_head_lengths_cover_links():
    """Any two sets at the threshold share an indexed entry, whatever the frequencies."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        common = rng.choice(10**6, n, replace=False).astype(np.uint64)
        a = np.unique(np.r_[common, rng.integers(10**6, 2 * 10**6, rng.integers(0, n // 8 + 1)).astype(np.uint64)])
        b = np.unique(np.r_[common, rng.integers(2 * 10**6, 3 * 10**6, rng.integers(0, n // 8 + 1)).astype(np.uint64)])
        a, b = a * np.uint64(2654435761) % np.uint64(2**40), b * np.uint64(2654435761) % np.uint64(2**40)
        overlap = len(np.intersect1d(a, b))
        if 100 * overlap < 80 * (len(a) + len(b) - overlap):
            continue
        rank = {int(t): int(rng.integers(2, 50)) for t in np.r_[a, b]}
        kept = []
        for s in (a, b):
            s = np.sort(s)
            head = s[: jaccard_join.head_lengths(np.array([len(s)]))[0]]
            order = sorted(head.tolist(), key=lambda t: (rank[t], t))
            kept.append(set(order[: jaccard_join.kept_lengths(np.array([len(s)]))[0]]))
        assert kept[0] & kept[1]


def test_components(spark):
    edges = [(n, n + 1) for n in range(0, 30)] + [(100, 200), (200, 150), (5, 5), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in range(31)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_stars_take_no_round_and_few_files(spark, monkeypatch):
    tables = []

    def noted(frame):
        tables.append(materialise(frame))
        return tables[-1]

    monkeypatch.setattr(components, "materialise", noted)
    stars = spark.createDataFrame([(n, n % 3) for n in range(3, 90)] + [(4, 1), (1, 4)], "a long, b long")
    got = {r.node: r.label for r in connected_components(stars, tasks=2).collect()}
    assert got == {n: n % 3 for n in range(90)}
    assert len(tables) == 1 and len(tables[0].inputFiles()) <= 2
    tables.clear()
    path = spark.createDataFrame([(n, n + 1) for n in range(40)], "a long, b long")
    assert {r.label for r in connected_components(path, tasks=2).collect()} == {0}
    assert len(tables) > 2 and connected_components(path.limit(0)).count() == 0


# --- substring dedup --------------------------------------------------------------
def dedup_brute(rows):
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(small_docs, small_rows):
    got = substring_dedup.dedup_substrings(small_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert in_any_order(got) == in_any_order(dedup_brute(small_rows))


def test_unitigs(spark):
    edges = [(1, 2, 10), (2, 3, 10), (3, 4, 5), (4, 5, 1), (4, 6, 2), (7, 8, 1), (8, 7, 1)]
    paths = substring_dedup.unitigs(spark.createDataFrame(edges, "u long, v long, gap int"))
    got = {r.node: (r.head, r.offset) for r in paths.collect()}
    assert {n: got[n] for n in (2, 3, 4)} == {2: (1, 10), 3: (1, 20), 4: (1, 25)}
    assert 5 not in got and 6 not in got  # the path branches there


def test_minimizers_agree_on_equal_windows():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(50):
        a, b = (np.r_[rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64), shared, rng.integers(0, 2**63, 30).astype(np.uint64)] for _ in "ab")
        assert set(substring_dedup.minimizers(a)[1].tolist()) & set(substring_dedup.minimizers(b)[1].tolist())


# --- lattice likelihood -------------------------------------------------------------
def test_lattice_sums_all_segmentations():
    lattice = lattice_score.Lattice({"▁".encode(): math.log(0.2), "▁a".encode(): math.log(0.3), b"a": math.log(0.1), b"b": math.log(0.1), b"ab": math.log(0.3)})
    # _ a b, _a b, _ ab
    want = 0.2 * 0.1 * 0.1 + 0.3 * 0.1 + 0.2 * 0.3
    assert lattice.log10(b"ab") == pytest.approx(math.log10(want))


def test_lattice_scores(small_docs, small_rows):
    train = Counter()
    ends = 0
    for i, t in small_rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update(words(lowered(t)))
            ends += 1
    total, types = sum(train.values()) + ends, len(train) + 1
    term = lambda c: math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
    want = []
    for i, t in small_rows:
        w = words(lowered(t))
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(w) + 1, sum(train[x] > 0 for x in w) + 1, total,
                     round(sum(term(train[x]) for x in w) + term(ends), 6)))
    got = lattice_score.lattice_scores(small_docs, bucket_bytes=4_000).collect()
    assert in_any_order((*r[:5], round(r.base_score, 6)) for r in got) == in_any_order(want)
    assert all(r.score < 0 for r in got)
    by_text = {r.n_tokens: r.score for r in got}
    assert by_text[1] == max(by_text.values())


def test_learned_shares_sum_to_one():
    with open(lattice_score.VOCABULARY, "rb") as handle:
        lattice, end = lattice_score.Lattice.learned(handle.read(), {300: 5, 400: 7}, 3)
    assert sum(map(math.exp, lattice.weights.values())) + 10**end == pytest.approx(1)


# --- mixing -----------------------------------------------------------------------
def targets_brute(sizes):
    """sizes: {source: words}; caps and reshares round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[n % 3] for n, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), dict.fromkeys(order, 0.0)
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        for s in rest:
            target[s] = left * weight[s] / sum(weight[x] for x in rest)
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        for s in over:
            target[s] = 3.0 * sizes[s]
        if not over:
            return target
        full |= over


def test_mixing(small_docs, small_rows):
    got = mixing.mix(small_docs, keep=("lang", "source")).collect()
    sizes = Counter()
    for n, (_, t) in enumerate(small_rows):
        sizes[[None, "b", "a"][n % 3]] += len(words(t))
    want = targets_brute(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(got) == len(small_rows)
    # Whole copies: a source can miss by half of its largest document where the others cannot make up for it.
    largest = {s: max(r.size for r in got if r.source == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= max(5, largest[s] / 2) for s in want)


def test_mixing_meets_targets(spark):
    rows = [(n, "w " * (1 + n * 7 % 90), f"s{n % 4}") for n in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",)).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=3)


def test_mixing_again(small_docs):
    got = mixing.mix(small_docs, keep=("lang", "source")).collect()
    assert in_any_order(got) == in_any_order(mixing.mix(small_docs, keep=("lang", "source")).collect())


def test_targets_with_full_sources(spark):
    sizes = {"a": 3, "b": 1000, "c": 10, "d": 0, "e": 40, None: 7}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = targets_brute(sizes)
    assert got == {s: pytest.approx(want[s]) for s in sizes}
    rates = {r.source: r.rate for r in mixing.balance(mixing.source_targets(frame)).collect()}
    assert all(rates[s] * n == pytest.approx(want[s], rel=1e-6) for s, n in sizes.items())


@pytest.mark.parametrize("run", [
    lambda d: quality_rules.quality_rules(d, d.select("doc_id")),
    jaccard_join.jaccard_components,
    substring_dedup.dedup_substrings,
    lattice_score.lattice_scores,
    mixing.mix,
])
def test_empty_tables(no_docs, run):
    assert run(no_docs).collect() == []
