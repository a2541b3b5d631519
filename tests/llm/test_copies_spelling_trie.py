"""Exact copies, spelling variants and the prefix trie next to brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanvigil.llm import prefix_trie, radix_dedup, spelling_groups
from spanvigil.llm.running import running_sums
from tests.llm.conftest import table


def collected(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


# --- exact copies -----------------------------------------------------------


def copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep, taken = max(ids, key=lambda i: (i is not None, i or 0)), False
        for doc_id in ids:
            stays = doc_id == keep and not taken
            taken |= stays
            out.append((doc_id, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_copies_of_awkward_texts(spark, small_docs, small_rows, no_docs):
    assert collected(radix_dedup.dedup(small_docs)) == copies(small_rows)
    assert radix_dedup.dedup(no_docs).collect() == []


def test_texts_that_end_or_part_at_digit_borders(spark):
    long = "é" * 40_000
    texts = ["b" * n for n in (63, 64, 65, 191, 192, 193, 447, 448, 449) for _ in range(2)]
    texts += [long, long, long + "x", long[:-1] + "y", "b" * 64 + "c", "b" * 192 + "c"]
    rows = list(enumerate(texts)) + [(0, "b" * 63), (None, "b" * 64), (None, "b" * 64)]
    assert collected(radix_dedup.dedup(table(spark, rows))) == copies(rows)


def test_long_digits_stop_growing(spark, monkeypatch):
    monkeypatch.setattr(radix_dedup, "FIRST", 2)
    monkeypatch.setattr(radix_dedup, "DOUBLINGS", 2)
    rows = [(n, "ab" * (n // 2)) for n in range(60)] + [(100, "ab" * 20 + "x"), (101, "ab" * 20 + "y")]
    assert collected(radix_dedup.dedup(table(spark, rows))) == copies(rows)


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(n, "one text of many rows " * 9 if n % 3 == 0 else f"text {n}") for n in range(3_000)]
    assert collected(radix_dedup.dedup(table(spark, rows))) == copies(rows)


def test_copies_carry_asked_columns(spark):
    kept = radix_dedup.dedup(table(spark, [(1, "a"), (2, "a"), (3, None)]), keep=("id", "size")).collect()
    assert {(r["id"], r["size"]) for r in kept} == {("clash", 1)}


# --- spelling variants ------------------------------------------------------


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    words = vocabulary(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(2)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 8))) for _ in range(260)]
    rows = [(i, rng.choice([" ", "-", "9"]).join(rng.choice(words) for _ in range(60))) for i in range(200)]
    long = ["x" * 5_000, "x" * 5_001, "x" * 4_999 + "y"]
    rows += [(1, "Hello hello HELLO hallo hallo Hallo hell×o hell÷o " * 3), (2, " ".join(long * 3)), (None, "hellos " * 4)]
    return rows + [(None, None), (3, ""), (4, "ÉĀ¿"), rows[0], rows[0]]


@pytest.mark.parametrize("tile", [5, 1024])
def test_variants_against_all_pairs(spark, misspelt, monkeypatch, tile):
    monkeypatch.setattr(spelling_groups, "TILE_WORDS", tile)
    found = collected(spelling_groups.spelling_variants(table(spark, misspelt)))
    assert found == variants(misspelt) and any(row[1] for row in found)


def test_variants_of_no_words(spark, no_docs):
    assert spelling_groups.spelling_variants(no_docs).collect() == []
    assert spelling_groups.spelling_variants(table(spark, [(1, None), (2, ""), (3, "12 34")])).collect() == []


def test_forms_lead_on_to_a_root(spark):
    text = " ".join(["abcdef"] * 40 + ["abcdeg"] * 20 + ["abcdhg"] * 10 + ["abcihg"] * 5 + ["abjihg"] * 5)
    found = {r["word"]: r for r in spelling_groups.spelling_variants(table(spark, [(0, text)])).collect()}
    words = vocabulary([(0, text)])
    assert {w: found[w]["root"] for w in words} == {row[0]: row[2] for row in variants([(0, text)])}


def test_counts_of_equal_size_take_the_smaller_word(spark):
    words = spark.createDataFrame([("aaaab", 4), ("aaaac", 9), ("aaaaé", 9), ("aaaaa", 9)], "word string, n long")
    best = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling_groups.neighbours(words).collect()}
    assert best["aaaab"] == (3, "aaaaa", 9) and best["aaaaa"] == (3, "aaaac", 9)


# --- prefix trie ------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, block int, key string, own string, position string, length int, h int"


def conversations(spark, rows):
    return spark.createDataFrame([(*row, 1, "k", "o", "p", 2, 3) for row in rows], CONVERSATIONS).repartition(3)


def turn_id(role, text):
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return f"{digest[:32]}-{len(text.encode())}"


def trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append(((turn is not None, turn or 0), turn_id(role, text), (role, text)))
    turns = {c: [t for _, _, t in sorted(found)] for c, found in own.items()}
    nodes, lengths = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt = turns.get(lender, [])[:h] + turns[c][h:]
        lengths[c] = len(rebuilt)
        for d in range(len(rebuilt) + 1):
            nodes[tuple(rebuilt[:d])].append(c)
    children = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if lengths[c] == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward_turns():
    rng, rows = random.Random(3), []
    for c in [*range(-7, 40), 1_000, 1_001, 100_000]:
        for t in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 40])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", None, ""])))
    for c in range(200, 230):
        rows += [(c, t, "u", "same" + "x" * (t == 18 and c % 7 == 0)) for t in range(20)]
    return rows + rows[:5] + [(None, 1, "u", "x"), (301, None, None, None), (302, 1, "u", "long " * 100_000)]


def test_trie_against_brute_force(spark):
    rows = awkward_turns()
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)


def test_trie_of_short_and_of_no_conversations(spark):
    rows = [(c, t, "u", "t" * (t + 1)) for c in range(12) for t in range(1 + c % 3)]
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)
    assert prefix_trie.prefix_trie(conversations(spark, rows[:0])).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "u", "x")])).collect() == []


def test_one_conversation_with_most_turns(spark):
    rows = [(5, t, "u", f"turn {t}") for t in range(1_000)] + [(6, t, "u", f"turn {t}") for t in range(990)]
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)


def test_many_conversations_with_one_end(spark):
    rows = [(c, 0, "u", "x") for c in range(2_000)]
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)


def test_running_sums_of_a_group_over_many_partitions(spark):
    frame = spark.range(5_000).select((F.col("id") % 7 == 0).cast("int").alias("k"), "id", (F.col("id") % 3).alias("v")).repartition(5)
    found = {(r["k"], r["id"]): r["s"] for r in running_sums(frame, ["k"], [F.col("id").asc()], "v", "s").collect()}
    sums = Counter()
    for n in range(5_000):
        sums[n % 7 == 0] += n % 3
        assert found[(int(n % 7 == 0), n)] == sums[n % 7 == 0]
