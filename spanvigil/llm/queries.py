"""The operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanvigil.llm import (
    decontaminate,
    jaccard_join,
    lattice_score,
    licence_scan,
    mixing,
    pii,
    prefix_trie,
    quality_model,
    radix_dedup,
    spelling_groups,
    substring_dedup,
    warc,
)
from spanvigil.llm import quality_rules as rules
from spanvigil.llm.text import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.quality_rules(read(spark, sf_dir, "documents"), trusted)


OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o.n >= 80 * (x.n + y.n - o.n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, s.n
"""


@query("op7_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op2_lattice_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_score.lattice_scores(read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (h) WHERE first_id < doc_id
), lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(coalesce(ps, []), j)], ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""


@query("op9_substring_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), digests AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::BIGINT, 1)
    FOR j IN range(32)], '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM digests)
"""


@query("op3_warc_round_trip", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op4_quality_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_licence_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(read(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """crc32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    hexed = f"hex(encode({text}))"
    nibbles = f"[instr('0123456789ABCDEF', {hexed}[i - 1 + 2 * (i % 2)]) - 1 FOR i IN range(1, len({hexed}) + 1)]"
    step = f"lambda c, x: xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {nibbles})::BIGINT[], {step}), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted),
vocabulary AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON v.word = c.cut
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON v.word = c.cut
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM pairs
), forms AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
         CASE WHEN r.other_n >= 2 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * v.n THEN r.other_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), chains(word, here) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.here AND e.form IS NULL
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_variants(read(spark, sf_dir, "documents"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op12_radix_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.dedup(read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
         sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS lender, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, p, id, bytes FROM convs c JOIN turns t ON t.conv_id = c.lender WHERE p <= h
  UNION ALL SELECT c.conv_id, 1, p, id, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE p > h
), lists AS (
  SELECT conv_id, coalesce(list(id ORDER BY part, p) FILTER (id IS NOT NULL), []) AS ids, list(bytes ORDER BY part, p) AS bytes
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, d, array_to_string(ids[1:d], ' ') AS k, CASE WHEN d > 0 THEN array_to_string(ids[1:d-1], ' ') END AS parent,
         CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS b, len(ids) = d AS ends
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM lists)
), nodes AS (
  SELECT d AS depth, k, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS weight,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ending
  FROM prefixes GROUP BY d, k
), children AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.k),
subtrees AS (
  SELECT p.k, sum(n.weight)::BIGINT AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.k
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ending) AS ends_sha256
FROM full_nodes n JOIN subtrees s USING (k) LEFT JOIN nodes u ON n.depth > 0 AND u.k = n.parent
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
