"""Queries over the corpus tables: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import (
    ann,
    chosen_path,
    decontam,
    licenses,
    line_dedup,
    manifest,
    packing,
    phrases,
    pii,
    simhash,
    suffix,
    toxicity,
    wrapper,
)
from colloquy.llm.common import table

#: The query's key; users pass their own secret.
PSEUDONYM_KEY = "corpus-demo"

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract_text(table(spark, folder, "pages"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op4_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, folder, "documents"), texts=False)


def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("matches")


def op10_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), key=PSEUDONYM_KEY)


def op11_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, folder, "documents"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_collocations(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.build_manifest(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_wrapper,
        op2_toxicity,
        op3_best_fit_packing,
        op4_multi_index_hashing,
        op5_line_dedup,
        op6_suffix_array,
        op7_simhash_near_dedup,
        op8_decontamination,
        op9_license_scan,
        op10_pii_pseudonyms,
        op11_chosen_path_join,
        op12_phrase_collocations,
        op13_merkle_manifest,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT l.*, coalesce(doc_id <> keeper, false) AS dropped FROM lines l LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION_SQL = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS s
        FROM item WHERE len(w) > 0)
),
doc_window AS (
  SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s
        FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
),
found AS (SELECT DISTINCT doc_id, s, n, item_id FROM doc_window JOIN item_window USING (n, words)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

COLLOCATION_SQL = rf"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, w FROM (
    SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS s
      FROM documents)) WHERE len(w) > 0
),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY 1),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 5) t(k)) GROUP BY 1, 2, 3
),
candidate AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
scored AS (
  SELECT c.lang, c.phrase, c.a, min({{'s': CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT), 'cut': cut, 'l': x.f, 'r': y.f}}) AS b
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidate) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
  GROUP BY 1, 2, 3
),
inner_part AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidate))
  GROUP BY 1, 2
),
ranked AS (
  SELECT s.lang, s.phrase, s.a, b.l AS l, b.r AS r, b.s AS score,
         row_number() OVER (PARTITION BY s.lang ORDER BY b.s DESC, s.a DESC, encode(s.phrase)) AS rank
  FROM scored s LEFT JOIN inner_part i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(
                list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
                  string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END
              ), 4294967295) % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
),
node(level, lang, n, pos, h) AS (
  SELECT 0, lang, n, pos, leaf FROM placed
  UNION ALL
  SELECT level + 1, lang, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY level, lang, n, pos // 2
),
sub AS (
  SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS spot, count(*) OVER () AS k
  FROM node WHERE n = 1
),
top(level, k, spot, h) AS (
  SELECT 0, k, spot, subroot FROM sub
  UNION ALL
  SELECT level + 1, (k + 1) // 2, spot // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM top WHERE k > 1 GROUP BY level, k, spot // 2
),
above AS (
  SELECT lang, height, sub.spot, t.level, t.h AS beside FROM sub
  LEFT JOIN top t ON t.k > 1 AND t.spot = xor(sub.spot >> t.level, 1)
),
step AS (
  SELECT p.lang, p.pos, b.level, b.h AS beside, (p.pos >> b.level) & 1 AS slot
  FROM placed p JOIN node b ON b.lang IS NOT DISTINCT FROM p.lang AND b.n > 1 AND b.pos = xor(p.pos >> b.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, a.height + a.level, a.beside, (a.spot >> a.level) & 1
  FROM placed p JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang WHERE a.level IS NOT NULL
),
way AS (
  SELECT p.lang, p.pos, height + (SELECT max(level) FROM top) AS levels, subroot FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang
),
fold(lang, pos, level, h) AS (
  SELECT lang, pos, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.lang, f.pos, f.level + 1,
         sha256(CASE WHEN s.beside IS NULL THEN f.h WHEN s.slot = 0 THEN f.h || s.beside ELSE s.beside || f.h END)
  FROM fold f JOIN way w ON w.lang IS NOT DISTINCT FROM f.lang AND w.pos = f.pos AND f.level < w.levels
  LEFT JOIN step s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level
),
proof AS (SELECT lang, pos, string_agg(beside, '' ORDER BY level) AS besides FROM step GROUP BY 1, 2),
root AS (SELECT h AS root FROM top WHERE k = 1)
SELECT p.doc_id, p.leaf, w.subroot, root.root, sha256(coalesce(b.besides, '')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM placed p
JOIN way w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos
JOIN fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.level = w.levels
LEFT JOIN proof b ON b.lang IS NOT DISTINCT FROM p.lang AND b.pos = p.pos, root
"""

ORACLES: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op8_decontamination": DECONTAMINATION_SQL,
    "op12_phrase_collocations": COLLOCATION_SQL,
    "op13_merkle_manifest": MANIFEST_SQL,
}
