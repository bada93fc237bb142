"""The registered queries of the operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegrid.llm import licences, token_files
from casegrid.llm.common import public_tokenizer, scratch_path, table
from casegrid.llm.decontaminate import contamination
from casegrid.llm.filter_audit import audit
from casegrid.llm.fingerprints import fingerprint_edits
from casegrid.llm.html_text import extract
from casegrid.llm.lexical_search import ranked
from casegrid.llm.mixing import mix
from casegrid.llm.near_dup import near_duplicates
from casegrid.llm.packing import pack
from casegrid.llm.secrets import scan
from casegrid.llm.sharding import placements
from casegrid.llm.toxicity import toxicity


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                               WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.s = b.s
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM comp c LEFT JOIN sizes s ON s.doc_id = c.doc_id
"""

OP10_SQL = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS phrase, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), spans AS (
  SELECT doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') AS phrase
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM docs, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)
), hits AS (
  SELECT DISTINCT doc_id, item_id, s, m FROM spans JOIN wins USING (phrase, m)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN cover c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM docs
), judged AS (
  SELECT doc_id, part,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS f
  FROM words
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit,
         list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), rows AS (
  SELECT part, o, s, bit,
         sum(n) FILTER (f & (coalesce(before, 0)::INT | bit) = 0) AS kept,
         sum(n) FILTER (f & coalesce(before, 0)::INT = 0 AND f & bit > 0) AS removed,
         sum(n) FILTER (f & coalesce(before, 0)::INT > 0 AND f & bit > 0) AS redundant,
         sum(n) FILTER (f = bit) AS alone,
         sum(g) FILTER (f & coalesce(before, 0)::INT = 0 AND f & bit > 0) AS good,
         sum(t) FILTER (f & coalesce(before, 0)::INT = 0 AND f & bit > 0) AS toxic
  FROM masks, steps GROUP BY part, o, s, bit, before
)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails,
       coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows
"""

OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (
  SELECT d, doc_id, w, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sized
), normed AS (
  SELECT d, doc_id, w, (25 + (75 * n * n_docs) // total)::BIGINT AS m FROM sized, whole
), postings AS (
  SELECT d, doc_id, m, t, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, m, unnest(w) AS t FROM normed) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY t, n_docs
), asked AS (
  SELECT item_id, t, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL
), scored AS (
  SELECT item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t) GROUP BY item_id, d, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source
), capped AS (     -- if this source and all with a lower cap per weight are at their caps, what the others share, and by what sum of weights
  SELECT source, source_size, weight,
         (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER lower, 0) AS left_over,
         (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER lower, 0) AS shares
  FROM sources WINDOW lower AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (      -- the first source, by cap per weight, that stays below its cap
  SELECT left_over::DOUBLE AS left_over, shares::DOUBLE AS shares FROM capped WHERE weight * left_over::DOUBLE / shares::DOUBLE <= 3 * source_size
  ORDER BY 3 * source_size / weight, source NULLS LAST LIMIT 1
), planned AS (
  SELECT source, source_size, least(weight * left_over / shares, (3 * source_size)::DOUBLE) AS target FROM sources, level
), budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget FROM planned
), ordered AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN budget // b.source_size ELSE 0 END AS epochs, budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM ordered
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licences": op1_licences, "op2_html_text": op2_html_text, "op3_packing": op3_packing, "op4_secrets": op4_secrets, "op5_toxicity": op5_toxicity, "op6_fingerprints": op6_fingerprints, "op7_near_dedup": op7_near_dedup, "op8_token_files": op8_token_files, "op9_sharding": op9_sharding, "op10_decontaminate": op10_decontaminate,
            "op11_filter_audit": op11_filter_audit, "op12_lexical_search": op12_lexical_search, "op13_mixing": op13_mixing}


def llm_oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_mixing": OP13_SQL}
