"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mix as mixing
from . import decontaminate, filter_audit, lexical, license_scan, line_dedup, patricia, quality_model, quality_rules, secret_scan, simhash, token_codes, token_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(read(spark, sf_dir, "documents")).drop("text")


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "source",
        "copies",
    )


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, secret_scan.KINDS),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query
def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_codes.write_tokens(read(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return token_codes.read_tokens(files)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return leaks.drop("key")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_runs(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        "n_words_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    )


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH filters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0) AS before
  FROM orders, range(1, 6) AS r(s)
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS whole,
         regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words
  FROM documents
), judged AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * list_unique(words) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(whole) - length(regexp_replace(whole, '[A-Z]', '', 'g'))) > 3 * length(whole) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(whole, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY whole) THEN 16 ELSE 0 END AS mask
  FROM texts
), labelled AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, CAST(mask AS INTEGER) AS mask, bit_count(CAST(mask AS INTEGER)) AS failed, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
  FROM judged LEFT JOIN labelled USING (doc_id) GROUP BY part, mask
)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit > 0 THEN n * 120 // failed ELSE 0 END) AS BIGINT) AS shapley
FROM counts, steps
GROUP BY part, filter_order, step
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.exact_groups(read(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept,
       sha256(low) AS text_sha256
FROM texts
WINDOW same AS (PARTITION BY low)
"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


ORACLES["op13_ranked_search"] = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT doc_id, r, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes
), wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (
    SELECT item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  )
  GROUP BY item_id, term
), occurrences AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM occurrences, totals GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, r,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // all_terms))))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN occurrences USING (term) JOIN sizes USING (r), totals
  GROUP BY item_id, doc_id, r
), ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
ORACLES["op10_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), 1, 13) AS BIGINT)
           / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sizes
), levels AS (
  SELECT *, 2.0 * source_size / w AS full_at,
         (1.5 * (SELECT sum(source_size) FROM sizes)
          - coalesce(sum(2 * source_size) OVER before, 0))
         / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 2.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT level AS flat FROM levels WHERE full_at >= level ORDER BY full_at LIMIT 1
), goals AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT flat FROM cut)) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, s.source, s.draw,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, source,
       CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
