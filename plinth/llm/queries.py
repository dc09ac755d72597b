"""Queries of the operators tagged llm, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from plinth.llm.address import same_address_pairs
from plinth.llm.canonical import canonical_localities
from plinth.llm.leak import leaked_passages, leaked_spans, removal_spans
from plinth.llm.match import matched_listings
from plinth.llm.packing import pack, token_counts
from plinth.llm.percentiles import market_percentiles
from plinth.llm.spam import stuffed_pages
from plinth.session import table

#: Where the public tokenizer's ranks file lies; a parameter of the packing query, never part of the repository.
TOKENIZER = os.environ.get("PLINTH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    a, b = (table(spark, sf_dir, f"listing_src{i}") for i in (1, 2))
    return a.select(*columns).unionByName(b.select(*columns))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_address_pairs(listings(spark, sf_dir, "listing_id", "city", "locality", "address_full"), table(spark, sf_dir, "gazetteer"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_percentiles(table(spark, sf_dir, "market_intelligence"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER))


def p4_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_listings(table(spark, sf_dir, "listing_src1"), table(spark, sf_dir, "listing_src2"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matched(spark, sf_dir).select("listing_id_a", "listing_id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_localities(listings(spark, sf_dir, "listing_id", "city", "locality"), table(spark, sf_dir, "gazetteer"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item").select("item_id", "passage"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item").select("item_id", "passage"))


def p9_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(p9_spans(spark, sf_dir))


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pages(spark, sf_dir).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p3_percentiles, p4_found, p4_matched, p5_found, p8_packed, p9_found, p9_spans, p9_removals, p10_found, p10_pages)}

#: The same buckets, counted and cut at the same ranks without windows over partitions.
_P3 = """
WITH v AS (
  SELECT segment, city, canonical_locality, m.metric AS metric, CAST(m.x AS DOUBLE) AS x
  FROM (SELECT segment, city, canonical_locality, unnest([{'metric': 'price_per_sqft', 'x': price_per_sqft}, {'metric': 'price', 'x': price}, {'metric': 'days_on_market', 'x': days_on_market}]) AS m FROM market_intelligence)
  WHERE m.x IS NOT NULL AND NOT isnan(CAST(m.x AS DOUBLE))),
e AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END AS e0 FROM v),
f AS (SELECT *, CASE WHEN x = 0 THEN 0 WHEN abs(x) / pow(2, e0) >= 2 THEN e0 + 1 WHEN abs(x) / pow(2, e0) < 1 THEN e0 - 1 ELSE e0 END AS e1 FROM e),
b AS (SELECT segment, city, canonical_locality, metric,
        CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * (1 + (floor((abs(x) / pow(2, e1) - 1) * 128) + 0.5) / 128) * pow(2, e1) END AS y FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY segment, city, canonical_locality, metric ORDER BY y) AS k,
        count(*) OVER (PARTITION BY segment, city, canonical_locality, metric) AS n FROM b)
SELECT segment, city, canonical_locality, metric, max(n) AS n,
  max(CASE WHEN k = ceil(0.25 * n) THEN y END) AS p25, max(CASE WHEN k = ceil(0.5 * n) THEN y END) AS p50,
  max(CASE WHEN k = ceil(0.75 * n) THEN y END) AS p75, max(CASE WHEN k = ceil(0.95 * n) THEN y END) AS p95,
  max(CASE WHEN k = ceil(0.99 * n) THEN y END) AS p99, 0.00390625::DOUBLE AS error_bound
FROM r GROUP BY 1, 2, 3, 4
"""

ORACLE: dict[str, str] = {"p3_percentiles": _P3}
