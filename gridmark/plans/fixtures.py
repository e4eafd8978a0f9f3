"""Annotation tables derived from the test tables, as portable SQL: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FILES = """
SELECT CAST(n_nationkey AS BIGINT) AS file_id,
       concat('/data/training/', CASE n_regionkey WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'electrical' WHEN 2 THEN 'plumbing' WHEN 3 THEN 'electrical/mechanical' ELSE 'misc' END,
              '/', n_name, CASE WHEN n_nationkey % 7 = 3 THEN '_detected_hvac.json' ELSE '.json' END) AS path
FROM nation"""

IMAGES = """
SELECT CAST(c_nationkey AS BIGINT) AS file_id, c_custkey AS image_id, concat(c_name, '_page', CAST(1 + c_custkey % 6 AS STRING), '.png') AS file_name,
       CAST(3600 + 900 * (c_custkey % 5) AS INT) AS width, CAST(3300 + 600 * (c_custkey % 4) AS INT) AS height, CAST(c_custkey % 6 AS INT) AS page
FROM customer"""

CATEGORIES = """
SELECT CAST(n_nationkey AS BIGINT) AS file_id, CAST((p_partkey * 7 + n_nationkey * 3) % 25 AS INT) AS category_id, concat('Class ', CAST(p_partkey AS STRING)) AS name
FROM nation CROSS JOIN part
WHERE p_partkey < 25 AND (p_partkey + n_nationkey) % 11 <> 0"""

ANNOTATIONS = """
SELECT CAST(c_nationkey AS BIGINT) AS file_id, c_custkey AS image_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(((l_partkey % 25) * 7 + c_nationkey * 3) % 25 AS INT) AS category_id,
       CAST((l_partkey * 37 + l_linenumber * 911) % (3600 + 900 * (c_custkey % 5) - 200) AS INT) AS x,
       CAST((l_suppkey * 53 + l_partkey * 17) % (3300 + 600 * (c_custkey % 4) - 200) AS INT) AS y,
       CAST(10 + l_quantity * 3 AS INT) AS w, CAST(10 + (l_partkey % 40) * 3 AS INT) AS h
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

PDFS = """
SELECT file_id, folder, concat(folder, '/', CASE k WHEN 0 THEN 'set' WHEN 1 THEN concat('Customer#', lpad(CAST(file_id AS STRING), 9, '0')) WHEN 2 THEN 'Customer#0000' ELSE 'over' END, CASE k WHEN 3 THEN '_detected_hvac.pdf' ELSE '.pdf' END) AS pdf_path
FROM (SELECT CAST(n_nationkey AS BIGINT) AS file_id, concat('/data/training/', n_name) AS folder, n_nationkey % 4 AS many FROM nation) n
CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 4) r
WHERE k < many OR k = 3"""

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
TABLES = ("nation", "customer", "part", "lineitem", "orders", "region")


class Fixture:
    """The derived tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.files, self.images, self.categories, self.annotations, self.pdfs = (self._made(q) for q in (FILES, IMAGES, CATEGORIES, ANNOTATIONS, PDFS))

    def _made(self, query: str) -> DataFrame:
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", query)
        return self.spark.sql(text, **{t: self.table(t) for t in set(re.findall(r"{(\w+)}", text))})
