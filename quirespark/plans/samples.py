"""Elements derived from the star-schema tables, to run the layout operators over many pages.

They are stand-ins: suppliers are documents, line items elements, and all geometry is arithmetic over keys.
The text of each query is valid in Spark SQL and in other engines; {lineitem} and the like stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AT = "l_suppkey AS doc_id, 1 + l_partkey % 6 AS page_no, ((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq"
TEXTS = f"""SELECT {_AT}, 'text' AS kind, CAST(l_quantity AS DOUBLE) * 10 AS x0, CAST((l_orderkey * 7) % 70 AS DOUBLE) * 10 + 40 AS y0,
  CAST(l_quantity AS DOUBLE) * 10 + 15 + l_partkey % 40 AS x1, CAST((l_orderkey * 7) % 70 AS DOUBLE) * 10 + 43 AS y1, CAST(8 + l_linenumber % 4 AS DOUBLE) AS size,
  CASE WHEN l_orderkey % 37 = 0 THEN 90e0 ELSE 0e0 END AS rot, l_orderkey % 29 = 0 AS hidden, l_orderkey % 31 = 0 AS invisible,
  CASE WHEN l_orderkey % 23 = 0 THEN 300e0 END AS clip_x0, CASE WHEN l_orderkey % 23 = 0 THEN 0e0 END AS clip_y0, CASE WHEN l_orderkey % 23 = 0 THEN 400e0 END AS clip_x1, CASE WHEN l_orderkey % 23 = 0 THEN 500e0 END AS clip_y1,
  CASE l_returnflag WHEN 'A' THEN '#1F6F8B' WHEN 'R' THEN '#C6402E' ELSE '#000000' END AS color, l_linestatus = 'F' AS bold, l_discount > 9e-2 AS italic, 'F' || (l_linenumber % 3) AS font, l_returnflag || l_linestatus || l_linenumber AS text
  FROM {{lineitem}}"""
RECTS = f"""SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT {_AT}, CAST(l_quantity AS DOUBLE) * 10 AS x0, CAST((l_orderkey * 7) % 70 AS DOUBLE) * 10 AS y0,
  CAST(CASE l_linenumber % 4 WHEN 0 THEN 2 WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 5 + l_partkey % 60 END AS DOUBLE) AS w, CAST(CASE l_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 5 + l_orderkey % 50 END AS DOUBLE) AS h,
  CASE WHEN l_linenumber % 3 <> 0 THEN CASE l_returnflag WHEN 'A' THEN '#1F6F8B' WHEN 'R' THEN '#C6402E' ELSE '#336699' END END AS fill, CASE WHEN l_linenumber % 2 = 0 THEN '#000000' END AS stroke, CAST(1 + l_linenumber % 3 AS DOUBLE) AS line_width
  FROM {{lineitem}}) AS r"""
PAGES = "SELECT DISTINCT l_suppkey AS doc_id, 1 + l_partkey % 6 AS page_no, 612e0 AS w, 792e0 AS h FROM {lineitem}"
#: Every line item is a block, in two columns; the first and the last of a page are bands, the others share the height between by their number.
BLOCKS = """SELECT doc_id, page_no, n AS block_id, CASE WHEN n % 2 = 0 THEN 50e0 ELSE 330e0 END AS x0, CASE WHEN n % 2 = 0 THEN 260e0 ELSE 560e0 END + doc_id % 3 AS x1,
  CASE WHEN n = 0 THEN 30e0 WHEN n = n_page - 1 THEN 740e0 ELSE 100e0 + CAST(floor(575e0 * n / n_page) AS DOUBLE) END AS top,
  CASE WHEN n = 0 THEN 42e0 WHEN n = n_page - 1 THEN 752e0 ELSE 100e0 + CAST(floor(575e0 * n / n_page) + least(15, greatest(1, floor(862e0 / n_page))) AS DOUBLE) END AS bottom, 10e0 AS size, n AS seq,
  CASE WHEN n = 0 THEN 'Report of supplier  ' || doc_id || ' part ' || page_no WHEN n = n_page - 1 THEN '- ' || page_no || ' -' ELSE 'Body ' || seq0 END AS text
  FROM (SELECT l_suppkey AS doc_id, 1 + l_partkey % 6 AS page_no, ((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq0, ROW_NUMBER() OVER (PARTITION BY l_suppkey, 1 + l_partkey % 6 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS n, COUNT(*) OVER (PARTITION BY l_suppkey, 1 + l_partkey % 6) AS n_page FROM {lineitem}) AS b"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in query]
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def plain(query: str) -> str:
    return query.format(**{t: t for t in TABLES})


def rect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECTS as paths of one rectangle each."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))
    sub = F.struct(corners.alias("pts"), F.lit(False).alias("curves"), F.lit(True).alias("closed"), F.lit(True).alias("is_rect"), F.lit(0).alias("n_ctrl"))
    return load(spark, sf_dir, RECTS).drop("w", "h").withColumn("subpaths", F.array(sub))
