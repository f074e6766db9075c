"""Catalogs made from the given tables, with the arithmetic of real ones: documents stand for files known by their bytes alone, embeddings for photos with hashes, each in six variants whose hashes drift apart by two bits a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import median_hash, rising_hash
from sievework.schema import CATALOG

VARIANTS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        """concat('/lib/', source, '/doc_', lpad(cast(doc_id as string), 7, '0'), element_at(array('', ' (1)', ' copy', '', '_edited', '.2', ''), cast(doc_id % 7 as int) + 1),
           element_at(array('.jpg', '.JPEG', '.png', '.heic', '.tiff'), cast(doc_id % 5 as int) + 1)) AS path""",
        "n_chars AS size_bytes",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id) AS last_write",
        "'Ok' AS status",
        "upper(sha2(text, 256)) AS sha256",
        "cast(null as bigint) AS p_hash",
        "cast(null as bigint) AS d_hash",
        "cast(null as int) AS width",
        "cast(null as int) AS height",
        "cast(null as string) AS camera_make",
        "cast(null as string) AS camera_model",
        "cast(null as timestamp_ntz) AS date_taken",
        "1 AS frame_count",
        "cast(null as string) AS error",
    ).select(*CATALOG.names)


def vec_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("size(embedding) = 64").select("vec_id", median_hash(F.col("embedding")).alias("p0"), rising_hash(F.col("embedding")).alias("d0"))


def vec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec_hashes(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("mask", F.expr("shiftleft(1L, 2 * k) - 1"))
    return rows.selectExpr(
        "vec_id",
        "k",
        """concat('/vec/', cast(vec_id % 10 as string), '/', CASE vec_id % 6
             WHEN 0 THEN concat('IMG_', vec_id, CASE WHEN k > 0 THEN concat(' (', k, ')') ELSE '' END)
             WHEN 1 THEN concat('Screenshot_', vec_id, '_', k)
             WHEN 2 THEN concat('V', vec_id, '_', lpad(cast(k as string), 3, '0'))
             WHEN 3 THEN concat('photo', vec_id, CASE WHEN k % 2 = 1 THEN ' copy' ELSE '-' END, k)
             WHEN 4 THEN concat('B', vec_id, '_BURST', k)
             ELSE concat('P', vec_id, '.', k) END,
           element_at(array('.jpg', '.jpeg', '.png', '.tif'), cast((vec_id + k) % 4 as int) + 1)) AS path""",
        "50000 + (vec_id * 7919 + k * 331) % 900000 AS size_bytes",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, vec_id * 60 + k) AS last_write",
        "CASE WHEN k = 5 AND vec_id % 8 = 0 THEN 'DecodeFailed' ELSE 'Ok' END AS status",
        "upper(sha2(concat('V', vec_id, '-', CASE WHEN k = 5 AND vec_id % 4 = 0 THEN 4 ELSE k END), 256)) AS sha256",
        "CASE WHEN k = 5 AND vec_id % 8 = 0 THEN NULL ELSE p0 ^ mask END AS p_hash",
        "CASE WHEN k = 5 AND vec_id % 8 = 0 THEN NULL ELSE d0 ^ mask END AS d_hash",
        "cast(CASE WHEN vec_id % 6 = 1 THEN 1920 ELSE 400 + (vec_id % 7) * 300 - (k % 2) * 20 END as int) AS width",
        "cast(CASE WHEN vec_id % 6 = 1 THEN 1080 ELSE 300 + (vec_id % 5) * 200 END as int) AS height",
        "CASE vec_id % 5 WHEN 0 THEN 'Canon' WHEN 2 THEN 'Apple' END AS camera_make",
        "CASE vec_id % 5 WHEN 0 THEN 'Canon EOS R5' WHEN 2 THEN 'iPhone 15' WHEN 3 THEN 'X100' END AS camera_model",
        "CASE WHEN vec_id % 3 = 1 OR (vec_id % 3 = 0 AND k = 3) THEN NULL ELSE timestamp_ntz'2023-06-01 12:00:00' + make_dt_interval(0, 0, 0, vec_id * 100 + CASE WHEN vec_id % 3 = 2 THEN k * (vec_id % 2) ELSE 0 END) END AS date_taken",
        "CASE WHEN vec_id % 11 = 0 AND k = 2 THEN 12 ELSE 1 END AS frame_count",
        "cast(null as string) AS error",
    )


SORTED = 100_000
"""Line items of a partition that is sorted as files."""


def item_files(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Line items as files; set_id: the order. together: sets are brought together as line items, before their longer fields are made, in partitions small enough to be sorted in memory as files."""
    items = table(spark, sf_dir, "lineitem")
    if together:
        # a number of its own: Spark would merge partitions by the size of line items, and the files of several spill
        items = items.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // SORTED)), "l_orderkey")
    return items.selectExpr(
        "l_orderkey AS set_id",
        "concat('/items/', l_orderkey, '/', l_linenumber, '-', l_partkey, '-', l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN ' copy' ELSE '' END, CASE WHEN l_linenumber % 2 = 0 THEN '.jpg' ELSE '.png' END) AS path",
        "cast(l_extendedprice as bigint) AS size_bytes",
        "l_shipdate AS last_write",
        "'Ok' AS status",
        "upper(sha2(concat(l_partkey % 50, '-', l_suppkey % 3), 256)) AS sha256",
        "cast(null as bigint) AS p_hash",
        "cast(null as bigint) AS d_hash",
        "cast(l_quantity * 40 as int) AS width",
        "cast(l_quantity * 30 as int) AS height",
        "CASE WHEN l_returnflag = 'R' THEN 'Canon' END AS camera_make",
        "CASE WHEN l_returnflag = 'R' THEN 'EOS' END AS camera_model",
        "cast(null as timestamp_ntz) AS date_taken",
        "1 AS frame_count",
        "cast(null as string) AS error",
    )


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as paths, with names of every kind."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """concat(regexp_replace(url, '^https?:/', ''), '/', element_at(array('IMG_1 (2)', 'photo copy', 'photocopy', 'a_copy_b', 'Screen Shot 3', 'x_thumb', 'IMG_1234.0', '2016-03-09 21.03.33', 'v1.2.3', 'MVIMG_BURST12', 'pic_001', 'pic_0012', 'exported-7', 'copyright', 'Scaled'),
           cast(page_id % 15 as int) + 1), element_at(array('.jpg', '.JPEG', '.tiff', '.heif', '.jpe', '.png', ''), cast(page_id % 7 as int) + 1)) AS path""",
        "page_id * page_id * 997 % 7000000000 AS size_bytes",
    )
