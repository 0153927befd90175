"""Registered queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import cluster_report, image_clusters
from .fuzzy import fuzzy_groups, fuzzy_pairs
from .leakage import leak_report, leaked_items
from .neighbours import all_nearest, both_splits, nearest
from .overlap import cross_split_pairs, overlap_report
from .packing import pack, pack_report, sizes
from .quota import image_pool, quota_report, quota_sample
from .splitting import split_documents, split_report


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return image_clusters(_t(spark, d, "train_images"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    images = _t(spark, d, "train_images")
    return cluster_report(images, image_clusters(images))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(_t(spark, d, "train_images"), _t(spark, d, "test_images")).select("train_row_id", "test_row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    train, test = _t(spark, d, "train_images"), _t(spark, d, "test_images")
    return overlap_report(cross_split_pairs(train, test), train, test)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the drawn sample misses for want of rows."""
    return p3_report(spark, d).where("not met and short").select("plan_id", "label")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_report(image_pool(_t(spark, d, "train_images"), _t(spark, d, "train_labels")), _t(spark, d, "sample_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample(image_pool(_t(spark, d, "train_images"), _t(spark, d, "train_labels")), _t(spark, d, "sample_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    probes = _t(spark, d, "image_probes").select("probe_id", F.col("row_id").alias("query")).where("query is not null").distinct()
    found = nearest(both_splits(_t(spark, d, "train_images"), _t(spark, d, "test_images")), probes)
    return probes.join(found, "query").select("probe_id", F.col("neighbour").alias("neighbour_id"))


def p4_graph(spark: SparkSession, d: str) -> DataFrame:
    return all_nearest(both_splits(_t(spark, d, "train_images"), _t(spark, d, "test_images"))).select("row_id", "rank", "neighbour")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_pairs(_t(spark, d, "train_images"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_groups(_t(spark, d, "train_images"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pack(sizes(_t(spark, d, "documents"))).where("parts > 1").select("doc_id").distinct()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(sizes(_t(spark, d, "documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(p6_pack(spark, d)).select("items", "tokens", "overfull")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "eval_items")
    return leak_report(leaked_items(_t(spark, d, "documents"), items), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(_t(spark, d, "documents")).where("piece = 0").select("doc_id", "cut")


def p8_split(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(_t(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(p8_split(spark, d)).select("cut", "texts", "tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


IMAGES = """
    SELECT DISTINCT row_id FROM train_images
    WHERE len(features) = 784 AND len(list_filter(features, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
POOL = f"""
    WITH images AS ({IMAGES}),
    cur AS (SELECT row_id, label FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY labelled_at DESC NULLS LAST, label DESC NULLS LAST) AS r
        FROM train_labels WHERE row_id IS NOT NULL) WHERE r = 1),
    pool AS (SELECT row_id, CAST(label AS INT) AS label FROM cur JOIN images USING (row_id)
        WHERE label IS NOT NULL AND NOT isnan(label) AND label BETWEEN 0 AND 9 AND label = floor(label)),
    have AS (SELECT label, count(*) AS available FROM pool GROUP BY label),
    want AS (SELECT plan_id, t.label, coalesce(available, 0) AS available,
        greatest(min_rows, CAST(round(target_share * sample_size) AS BIGINT)) AS wanted
        FROM sample_targets t LEFT JOIN have ON have.label = t.label)"""

CUT = "CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \n]'), lambda w: strlen(w) > 2048)) > 0 THEN 'forced' ELSE 'natural' END AS cut"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": POOL + " SELECT plan_id, label FROM want WHERE available < wanted",
        "p3_report": POOL
        + """, cell AS (SELECT plan_id, t.label, max(target_share) AS share, max(sample_size) AS size, max(min_rows) AS least, any_value(coalesce(h.available, 0)) AS available
            FROM sample_targets t LEFT JOIN have h ON h.label = t.label GROUP BY plan_id, t.label),
        line AS (SELECT plan_id, label, share, size, rank, rank <= least AS held FROM (SELECT *, unnest(range(1, available + 1)) AS rank FROM cell)),
        free AS (SELECT plan_id, label, size, row_number() OVER (PARTITION BY plan_id ORDER BY (rank - 0.5::DOUBLE) / share, label) AS place FROM line WHERE NOT held AND share > 0),
        kept AS (SELECT plan_id, count(*) AS n FROM line WHERE held GROUP BY 1),
        drawn AS (SELECT plan_id, label, count(*) AS n FROM (SELECT plan_id, label FROM line WHERE held UNION ALL
            SELECT plan_id, label FROM free LEFT JOIN kept USING (plan_id) WHERE place + coalesce(n, 0) <= size) GROUP BY 1, 2)
        SELECT plan_id, label, available, wanted, coalesce(n, 0) AS drawn, coalesce(n, 0) >= wanted AS met, available < wanted AS short FROM want LEFT JOIN drawn USING (plan_id, label)""",
        "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
        "p6_report": "SELECT CAST(sum(ceil(strlen(text) / 4096.0)) AS BIGINT) AS items, CAST(sum(strlen(text)) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull FROM documents WHERE strlen(text) > 0",
        "p8_report": f"SELECT cut, count(*) AS texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT strlen(text) AS tokens, {CUT} FROM documents WHERE strlen(text) > 2048) GROUP BY cut",
        "p8_found": f"SELECT doc_id, {CUT} FROM documents WHERE strlen(text) > 2048",
    }
