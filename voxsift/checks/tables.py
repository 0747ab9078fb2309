"""Scans, sinks, projections, filters, merges and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxsift.checks.common import REFUSED, REVIEWS, Query, domains, failing_model, lexicon, reviews, table
from voxsift.functions.documents import error_of
from voxsift.operators.filters import count_matching, facet_counts, matching, select_list
from voxsift.operators.keys import with_surrogate_key
from voxsift.operators.merge import insert_missing, update_matched
from voxsift.plans.batches import AnalysisTarget, batch_bounds, run_batches
from voxsift.plans.extraction import ModelExtraction
from voxsift.sources.tables import (
    SourceTable, load_reviews, pending, processed, read_table, scan, with_empty_result, write_table,
)
from voxsift.staging import fresh_path

BATCH = 300


def s1_parquet_scan(spark, sf) -> DataFrame:
    return scan(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


def s2_table_scan(spark, sf) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("voxsift_documents")
    return read_table(spark, "voxsift_documents").select("doc_id", "text")


def s3_load_with_key(spark, sf) -> DataFrame:
    loaded = load_reviews(spark, f"{sf}/orders.parquet", ["o_orderpriority", "o_orderkey"])
    return loaded.select("review_id", "o_orderkey", "o_orderpriority", "o_totalprice")


def w1_surrogate_key(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return with_surrogate_key(rows, "n", ["event_type", "user_id"], tie_break=["event_id"])


def _declared() -> SourceTable:
    return (
        SourceTable("main", "reviews", "reviews_analysed")
        .with_column("review_id", int, "the key", is_extractor_input=True)
        .with_column("review", str, "the text", is_extractor_input=True)
        .with_column("rating", float, "1 to 5", is_extractor_input=True)
        .with_column("lang", str, is_target_column=False)
        .with_column("brand", str)
    )


def s5_source_table(spark, sf) -> DataFrame:
    return _declared().conform(reviews(spark, sf)).select("review_id", "rating", "lang", "brand")


def s6_target_table(spark, sf) -> DataFrame:
    rows = _declared().target_rows(reviews(spark, sf))
    return rows.select("review_id", "rating", F.md5("review").alias("review_md5"), "analysis")


def p1_target_columns(spark, sf) -> DataFrame:
    return _declared().select_target_columns(reviews(spark, sf))


def p2_empty_result(spark, sf) -> DataFrame:
    return with_empty_result(reviews(spark, sf)).select("review_id", "analysis")


def s9_seed_target(spark, sf) -> DataFrame:
    target = AnalysisTarget(spark, fresh_path(spark, "target"))
    target.seed(reviews(spark, sf))
    target.seed(reviews(spark, sf))  # exists already: no change
    return target.read().select("review_id", "rating", "brand", "analysis")


def s10_overwrite_write(spark, sf) -> DataFrame:
    path = fresh_path(spark, "table")
    write_table(table(spark, sf, "documents"), path)
    write_table(table(spark, sf, "labels"), path)
    return read_table(spark, path)


def _run(spark, sf) -> AnalysisTarget:
    target = AnalysisTarget(spark, fresh_path(spark, "target"))
    target.seed(reviews(spark, sf))
    run_batches(target, lexicon(), batch_size=10_000, first_batch=BATCH)
    return target


def s12_run_log(spark, sf) -> DataFrame:
    return _run(spark, sf).history().select("operation", "batch", "rows_in", "rows_errored")


def _half_analysed(spark, sf) -> DataFrame:
    """Documents with a label analysed, the others pending."""
    rows = reviews(spark, sf)
    labelled = rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("review_id")), "review_id")
    return update_matched(with_empty_result(rows), lexicon().analyse(labelled), "review_id")


def p3_pending_rows(spark, sf) -> DataFrame:
    return pending(_half_analysed(spark, sf)).select("review_id", "brand")


def p4_processed_rows(spark, sf) -> DataFrame:
    return processed(_half_analysed(spark, sf)).select("review_id", "brand")


def _with_failures(spark, sf) -> DataFrame:
    return ModelExtraction(domains(), failing_model).analyse(reviews(spark, sf))


def p5_failed_rows(spark, sf) -> DataFrame:
    return _with_failures(spark, sf).where(error_of().isNotNull()).select("review_id", "rating")


def p6_conditions(spark, sf) -> DataFrame:
    return matching(table(spark, sf, "documents"), {"lang": "en", "source": "src3"}).select("doc_id", "n_chars")


def p7_select_list(spark, sf) -> DataFrame:
    rows = matching(reviews(spark, sf), {"lang": "de"})
    return select_list(rows, ["brand", "review_id", "brand"], also=["lang"])


def j1_insert_missing(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels")
    unknown = table(spark, sf, "documents").select(
        "doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")
    )
    return insert_missing(labels, unknown, "doc_id")


def j2_update_matched(spark, sf) -> DataFrame:
    start = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    # a NULL in the source replaces the old value like any other
    changes = table(spark, sf, "labels").withColumn("toxic", F.when(F.col("toxic") == 1, F.col("toxic")))
    return update_matched(start, changes, "doc_id")


def a1_filtered_count(spark, sf) -> DataFrame:
    return count_matching(table(spark, sf, "documents"), {"lang": "fr"})


def a2_facets(spark, sf) -> DataFrame:
    return facet_counts(reviews(spark, sf), "brand", "All Brands")


def a3_pending_count(spark, sf) -> DataFrame:
    return pending(_half_analysed(spark, sf)).agg(F.count(F.lit(1)).alias("pending"))


def t1_batches(spark, sf) -> DataFrame:
    keys = pending(_half_analysed(spark, sf))
    return batch_bounds(keys, "review_id", BATCH, first_batch=100)


def t5_sample(spark, sf) -> DataFrame:
    return reviews(spark, sf).orderBy("review_id").limit(10).select("review_id", "rating", "brand")


QUERIES: dict[str, Query] = {
    "s1_parquet_scan": s1_parquet_scan,
    "s2_table_scan": s2_table_scan,
    "s3_load_with_key": s3_load_with_key,
    "s5_source_table": s5_source_table,
    "s6_target_table": s6_target_table,
    "s9_seed_target": s9_seed_target,
    "s10_overwrite_write": s10_overwrite_write,
    "s12_run_log": s12_run_log,
    "p1_target_columns": p1_target_columns,
    "p2_empty_result": p2_empty_result,
    "p3_pending_rows": p3_pending_rows,
    "p4_processed_rows": p4_processed_rows,
    "p5_failed_rows": p5_failed_rows,
    "p6_conditions": p6_conditions,
    "p7_select_list": p7_select_list,
    "j1_insert_missing": j1_insert_missing,
    "j2_update_matched": j2_update_matched,
    "a1_filtered_count": a1_filtered_count,
    "a2_facets": a2_facets,
    "a3_pending_count": a3_pending_count,
    "w1_surrogate_key": w1_surrogate_key,
    "t1_batches": t1_batches,
    "t5_sample": t5_sample,
}

_PENDING = f"(SELECT * FROM ({REVIEWS}) WHERE review_id NOT IN (SELECT doc_id FROM labels))"

ORACLE: dict[str, str] = {
    "s1_parquet_scan": "SELECT doc_id, lang, source, n_chars FROM documents",
    "s2_table_scan": "SELECT doc_id, text FROM documents",
    "s3_load_with_key": """SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS review_id,
        o_orderkey, o_orderpriority, o_totalprice FROM orders""",
    "s5_source_table": f"""SELECT CAST(review_id AS INTEGER) AS review_id, CAST(rating AS DOUBLE) AS rating, lang, brand
        FROM ({REVIEWS})""",
    "s6_target_table": f"""SELECT CAST(review_id AS INTEGER) AS review_id, CAST(rating AS DOUBLE) AS rating,
        md5(review) AS review_md5, CAST(NULL AS VARCHAR) AS analysis FROM ({REVIEWS})""",
    "s9_seed_target": f"SELECT review_id, rating, brand, CAST(NULL AS VARCHAR) AS analysis FROM ({REVIEWS})",
    "s10_overwrite_write": "SELECT doc_id, quality, toxic FROM labels",
    "s12_run_log": f"""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS n FROM documents),
        b AS (SELECT CASE WHEN n <= {BATCH} THEN 1 ELSE (n - {BATCH} - 1) // 10000 + 2 END AS batch FROM n)
        SELECT 'analyse' AS operation, CAST(batch AS INTEGER) AS batch, count(*) AS rows_in,
          CAST(0 AS BIGINT) AS rows_errored FROM b GROUP BY batch
        UNION ALL SELECT o, 0, (SELECT count(*) FROM documents), 0 FROM (VALUES ('seed'), ('fold')) v(o)""",
    "p1_target_columns": f"SELECT review_id, review, rating, brand FROM ({REVIEWS})",
    "p2_empty_result": "SELECT doc_id AS review_id, CAST(NULL AS VARCHAR) AS analysis FROM documents",
    "p3_pending_rows": f"SELECT review_id, brand FROM {_PENDING}",
    "p4_processed_rows": f"SELECT review_id, brand FROM ({REVIEWS}) WHERE review_id IN (SELECT doc_id FROM labels)",
    "p5_failed_rows": f"SELECT review_id, rating FROM ({REVIEWS}) WHERE contains(review, ' {REFUSED} ')",
    "p6_conditions": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'",
    "p7_select_list": f"SELECT brand, review_id, lang FROM ({REVIEWS}) WHERE lang = 'de'",
    "j1_insert_missing": """SELECT doc_id, quality, toxic FROM labels UNION ALL
        SELECT doc_id, -1, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "j2_update_matched": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS quality,
        CASE WHEN l.doc_id IS NULL THEN -1 WHEN l.toxic = 1 THEN 1 END AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "a1_filtered_count": "SELECT count(*) AS total FROM documents WHERE lang = 'fr'",
    "a2_facets": """SELECT 'All Brands' AS brand, count(*) AS total FROM documents
        UNION ALL SELECT source, count(*) FROM documents GROUP BY source""",
    "a3_pending_count": f"SELECT count(*) AS pending FROM {_PENDING}",
    "w1_surrogate_key": """SELECT row_number() OVER (ORDER BY event_type, user_id, event_id) AS n,
        event_id, event_type, user_id FROM events""",
    "t5_sample": f"SELECT review_id, rating, brand FROM ({REVIEWS}) ORDER BY review_id LIMIT 10",
    "t1_batches": f"""WITH n AS (SELECT review_id, row_number() OVER (ORDER BY review_id) AS n FROM {_PENDING}),
        b AS (SELECT *, CASE WHEN n <= 100 THEN 1 ELSE (n - 100 - 1) // {BATCH} + 2 END AS batch FROM n)
        SELECT batch, min(review_id) AS first_key, max(review_id) AS last_key, count(*) AS rows
        FROM b GROUP BY batch""",
}
