"""One search over the reviews: counts, best text hits and nearest reviews, ready to be shown."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voxsift.functions.text import QUERY_NOISE, highlight
from voxsift.operators.filters import count_matching
from voxsift.operators.search import text_search
from voxsift.operators.vector_search import vector_search_text
from voxsift.sources.search_index import SearchIndex
from voxsift.staging import stage

# The choice that sets no condition, the shown hits, and the page's distance threshold.
ALL_BRANDS = "All Brands"
SHOWN = 10
SHOWN_AT_LEAST, SHOWN_AT_MOST = 5, 50
PAGE_THRESHOLD = 0.7


@dataclass(frozen=True)
class SearchPage:
    """``counts``: one row per measure. ``text`` and ``near``: shown hits in order, ``marked`` being the
    review with the query's words highlighted."""

    cleaned: str
    counts: DataFrame
    text: DataFrame
    near: DataFrame | None


def search_reviews(
    index: SearchIndex, sentence: str, embed: Callable[[str], Sequence[float]] | None = None,
    brand: str = ALL_BRANDS, shown: int = SHOWN, review: str = "review", brand_column: str = "brand",
    vector: str = "vector", threshold: float = PAGE_THRESHOLD,
) -> SearchPage:
    """Search for a typed sentence. Without ``embed`` only the text is searched."""
    shown = min(max(shown, SHOWN_AT_LEAST), SHOWN_AT_MOST)
    spark, key = index.spark, index.doc_key
    cleaned = spark.range(1).select(F.regexp_replace(F.lit(sentence), QUERY_NOISE, "").alias("q")).first()["q"]
    conditions = None if brand == ALL_BRANDS else {brand_column: brand}
    wanted = [brand_column, review, key]
    rows = [count_matching(index.documents, conditions).select(F.lit("total").alias("measure"), F.col("total").alias("rows"))]

    def counted(hits: DataFrame, measure: str) -> None:
        rows.append(hits.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(measure).alias("measure"), "rows"))

    def page(hits: DataFrame, *order) -> DataFrame:
        marked = highlight(F.col(review), cleaned, escape_html=True).alias("marked")
        return hits.orderBy(*order).limit(shown).select(key, brand_column, marked)

    # counted and shown: each search is done once, its hits (a bounded number) are kept
    text = stage(text_search(cleaned, index, conditions=conditions, select=wanted), "text-hits")
    counted(text, "text")
    near = None
    if embed is not None:
        near = stage(
            vector_search_text(index.documents, cleaned, embed, key=key, vector=vector, conditions=conditions,
                               select=wanted, threshold=threshold),
            "near-hits",
        )
        counted(near, "semantic")
    counts = rows[0]
    for more in rows[1:]:
        counts = counts.unionByName(more)
    return SearchPage(cleaned, counts, page(text, "rank"), near if near is None else page(near, "distance", key))
