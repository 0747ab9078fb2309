"""The queries with vectors of the documents' own words use every document."""

from conftest import SF

from voxsift import checks
from voxsift.checks.common import COUNTED, counted_embedding, counted_vector, table
from voxsift.functions.text import tokens


def test_every_document_has_a_vector(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("text", counted_vector(tokens(docs["text"])).alias("v")).collect()
    assert len(rows) == docs.count() and all(len(r["v"]) == 1 + len(COUNTED) and r["v"][0] == 1.0 for r in rows)
    assert counted_embedding("The that of the")[:4] == [1.0, 2.0, 1.0, 1.0]


def test_the_page_has_its_semantic_half(spark):
    queries = checks.queries()
    counts = {r["measure"]: r["rows"] for r in queries["a4_page_counts_whole"](spark, SF).collect()}
    assert 0 < counts["semantic"] <= counts["total"] and counts["text"] > 0
    assert queries["t4_search_page_near"](spark, SF).count() == min(20, counts["semantic"])
