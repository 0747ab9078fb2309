"""Connected components against a plain version, and what they and the near-duplicates leave to the driver."""

import random
import uuid

import corpus_pipeline
from voxsift.llm import components, near_duplicates


def plain(edges):
    label = {k: k for edge in edges for k in edge}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    return label


def some_edges():
    draw = random.Random(4)
    chain = list(range(300, 340))
    draw.shuffle(chain)
    made = [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + list(zip(chain, chain[1:]))
    return [(min(e), max(e)) for e in made if e[0] != e[1]] + [(-7, 2**62), (-7, 2**62)]


def labels_of(df):
    rows = [(r["id"], r["label"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    edges = some_edges()
    given = spark.createDataFrame(edges, "a long, b long")
    more = [(5, 310), (400, 401), (0, 1)]
    for most in (components.ONE_TASK_EDGES, 12, 0):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", most)
        labels = components.connected(given)
        assert labels_of(labels) == plain(edges)
        assert labels_of(components.extended(labels, spark.createDataFrame(more, "a long, b long"))) == plain(edges + more)
        assert labels_of(components.connected(given.where("a is null"))) == {}


def test_few_edges_take_few_jobs(spark):
    chain = list(range(2000))
    random.Random(5).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "components")
    try:
        labels = components.connected(edges)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 6
    assert set(labels_of(labels).values()) == {0}


def test_tables_that_grow_with_the_input_are_not_broadcast(spark, folder):
    """They are tiny here, and a session's own threshold would have them broadcast."""
    for name, schema in (("labels", "id long, label long"), ("pairs", "a long, b long, same int"), ("sets", "id long, set array<long>"), ("kinds", "id long, sig binary"), ("regions", "tree int, prefix binary, id long"), ("new", "id long, new long")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in ("labels", "pairs", "sets", "kinds", "regions", "new")}
    open_rows = near_duplicates.open_regions(read["regions"], read["labels"])
    joined = [
        components.relabelled(read["labels"], read["new"]), near_duplicates.likely(read["pairs"], read["kinds"]), near_duplicates.verified(read["pairs"], read["sets"], 80),
        open_rows, near_duplicates.to_leaders(open_rows, read["pairs"]), near_duplicates.in_blocks(open_rows, read["sets"].join(read["kinds"].hint("merge"), "id"), 80),
    ]
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_of_near_copies_are_not_broadcast(spark, monkeypatch):
    text = " ".join(f"w{n}" for n in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "other words " * 9), (None, text)], "doc_id long, text string")
    plans, staged = {}, corpus_pipeline.stage

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    monkeypatch.setattr(corpus_pipeline, "stage", kept)
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4]
    assert "SortMergeJoin" in plans["copies"] and "Broadcast" not in plans["copies"]
