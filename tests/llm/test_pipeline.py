"""The pipeline's stages by the rows they keep, and models that reach workers without the package."""

import itertools
import os
import random
import re
import subprocess
import sys
import textwrap

import pytest

from voxsift.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "so", "ti", "vu", "za", "pe", "ga")]


def prose(seed, n=60):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(k, t, "xx", "s", len(t) if t is not None else None) for k, t in rows], SCHEMA)


def kept(spark, rows):
    import corpus_pipeline

    out = corpus_pipeline.keep_one_of_near_copies(spark, table(spark, rows), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_near_copies_go_by_row(spark):
    a, b, c, d = (prose(n) for n in range(4))
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, d), (9, d)]
    assert kept(spark, rows) == sorted([(3, b), (5, a), (7, c), (9, d)], key=repr)


def test_near_copies_against_all_pairs(spark):
    draw = random.Random(1)
    texts = [prose(n) for n in range(12)]
    for n in range(12):
        words = texts[n].split(" ")
        words[draw.randrange(60)] = "changed"
        texts.append(" ".join(words))
    rows = [(draw.choice([None, *range(15)]), draw.choice(texts)) for _ in range(60)] + [(1, None), (1, None), (2, ""), (None, "  ")]

    def grams(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    alike = sorted(set(rows), key=repr)
    label = list(range(len(alike)))
    for x, y in itertools.combinations(range(len(alike)), 2):
        p, q = grams(alike[x][1]), grams(alike[y][1])
        if p and q and 100 * len(p & q) >= 80 * len(p | q):
            label = [label[x] if v == label[y] else v for v in label]
    out = kept(spark, rows)
    assert len(out) == len(set(out)) == len(set(label))
    for own in set(label):
        group = [r for r, v in zip(alike, label) if v == own]
        least = min((k is None, k or 0) for k, _ in group)
        stays = [r for r in group if r in out]
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0] or 0) == least


def test_near_copies_of_an_empty_table(spark):
    assert kept(spark, []) == []


@pytest.mark.parametrize("rows", [10, 10**6, 10**11, 10**14])
def test_a_sample_is_about_as_large_as_asked(rows):
    share = common.bar_of(rows, 2000, 0) / (common.MILLION * common.PART)
    assert min(2000, rows) * 0.99 <= share * rows <= min(2000, rows) * 1.01


def test_a_sample_has_rows_of_every_value(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 2 as by").union(spark.range(3).selectExpr("cast(null as long)", "cast(7 as long)"))
    found = {r["by"]: r["count"] for r in common.bounded_sample(rows, "id", "by", 100).groupBy("by").count().collect()}
    assert 60 < found[0] < 150 and 60 < found[1] < 150 and found[7] == 3


def test_models_reach_workers_without_the_package(tmp_path):
    """Run from another folder and without PYTHONPATH: the worker processes cannot import the package."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        from voxsift.llm import decontamination, html_extraction, language_id, quality_classifier, quality_rules
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        table = lambda name: spark.read.parquet("/root/testdata/sf0.001/" + name + ".parquet")
        docs, labels = table("documents"), table("labels")
        def missing(part):
            import importlib.util
            yield importlib.util.find_spec("voxsift") is None
        assert all(spark.sparkContext.parallelize([1], 1).mapPartitions(missing).collect())
        assert language_id.identify(docs, language_id.train(docs)).where("score > 0").count() > 0
        assert quality_rules.judge(docs, quality_rules.train(docs, labels)).where("kept").count() > 0
        assert quality_classifier.judge(docs, quality_classifier.train(docs, labels)).where("kept").count() > 0
        assert decontamination.find_contamination(docs, table("benchmark")).where("contaminated").count() > 0
        pages = table("pages")
        assert html_extraction.extract(pages, html_extraction.train(pages)).where("text != ''").count() > 0
        print("all passed")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all passed" in done.stdout, done.stderr[-3000:]
