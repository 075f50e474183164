"""The registered queries and the pipeline run on the small tables."""

import os

import pytest

import __spark_entry__ as driver
import brute
import corpus_pipeline
from ward_analytics.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))
    assert {*queries.REGISTRY, "pipeline"} <= set(driver.queries())


def test_pipeline_stages(spark):
    docs = queries.load(spark, SF_DIR, "documents")
    folder = spark.conf.get("spark.checkpoint.dir") + "/stages"
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "packing" or docs.columns == columns
    letters = {d for d, x in seen["language"].items() if any(c.isalpha() for c in x or "")}
    assert set(seen["near_duplicates"]) <= letters and len(seen["near_duplicates"]) > 0.98 * len(letters)
    rows = sorted(seen["near_duplicates"].items())
    classes = brute.components([(d, brute.shingles(x)) for d, x in rows])
    assert set(seen["substrings"]) == {d for (d, _), c in zip(rows, classes, strict=True) if d == c}
    rows = sorted(seen["substrings"].items())
    units = [(d, brute.words(x)) for d, x in rows]
    want = {}
    for (d, w), gone, (_, text) in zip(units, brute.repeats(units, 13), rows, strict=True):
        if not any(gone):
            want[d] = text
        elif not all(gone):
            want[d] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    assert seen["decontamination"] == want
    items = [brute.words(r.text.lower()) for r in queries.load(spark, SF_DIR, "benchmark").collect()]
    held = {d for d, x in want.items() for item in items if f" {' '.join(item)} " in f" {' '.join(brute.words(x.lower()))} "}
    assert held and not held & set(seen["packing"]) and len(set(seen["packing"])) >= len(want) - 2 * len(held)
    assert {r.doc_id for r in docs.collect()} == set(seen["packing"])
