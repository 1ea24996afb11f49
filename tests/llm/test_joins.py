"""Nothing that grows with the corpus is broadcast: Spark takes an exploded table for as small as its file."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import common, simhash


def executed(spark):
    """The plans of all executions so far, each with its number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(k).executionId(): runs.apply(k).physicalPlanDescription() for k in range(runs.size())}


def near_copies(spark):
    r = random.Random(5)
    rows = []
    for _ in range(20):
        base = [f"w{r.randrange(300)}" for _ in range(60)]
        for edits in (0, 0, 1, 3):
            copy = base[:]
            for _ in range(edits):
                copy[r.randrange(60)] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_keyed_join_of_an_exploded_table_broadcasts_no_side(spark):
    rows = spark.range(1000).withColumn("slot", F.explode(F.array(*map(F.lit, range(64)))))
    few = rows.groupBy("id", "slot").agg(F.count("*").alias("n"))
    joined = common.keyed_join(rows, few, ["id", "slot"])
    assert joined.count() == 64_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [lambda docs: simhash.near_duplicates(docs), lambda docs: corpus_pipeline.near_duplicates(docs.sparkSession, docs, "")], ids=["op1", "pipeline"])
def test_near_copies_are_found_without_a_broadcast(spark, run):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20  # Spark's own, under which small tables are broadcast
    docs = near_copies(spark)
    before = executed(spark)
    assert run(docs).count() > 0
    plans = [p for k, p in executed(spark).items() if k not in before]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
