"""Plans are the ones that hold at scale: no nested loops, limits below shuffles, filters in scans, narrow reads."""

import re

import pytest
from pyspark.sql import functions as F

from evispark.operators import graph_paths, vectors
from evispark.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_nested_loops_or_products(spark, sf, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(registry.queries()[name](spark, sf)))


def test_path_limits_are_pushed_below_the_shuffle(spark, sf):
    for name in ("graph_papers_for_task", "graph_shared_methods"):
        assert "WindowGroupLimit" in plan_of(registry.queries()[name](spark, sf))


def test_only_the_edges_of_a_type_are_read(spark, sf):
    plan = plan_of(registry.queries()["graph_paper_tasks"](spark, sf))
    assert "lineitem.parquet" not in plan and re.search(r"PartitionFilters: \[[^\]]*relationship_type[^\]]*= addresses", plan)


@pytest.mark.parametrize("name, joins", [("graph_paper_datasets", 1), ("graph_shared_datasets", 2), ("graph_methods_for_dataset", 2), ("graph_citation_neighborhood_d2", 4)])
def test_paths_join_edges_alone(spark, sf, name, joins):
    """Types and names come with the edges: a join for each hop, and one for the requests."""
    plan = plan_of(registry.queries()[name](spark, sf)).split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan)) == joins


def test_hubs_are_cut_before_they_meet_the_starts(spark):
    """A paper that all cite, and that cites all: the second hop brings limit + 1 of its members at most."""
    nodes = [(f"p{i:04}", "paper", f"p{i:04}", [], {}) for i in range(300)]
    rows = [(f"a{i}", f"p{i:04}", "p0000", "cites", 1.0, None, []) for i in range(1, 300)] + [(f"b{i}", "p0000", f"p{i:04}", "cites", 1.0, None, []) for i in range(1, 300)]
    n = spark.createDataFrame(nodes, "entity_id string, entity_type string, canonical_name string, aliases array<string>, properties map<string,string>")
    e = spark.createDataFrame(rows, "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, source_chunk_id string, supporting_chunk_ids array<string>")
    starts = n.select(F.col("entity_id").alias("start"))
    found = graph_paths.paths("citation_neighborhood", starts, n, e, depth=2, limit=3)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.start, r.place)):
        got.setdefault(r.start, []).append([x.entity_id for x in r.nodes])
    assert got["p0005"] == [["p0005", "p0000", f"p{k:04}"] for k in (1, 2, 3)]
    assert "WindowGroupLimit" in plan_of(found)


def test_tables_are_written_once_for_a_state_of_their_inputs(spark, tmp_path):
    from evispark import storage

    made, path = [], str(tmp_path / "in.parquet")
    spark.range(3).write.parquet(path)
    read = lambda: storage.once(spark, "test-once", [path], lambda: made.append(1) or spark.read.parquet(path))
    assert read().count() == read().count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read().count() == 5 and len(made) == 2


def test_vector_filters_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", f"p{i % 3}", [float(i), 1.0], "x" * 50) for i in range(30)], "chunk_id string, paper_id string, vector array<double>, text string")
    rows.write.parquet(str(tmp_path / "v"))
    df = vectors.top_k(spark.read.parquet(str(tmp_path / "v")), [1.0, 0.0], 3, {"paper_id": "p1"}).select("chunk_id", "score")
    plan = plan_of(df)
    assert "EqualTo(paper_id,p1)" in plan and "TakeOrderedAndProject" in plan and "text" not in re.search(r"ReadSchema: (\S+)", plan)[1]


