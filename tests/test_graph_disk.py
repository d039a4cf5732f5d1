"""The graph's edges are stored as keys and names; no query shuffles ids, nodes or chunk lists that it can make of them."""

import os
import re

import pytest
from pyspark.sql import functions as F

from evispark import storage
from evispark.plans import projections, registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(path):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names)


def test_stored_edges_take_about_the_disk_of_their_inputs(spark, sf):
    stored = projections.stored_edges(spark, sf)
    inputs = sum(os.path.getsize(p) for p in projections._inputs(sf))
    files = {n.split("file:")[-1] for n in stored.inputFiles()}
    assert sum(os.path.getsize(re.sub("^/+", "/", f)) for f in files) < 2 * inputs


LISTS = ["edge_provenance", "generation_members", "relationship_ids"]


@pytest.mark.parametrize("name", LISTS)
def test_edge_lists_are_scans(spark, sf, name):
    plan = plan_of(registry.queries()[name](spark, sf))
    assert "Exchange" not in plan and "Join" not in plan and "source_node" not in plan


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Two suppliers and two customers of one name, one name in other letters, an order told twice, lines of no order."""
    d = tmp_path_factory.mktemp("odd-graph")
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    tables = {t: read(t) for t in ("orders", "lineitem", "customer", "supplier", "part")}
    tables["supplier"] = tables["supplier"].withColumn("s_name", F.when(F.col("s_suppkey") == 1, "Supplier#000000000").when(F.col("s_suppkey") == 2, "SUPPLIER#000000003").otherwise(F.col("s_name")))
    tables["customer"] = tables["customer"].withColumn("c_name", F.when(F.col("c_custkey") < 2, "one").otherwise(F.col("c_name")))
    tables["orders"] = tables["orders"].union(tables["orders"].where("o_orderkey = 3"))
    tables["lineitem"] = tables["lineitem"].withColumn("l_orderkey", F.when(F.col("l_orderkey") == 5, -5).otherwise(F.col("l_orderkey")))
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", LISTS)
def test_repeated_names_and_orders_and_unknown_orders(spark, odd, name):
    import duckdb

    con = duckdb.connect()
    for t in projections.SOURCES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, odd).toPandas()[list(want.columns)]
    rows = lambda f: sorted(map(str, f.itertuples(index=False, name=None)))
    assert len(got) == len(want) and rows(got) == rows(want)


def test_edges_of_no_generation_meet_no_version(spark):
    """They stay whatever the current generation is, so they are not shuffled."""
    from evispark.operators import graph_build

    edges = spark.createDataFrame([("r1", "v", "g1"), ("r2", "v", "g2"), ("r3", "v", None), ("r4", "w", "g1")], "relationship_id string, paper_version_id string, graph_index_generation_fingerprint string")
    out = graph_build.swap_generation(edges, spark.createDataFrame([("v", "g2")], "paper_version_id string, generation string"))
    assert "isnotnull(graph_index_generation_fingerprint" in plan_of(out)
    assert sorted(r.relationship_id for r in out.collect()) == ["r2", "r3", "r4"]


def moved(spark, df):
    """The columns of all exchanges."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", text)]


PATHS = "graph_citation_neighborhood_d1 graph_citation_neighborhood_d2 graph_paper_authors graph_paper_citations graph_paper_cited_by graph_paper_datasets graph_paper_methods graph_paper_neighborhood graph_paper_tasks graph_papers_for_dataset graph_papers_for_method graph_papers_for_task graph_datasets_from_citing_papers graph_entity_context graph_methods_for_dataset path_signatures graph_evidence graph_shared_datasets".split()


@pytest.mark.parametrize("name", PATHS)
def test_paths_are_made_after_the_shuffle(spark, sf, name):
    """Neither nodes nor chunk lists nor ids of relationships are in the rows that are joined and cut."""
    of = moved(spark, registry.queries()[name](spark, sf))
    assert not any(columns & {"source_node", "target_node", "r_source_node", "r_src_node", "r_supporting_chunk_ids", "r_relationship_id", "s_relationship_id"} for columns in of)


def test_hubs_behind_full_ones_are_left_out(spark):
    """A start's second shared dataset is joined only where the first has too few other papers."""
    from evispark.operators import graph_paths

    rows = spark.createDataFrame([("s", "a", 3), ("s", "b", 9), ("t", "a", 4), ("t", "b", 2), ("u", "a", None), ("u", "b", 5), ("u", "c", 5), ("v", "a", 2), ("v", "a", 2), ("v", "b", 2)], "start string, x string, degree long")
    kept = graph_paths._first_hubs(rows, F.col("degree"), 3).collect()
    assert sorted((r.start, r.x) for r in kept) == [("s", "a"), ("s", "b"), ("t", "a"), ("u", "a"), ("u", "b"), ("v", "a"), ("v", "a"), ("v", "b")]


TYPES = {
    "graph_paper_authors": {"authored_by"},
    "graph_paper_citations": {"cites"},
    "graph_paper_cited_by": {"cites"},
    "graph_citation_neighborhood_d2": {"cites"},
    "graph_paper_tasks": {"addresses"},
    "graph_papers_for_task": {"addresses"},
    "graph_papers_for_method": {"uses_method"},
    "graph_paper_methods": {"uses_method"},
    "graph_papers_for_dataset": {"evaluated_on"},
    "edge_upsert": {"evaluated_on"},
}


@pytest.mark.parametrize("name", TYPES)
def test_queries_write_the_edges_of_their_types_alone(spark, sf, monkeypatch, name):
    asked = set()
    for kind, make in projections.PARTS.items():
        monkeypatch.setitem(projections.PARTS, kind, lambda *a, kind=kind, make=make: asked.add(kind) or make(*a))
    storage.discard()
    registry.queries()[name](spark, sf)
    assert asked == TYPES[name]


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_remapped_edges_are_made_after_the_shuffle(spark, request, which):
    import duckdb

    d = request.getfixturevalue(which)
    out = registry.queries()["edge_remap_dedup"](spark, d)
    assert not any(columns & {"source_entity_id", "target_entity_id", "source_chunk_id", "chunk", "supporting_chunk_ids"} for columns in moved(spark, out))
    con = duckdb.connect()
    for t in projections.SOURCES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'/*.parquet' if which == 'odd' else ''}')")
    want = con.sql(registry.oracle_sql()["edge_remap_dedup"]).df()
    got = out.toPandas()[list(want.columns)]
    rows = lambda f: sorted(map(str, f.itertuples(index=False, name=None)))
    assert len(got) == len(want) and rows(got) == rows(want)


def test_an_edge_moves_once_for_all_its_writes(spark, sf):
    of = moved(spark, registry.queries()["edge_upsert"](spark, sf))
    assert not any(columns & {"relationship_id", "relationship_type", "paper_version_id", "pos"} for columns in of)


def test_writes_need_both_endpoints_and_stored_edges_stay(spark):
    from evispark.operators import graph_build

    edge = lambda s, t, **more: dict(source_entity_id=s, relationship_type="cites", target_entity_id=t, relationship_id=f"{s}{t}", **more)
    old = spark.createDataFrame([edge("a", "b", g="old"), edge("a", "x", g="old"), edge("x", "b", g="old"), edge("b", "a", g=None)])
    new = spark.createDataFrame([edge("a", "b", g="one", pos=1), edge("a", "b", g="two", pos=2), edge("a", "x", g="one", pos=1), edge("x", "c", g="one", pos=1), edge("b", "c", g="one", pos=1)])
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "entity_id string")
    out = graph_build.upsert_edges(old, new, nodes).collect()
    assert sorted((r.relationship_id, r.g) for r in out) == [("ab", "two"), ("ax", "old"), ("ba", None), ("bc", "one"), ("xb", "old")]


@pytest.mark.parametrize("operation", ["shared_datasets", "datasets_from_citing_papers"])
def test_starts_of_one_hub_are_cut_and_ranked_where_it_is(spark, sf, operation):
    """Their paths, which have the columns of both edges, don't move again."""
    from evispark.operators import graph_paths

    alone, others = graph_paths._parts(operation, projections.requests(spark, sf, "paper"), None, projections.packed_edges(spark, sf), 20)
    paths = lambda part: [c for c in moved(spark, part.evidence(operation)) if {"start", "s_target"} <= c]
    assert not paths(alone) and paths(others) and not alone.found.isEmpty()


def test_ranks_are_sorted_without_nodes_and_chunk_lists(spark, sf):
    text = spark._jvm.PythonSQLUtils.explainString(registry.queries()["graph_evidence"](spark, sf)._jdf.queryExecution(), "formatted")
    sorts = re.findall(r"\) Sort\nInput \[\d+\]: \[([^\n]*)\]", text)
    assert sorts and not any(re.search(r"\b(nodes|rels|entity_ids|text)#", s) for s in sorts)


@pytest.mark.parametrize("name, end", [("graph_entity_context", "r_target"), ("graph_paper_neighborhood", "r_source_entity_id")])
def test_a_start_stands_for_the_id_of_its_end(spark, sf, name, end):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        of = [c for c in moved(spark, registry.queries()[name](spark, sf)) if "mine" in c]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert of and not any(end in c for c in of)


def test_papers_are_stored_as_numbers_and_counted_before_they_are_cited(spark, sf):
    """Edges of papers that come once carry no ids, and no count of their ends moves with them."""
    stored = projections.stored_kind(spark, sf, "cites")
    assert dict(stored.dtypes)["paper"] == "bigint" and not stored.where("target like 'paper:%'").head(1)
    assert not any(columns & {"papers", "ends", "target"} for columns in moved(spark, projections._citation_edges(spark, sf)))


@pytest.mark.parametrize("spare", [1.6, 0.05])
def test_a_dataset_meets_its_first_methods_alone(spark, sf, monkeypatch, spare):
    """What is joined is near the limit; starts that their first ends don't fill are joined again, in either case the result is that of the SQL."""
    import duckdb
    from evispark.operators import graph_paths

    made = {}
    monkeypatch.setattr(graph_paths, "SPARE", spare)
    monkeypatch.setattr(graph_paths, "REQUESTS_FEW", 50)
    monkeypatch.setattr(graph_paths, "written_parts", lambda spark, label, by, parts: made.setdefault((label, len(made)), storage.written_parts(spark, label, by, parts)))
    out = registry.queries()["path_signatures"](spark, sf).toPandas()
    first = next(df for (label, _), df in made.items() if label == "first-ends").count()
    con = duckdb.connect()
    for t in projections.SOURCES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    whole = con.sql("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) USING (l_orderkey)").fetchall()[0][0]
    want = con.sql(registry.oracle_sql()["path_signatures"]).df()
    rows = lambda f: sorted(map(str, f[list(want.columns)].itertuples(index=False, name=None)))
    assert first < whole / 2 and rows(out) == rows(want)


@pytest.mark.parametrize("name", ["graph_citation_neighborhood_d1", "graph_citation_neighborhood_d2"])
def test_both_directions_are_cut_as_stored(spark, sf, name):
    """No node or edge is in the rows of the cut of both, and no whole id of a paper but the start's."""
    of = moved(spark, registry.queries()[name](spark, sf))
    assert not any(columns & {"nodes", "rels", "within", "r_source_entity_id", "s_source_entity_id"} for columns in of)


def test_chains_of_one_direction_are_joined_at_a_time(spark, sf, monkeypatch):
    """Both are written as they are stored; the shuffle that cuts them is the last query's only one."""
    out = registry.queries()["graph_citation_neighborhood_d2"](spark, sf)
    of = moved(spark, out)
    assert len(of) == 1 and {"branch", "r_paper", "s_paper"} <= of[0]


@pytest.mark.parametrize("few, join", [(2, "SortMergeJoin"), (100_000, "BroadcastHashJoin")])
@pytest.mark.parametrize("name", ["graph_paper_tasks", "graph_papers_for_task"])
def test_a_count_of_the_requests_decides_how_they_meet_stored_edges(spark, sf, monkeypatch, name, few, join):
    """Edges, whose files are small for their number, are never broadcast, and starts only where they are few; the result is that of the SQL either way."""
    import duckdb
    from evispark.operators import graph_paths

    monkeypatch.setattr(graph_paths, "REQUESTS_FEW", few)
    out = registry.queries()[name](spark, sf)
    assert re.findall(r"(\w+Join) .*?Inner(, Build\w+)?", plan_of(out)) == [(join, ", BuildRight" if join == "BroadcastHashJoin" else "")]
    con = duckdb.connect()
    for t in projections.SOURCES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]).df(), out.toPandas()
    rows = lambda f: sorted(map(str, f[list(want.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
