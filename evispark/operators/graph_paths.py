"""One- and two-hop path retrieval for any number of requests at once, and paths as ranked evidence.

requests(start) hold entity ids. A path is `nodes`, an array of (entity_id, entity_type, name), and `rels`, an array
of (relationship_id, relationship_type, confidence, source_chunk_id, supporting_chunk_ids); edges keep their stored
direction. Each request's paths are cut at `limit` in the shape's own order first and ranked afterwards, so the
limit and the output follow different orders.

Scale: edges carry their end nodes (with_ends() adds them where a table lacks them), so that types are filters and
names need no join. Requests meet edges in equi-joins on ids; the cut is a row_number filter, which Spark pushes below
the shuffle as a group limit. Where the order starts with the hub, a hub's members are cut to limit + 1 before they meet
the requests, and where it starts with the end, each middle paper's ends are cut to the limit: no request can use more of
them, and a hub with a third of all edges doesn't multiply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import path_evidence_id
from ..schemas import ONTOLOGY
from ..storage import written, written_parts

# Operation -> (shape, relationship, end type).
OPERATIONS = {
    "paper_methods": ("outgoing", "uses_method", "method"),
    "paper_datasets": ("outgoing", "evaluated_on", "dataset"),
    "paper_tasks": ("outgoing", "addresses", "task"),
    "paper_authors": ("outgoing", "authored_by", "author"),
    "paper_citations": ("outgoing", "cites", "paper"),
    "paper_cited_by": ("incoming", "cites", "paper"),
    "papers_for_method": ("incoming", "uses_method", "paper"),
    "papers_for_dataset": ("incoming", "evaluated_on", "paper"),
    "papers_for_task": ("incoming", "addresses", "paper"),
    "shared_datasets": ("shared", "evaluated_on", "dataset"),
    "shared_methods": ("shared", "uses_method", "method"),
    "datasets_from_citing_papers": ("citing", "evaluated_on", "dataset"),
    "methods_for_dataset": ("through_paper", "uses_method", "method"),
    "citation_neighborhood": ("citations", "cites", "paper"),
}


# The edge by which a shape's middle paper meets the start.
THROUGH = {"citing": "cites", "through_paper": "evaluated_on"}


#: Slices of starts or middle papers that are joined one after the other, so that the shuffles of one at a time take disk.
SLICES = 4
#: Times the limit that the paths of a start should come to where only its first ends are joined.
SPARE = 1.6
#: Requests up to which starts are picked by a broadcast after a count, and joined at once.
REQUESTS_FEW = 100_000


#: Members of a hub whose starts are ranked where the hub is, in one task.
HUB_MOST = 10_000


OWN = ("relationship_id", "relationship_type", "confidence", "source_chunk_id", "supporting_chunk_ids")
ENDS = ("source_entity_id", "target_entity_id", "source_node", "target_node")


@dataclass(frozen=True)
class Edges:
    """Edges in a stored form of few bytes: rows(kind), a type's rows, and view(stored, kind), the columns OWN and ENDS of one kind's stored ones; where it
    also gives target_degree, that many papers at least have an edge to the target, and target_share, the part of the range of ids that lies below the target's;
    source_order and target_order stand as the ids do. Ids that are at hand are given to it by name. named: the stored columns that ids and nodes are made of,
    the source's first.

    Rows are joined, sorted and cut as they are stored; long ids, names and chunk lists are made of the paths that stay.
    """

    rows: Callable[[str], DataFrame]
    view: Callable[..., dict[str, Column]]
    named: tuple[str, ...] = ()

    def of(self, prefix: str, kind: str, **known: Column) -> tuple[DataFrame, dict[str, Column]]:
        """One type's rows with prefixed columns, and their view."""
        rows = self.rows(kind)
        rows = rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns])
        return rows, self.view(lambda c: F.lit(kind) if c == "relationship_type" else F.col(f"{prefix}_{c}"), kind, **known)


def end_node(entity_id: Column | str = "entity_id") -> Column:
    """A row of nodes as an edge's end; papers show their title or source id."""
    title, source = F.col("properties")["title"], F.col("properties")["source_id"]
    name = F.when(F.col("entity_type") == "paper", F.coalesce(F.nullif(title, F.lit("")), F.nullif(source, F.lit("")), "canonical_name")).otherwise(F.col("canonical_name"))
    return F.struct(F.col("entity_id"), "entity_type", name.alias("name"), "canonical_name")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with source_node and target_node; edges whose ends are no nodes go."""
    for side in ("source", "target"):
        if f"{side}_node" not in edges.columns:
            edges = edges.join(nodes.select(F.col("entity_id").alias(f"{side}_entity_id"), end_node().alias(f"{side}_node")), f"{side}_entity_id")
    return edges


def _edges(edges: DataFrame | Edges, nodes: DataFrame | None, prefix: str, kind: str) -> tuple[DataFrame, dict[str, Column]]:
    if isinstance(edges, DataFrame):
        ended = with_ends(edges.where(F.col("relationship_type") == kind), nodes)
        mine = [c for c in (*OWN, *ENDS) if c != "relationship_type"]
        edges = Edges(lambda _: ended.select(*mine), lambda stored, _: {c: stored(c) for c in (*OWN, *ENDS)} | {f"{e}_order": stored(f"{e}_entity_id") for e in ("source", "target")})
    return edges.of(prefix, kind)


def _cut(df: DataFrame, by: list[str], order: list[Column], limit: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= limit)


def _few(requests: DataFrame) -> bool:
    return requests.limit(REQUESTS_FEW + 1).count() <= REQUESTS_FEW


def _asked(requests: DataFrame, edges: DataFrame | Edges) -> DataFrame:
    """Requests as they are joined with edges: where those are stored in few bytes, their files' size would have millions of them broadcast, so a count decides."""
    if isinstance(edges, DataFrame):
        return requests
    return F.broadcast(requests) if _few(requests) else requests.hint("merge")


def _is(node: Column, kind: str) -> Column:
    return node["entity_type"] == kind


@dataclass(frozen=True)
class Part:
    """Paths as joined and cut: found(start, place, stored columns), their nodes and edges in order, and the columns that a start's rows share, start first."""

    found: DataFrame
    ends: list[Column]
    rels: list[dict[str, Column]]
    by: list[str]

    def shown(self) -> DataFrame:
        return _shown(self.found, self.ends, self.rels)

    def evidence(self, operation: str) -> DataFrame:
        """Ranked where the paths were cut; nodes, chunk lists and texts are made of the sorted rows."""
        found = _with_evidence_id(operation, self.found, self.ends, self.rels)
        order = Window.partitionBy(*self.by).orderBy(F.desc(_path_confidence(F.array(*[r["confidence"] for r in self.rels]))), "evidence_id")
        return evidence(operation, _shown(found.withColumn("rank", F.row_number().over(order)), self.ends, self.rels, "evidence_id", "rank"))


def _shown(found: DataFrame, ends: list[Column], rels: list[dict[str, Column]], *more: str) -> DataFrame:
    """Paths with these nodes and edges, in order."""
    node = lambda end: F.struct(*[end[c].alias(c) for c in ("entity_id", "entity_type", "name")])
    return found.select("start", *more, "place", F.array(*[node(e) for e in ends]).alias("nodes"), F.array(*[F.struct(*[r[c].alias(c) for c in OWN]) for r in rels]).alias("rels"))


def direct(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, kind: str, end_type: str, incoming: bool, limit: int) -> Part:
    """One edge from (or, incoming, to) the start; by confidence descending, then end id. The edge's stored direction stays.

    Incoming edges may be those of a hub, so a target's are cut before they meet the requests.
    """
    start, end = ("target", "source") if incoming else ("source", "target")
    rows, r = _edges(edges, nodes, "r", kind)
    order = [F.desc(r["confidence"]), r[f"{end}_entity_id"]]
    mine = rows.where(_is(r[f"{end}_node"], end_type)).withColumn("mine", r[f"{start}_entity_id"])
    if incoming:
        mine = _cut(mine, ["mine"], order, limit, "nth").drop("nth")
    found = mine.join(_asked(requests, edges), F.col("start") == F.col("mine"))
    return Part(_cut(found, ["start"], order, limit), [r[f"{start}_node"], r[f"{end}_node"]], [r], ["start"])


def shared(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, kind: str, mid_type: str, limit: int) -> list[Part]:
    """start -> x <- other by one type, other not the start; by x, then other.

    A start whose first x fills the limit has all its paths where that x's members are: they are cut and ranked there.
    """
    rows, r = _edges(edges, nodes, "r", kind)
    members, s = _edges(edges, nodes, "s", kind)
    mine = rows.where(_is(r["target_node"], mid_type) & _is(r["source_node"], "paper")).join(requests, F.col("start") == r["source_entity_id"]).withColumn("x", r["target_entity_id"])
    members = _cut(members.where(_is(s["source_node"], "paper")).withColumn("hub", s["target_entity_id"]), ["hub"], [s["source_entity_id"]], limit + 1, "nth").drop("nth")

    def part(mine: DataFrame, by: list[str]) -> Part:
        found = mine.join(members, F.col("x") == F.col("hub")).where(s["source_entity_id"] != F.col("start"))
        return Part(_cut(found, by, [F.col("x"), s["source_entity_id"]], limit), [r["source_node"], r["target_node"], s["source_node"]], [r, s], by)

    if "target_degree" not in r:
        return [part(mine, ["start"])]
    mine = written(_first_hubs(mine, r["target_degree"], limit), "first-hubs")
    return [part(mine.where("alone").drop("alone"), ["start", "x"]), part(mine.where("not alone").drop("alone"), ["start"])]


def _first_hubs(mine: DataFrame, degree: Column, limit: int) -> DataFrame:
    """(start, x) without the x that follow, in order, on x of `limit` other members: the limit never gets to them. Unknown degrees count as none.

    alone: the start keeps one x, and its members are no more than one task takes.
    """
    hubs = mine.withColumn("others", F.least(F.coalesce(degree, F.lit(1)), F.lit(limit + 1)) - 1)
    upto, own = F.sum("others").over(Window.partitionBy("start").orderBy("x")), F.sum("others").over(Window.partitionBy("start", "x"))
    hubs = hubs.withColumn("own", own).withColumn("before", upto - F.col("own")).where(F.col("before") < limit)
    return hubs.withColumn("alone", (F.col("before") == 0) & (F.col("own") >= limit) & F.coalesce(degree <= HUB_MOST, F.lit(False))).drop("others", "own", "before")


def through(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, first_kind: str, second_kind: str, end_type: str, limit: int) -> list[Part]:
    """start <- paper -> end; by end id, then paper id.

    A start that one paper cites has all its paths where that paper's ends are: they are cut and ranked there.
    """
    rows, r = _edges(edges, nodes, "r", first_kind)
    ends, s = _edges(edges, nodes, "s", second_kind)
    first = rows.where(_is(r["source_node"], "paper")).withColumn("mine", r["target_entity_id"]).join(requests, F.col("start") == F.col("mine")).drop("mine")
    second = _cut(ends.where(_is(s["target_node"], end_type)).withColumn("middle", s["source_entity_id"]), ["middle"], [s["target_entity_id"]], limit, "nth").drop("nth")

    def part(first: DataFrame, by: list[str]) -> Part:
        found = first.withColumn("paper", r["source_entity_id"]).join(second, F.col("paper") == F.col("middle"))
        return Part(_cut(found, by, [s["target_entity_id"], r["source_entity_id"]], limit), [r["target_node"], r["source_node"], s["target_node"]], [r, s], by)

    if first_kind != "cites" or isinstance(edges, DataFrame):
        return [part(first, ["start"])]
    first = written(first.withColumn("papers", F.count("*").over(Window.partitionBy("start"))), "citing-papers")
    return [part(first.where("papers = 1").drop("papers"), ["start", "paper"]), part(first.where("papers > 1").drop("papers"), ["start"])]


def through_first(operation: str, requests: DataFrame, edges: Edges, first_kind: str, second_kind: str, end_type: str, limit: int) -> DataFrame:
    """through() as ranked evidence for starts of many papers: each start meets its first ends alone, and all of them where those don't fill the limit.

    Ends are as many to each part of their ids' range, about: a start of `degree` papers takes those below a share of it that should hold the limit
    SPARE times. What the share leaves out comes after all that it keeps, so a start that fills the limit is whole; the others are joined again, with all ends.
    """
    mean = edges.rows(second_kind).agg(F.count("*") / F.greatest(F.approx_count_distinct(edges.named[0]), F.lit(1))).first()[0] or 1.0
    whole, held = _first_ends(operation, requests, edges, (first_kind, second_kind, end_type), limit, mean), (F.col("held") >= limit) | (F.col("share") >= 1)
    rest = written(requests.join(whole.where(held).select("start").distinct(), "start", "left_anti"), "unfilled-starts")
    parts = [whole.where(held)] if rest.isEmpty() else [whole.where(held), _first_ends(operation, rest, edges, (first_kind, second_kind, end_type), limit, None)]
    ends, rels = _first_path(edges, first_kind, second_kind)
    return reduce(DataFrame.unionByName, [evidence(operation, _shown(_with_evidence_id(operation, part, ends, rels), ends, rels, "evidence_id", "rank")) for part in parts])


def _first_path(edges: Edges, first_kind: str, second_kind: str) -> tuple[list[Column], list[dict[str, Column]]]:
    """Nodes and edges of start <- paper -> end, where the start's id is at hand and the paper is stored once."""
    r = edges.of("r", first_kind, target_entity_id=F.col("start"))[1]
    s = edges.of("s", second_kind, source_entity_id=r["source_entity_id"])[1]
    return [r["target_node"], r["source_node"], s["target_node"]], [r, s]


def _with_evidence_id(operation: str, found: DataFrame, ends: list[Column], rels: list[dict[str, Column]]) -> DataFrame:
    ids, rel_ids = F.array(*[e["entity_id"] for e in ends]), F.array(*[r["relationship_id"] for r in rels])
    return found.withColumn("evidence_id", path_evidence_id(_evidence_type(F.lit(len(rels))), F.lit(operation), ids, rel_ids))


def _slice(of: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(slices)).cast("int")


def _first_ends(operation: str, requests: DataFrame, edges: Edges, kinds: tuple[str, str, str], limit: int, mean: float | None) -> DataFrame:
    """Cut and ranked paths (start, place, rank, stored columns) of each start's first ends, `mean` ends to a paper, or of all; held: a start's paths; share: of all ends.

    Papers' edges are joined by slices of papers and written as stored, paths are cut by slices of starts.
    """
    first_kind, second_kind, end_type = kinds
    rows, r = edges.of("r", first_kind)
    ends, s = edges.of("s", second_kind)
    share = F.lit(1.0) if mean is None else F.coalesce(F.least(F.lit(1.0), limit * SPARE / (r["target_degree"] * mean)), F.lit(1.0))
    paper = F.col(f"r_{edges.named[0]}"), F.col(f"s_{edges.named[0]}")
    asked = rows.where(_is(r["source_node"], "paper"))
    few = _few(requests)
    slices = 1 if few else SLICES
    if few:
        asked = asked.join(F.broadcast(requests.select(F.col("start").alias("asked")).distinct()), r["target_entity_id"] == F.col("asked"), "left_semi")
    second = ends.where(_is(s["target_node"], end_type)).withColumn("lies", s["target_share"])

    def joined(k: int) -> DataFrame:
        mine = asked.where(_slice(paper[0], slices) == k).withColumn("share", share)
        mids = _cut(second.where(_slice(paper[1], slices) == k), [f"s_{edges.named[0]}"], [s["target_order"]], limit, "nth").drop("nth")
        return mine.join(mids, (paper[0] == paper[1]) & ((F.col("share") >= 1) | (F.col("lies") < F.col("share")))).drop("lies", paper[1]).withColumn("starts", _slice(r["target_entity_id"], slices))

    spark = requests.sparkSession
    met = written_parts(spark, "first-ends", "papers", {str(k): partial(joined, k) for k in range(slices)}).drop("papers")
    nodes, rels = _first_path(edges, first_kind, second_kind)

    def cut(k: int) -> DataFrame:
        mine = met.where(F.col("starts") == k).drop("starts").withColumn("mine", r["target_entity_id"])
        found = _cut(mine.join(requests, F.col("start") == F.col("mine")).drop("mine"), ["start"], [s["target_order"], r["source_order"]], limit)
        found = _with_evidence_id(operation, found.withColumn("held", F.count("*").over(Window.partitionBy("start"))), nodes, rels)
        order = Window.partitionBy("start").orderBy(F.desc(_path_confidence(F.array(r["confidence"], s["confidence"]))), "evidence_id")
        return found.withColumn("rank", F.row_number().over(order)).drop("evidence_id")

    return written_parts(spark, "cut-paths", "slice", {str(k): partial(cut, k) for k in range(slices)}).drop("slice")


def citations(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, depth: int, limit: int) -> Part:
    """Citation neighbourhood: at depth 1 outgoing, then incoming edges; at depth 2 two-edge chains alone, the same way.

    Each branch has its own order; the branches stand one after the other, and one cut takes both as they are stored.
    Stored edges' chains are written, one direction after the other, so that the joins of one at a time take disk.
    A chain's edges differ, which takes one of a hub's members at most.
    """
    if depth not in (1, 2):
        raise ValueError("the citation neighbourhood has depth 1 or 2")
    _, r = _edges(edges, nodes, "r", "cites")
    _, s = _edges(edges, nodes, "s", "cites")
    cites = {prefix: _edges(edges, nodes, prefix, "cites")[0] for prefix in ("r", "s")[:depth]}

    def chains(incoming: bool) -> DataFrame:
        start, other = ("target", "source") if incoming else ("source", "target")
        found = cites["r"].where(_is(r[f"{other}_node"], "paper")).join(requests, F.col("start") == r[f"{start}_entity_id"])
        if depth == 1:
            return found
        second = cites["s"].where(_is(s[f"{other}_node"], "paper")).withColumn("hub", s[f"{start}_order"])
        second = _cut(second, ["hub"], [s[f"{other}_order"]], limit + 1, "nth").drop("nth")
        return found.join(second, (r[f"{other}_order"] == F.col("hub")) & (r["relationship_id"] != s["relationship_id"])).drop("hub")

    if depth == 1 or isinstance(edges, DataFrame):
        both = reduce(DataFrame.unionByName, [chains(incoming).withColumn("branch", F.lit(int(incoming))) for incoming in (False, True)])
    else:
        names = [f"{prefix}_{c}" for prefix in ("r", "s") for c in edges.named]
        both = written_parts(requests.sparkSession, "citation-chains", "branch", {str(int(incoming)): partial(lambda i: chains(i).select("start", *names), incoming) for incoming in (False, True)})
        both = both.withColumn("branch", F.col("branch").cast("int"))
    rels = [r] if depth == 1 else [r, s]
    by = lambda a, b: F.when(F.col("branch") == 0, a).otherwise(b)
    node = lambda a, b: {c: by(a[c], b[c]) for c in ("entity_id", "entity_type", "name")}
    order = [by(e["target_order"], e["source_order"]) for e in rels]
    ends = [node(r["source_node"], r["target_node"]), *[node(e["target_node"], e["source_node"]) for e in rels]]
    return Part(_cut(both, ["start"], [F.col("branch"), *order], limit), ends, rels, ["start"])


def _parts(operation: str, requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, limit: int) -> list[Part]:
    shape, kind, end = OPERATIONS[operation]
    if shape in ("outgoing", "incoming"):
        return [direct(requests, nodes, edges, kind, end, shape == "incoming", limit)]
    if shape == "shared":
        return shared(requests, nodes, edges, kind, end, limit)
    return through(requests, nodes, edges, THROUGH[shape], kind, end, limit)


def paths(operation: str, requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, *, depth: int = 1, limit: int = 20) -> DataFrame:
    """(start, place, nodes, rels) of an allow-listed operation."""
    if OPERATIONS[operation][0] == "citations":
        return citations(requests, nodes, edges, depth, limit).shown()
    return reduce(DataFrame.unionByName, [part.shown() for part in _parts(operation, requests, nodes, edges, limit)])


def ranked(operation: str, requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, *, depth: int = 1, limit: int = 20) -> DataFrame:
    """evidence() of paths(), ranked where the paths are cut."""
    if OPERATIONS[operation][0] == "citations":
        return citations(requests, nodes, edges, depth, limit).evidence(operation)
    shape, kind, end = OPERATIONS[operation]
    if shape == "through_paper" and isinstance(edges, Edges):
        return through_first(operation, requests, edges, THROUGH[shape], kind, end, limit)
    return reduce(DataFrame.unionByName, [part.evidence(operation) for part in _parts(operation, requests, nodes, edges, limit)])


def _evidence_type(hops: Column) -> Column:
    return F.when(hops == 1, F.lit("graph_relationship")).otherwise(F.lit("graph_path"))


def _path_confidence(each: Column) -> Column:
    return F.coalesce(F.array_min(each), F.lit(1.0))


def evidence(operation: str, found: DataFrame) -> DataFrame:
    """Paths as evidence, ranked within each request by hops, confidence descending and evidence id, where they have no rank."""
    ids = F.transform("nodes", lambda n: n["entity_id"])
    rel_ids = F.transform("rels", lambda r: r["relationship_id"])
    kind = _evidence_type(F.size("rels"))
    own = "rank" in found.columns
    chunks = F.array_distinct(F.filter(F.flatten(F.transform("rels", lambda r: F.concat(F.array(r["source_chunk_id"]), F.coalesce(r["supporting_chunk_ids"], F.array().cast("array<string>"))))), lambda c: c.isNotNull() & (c != "")))
    confidence = _path_confidence(F.transform("rels", lambda r: r["confidence"]))
    first, second = F.col("nodes")[0], F.col("nodes")[1]
    sentence = F.concat(F.initcap(first["entity_type"]), F.lit(" '"), first["name"], F.lit("' "), F.replace(F.col("rels")[0]["relationship_type"], F.lit("_"), F.lit(" ")), F.lit(" "), second["entity_type"], F.lit(" '"), second["name"], F.lit("'."))
    arrows = F.concat(F.lit("Graph path: "), F.array_join(F.transform("nodes", lambda n: F.concat(n["entity_type"], F.lit(":"), n["name"])), " -> "), F.lit("."))
    out = found.select("start", *(["rank"] if own else []), F.lit(operation).alias("operation"), kind.alias("evidence_type"), (F.col("evidence_id") if own else path_evidence_id(kind, F.lit(operation), ids, rel_ids)).alias("evidence_id"), ids.alias("entity_ids"), rel_ids.alias("relationship_ids"), chunks.alias("source_chunk_ids"), confidence.alias("path_confidence"), F.when((F.size("nodes") == 2) & (F.size("rels") == 1), sentence).otherwise(arrows).alias("text"), F.filter("nodes", lambda n: n["entity_type"] == "paper")[0]["entity_id"].alias("paper_id"), "nodes", "rels")
    out = out.withColumn("chunk_id", F.when(F.size("source_chunk_ids") == 1, F.col("source_chunk_ids")[0]))
    if own:
        return out
    order = Window.partitionBy("start").orderBy(F.size("relationship_ids"), F.desc("path_confidence"), "evidence_id")
    return out.withColumn("rank", F.row_number().over(order))


def lookup_by_name(names: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """names(name, entity_type or null) -> nodes with that name in any case, by type and id, at most `limit` each."""
    met = names.select(F.col("name").alias("asked"), F.col("entity_type").alias("asked_type")).join(nodes, F.lower("canonical_name") == F.lower("asked")).where("asked_type is null or asked_type = entity_type")
    return _cut(met, ["asked", "asked_type"], [F.col("entity_type"), F.col("entity_id")], limit)


def resolution(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(name, entity_type) -> status found, ambiguous (with candidates) or not_found."""
    two = lookup_by_name(names, nodes, 2).groupBy("asked", "asked_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("entity_id")).alias("candidates"))
    met = names.join(two, (F.col("name") == F.col("asked")) & F.col("entity_type").eqNullSafe(F.col("asked_type")), "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return met.select("name", "entity_type", status.alias("status"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def _met(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges, mine: str, keep: bool = False) -> DataFrame:
    """Each start's edges by one end; stored edges of all kinds meet the starts in one join, and the start stands for the id of its end. keep: what met is written, names alone."""
    if isinstance(edges, DataFrame):
        return with_ends(edges, nodes).join(requests, F.col(f"{mine}_entity_id") == F.col("start"))
    ids = {kind: edges.of("r", kind) for kind, _, _ in ONTOLOGY}
    rows = reduce(DataFrame.unionByName, [rows.withColumn("mine", r[f"{mine}_entity_id"]).withColumn("kind", F.lit(kind)) for kind, (rows, r) in ids.items()])
    met = rows.join(requests, F.col("start") == F.col("mine"))
    if keep:
        met = written(met.select("start", "kind", *[f"r_{c}" for c in edges.named if c != f"{mine}_entity_id"]), f"met-{mine}")
    views = [(kind, edges.of("r", kind, **{f"{mine}_entity_id": F.col("start")})[1]) for kind in ids]
    made = lambda c: reduce(lambda out, v: out.when(F.col("kind") == v[0], v[1][c]), views[1:], F.when(F.col("kind") == views[0][0], views[0][1][c]))
    return met.select("start", *[made(c).alias(c) for c in (*OWN, *ENDS) if not keep or c not in ("confidence", "source_chunk_id", "supporting_chunk_ids")])


def neighbourhood(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges) -> DataFrame:
    """Outgoing edges of each start and their targets."""
    out = _met(requests, nodes, edges, "source")
    return out.withColumn("target_type", F.col("target_node.entity_type")).withColumn("target_name", F.col("target_node.canonical_name"))


def context(requests: DataFrame, nodes: DataFrame | None, edges: DataFrame | Edges) -> DataFrame:
    """Outgoing, then incoming edges of each start with the neighbour; a self-loop comes twice. The first direction is written, so that one's shuffles are there at once."""
    parts = []
    for direction, mine, other in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        met = _met(requests, nodes, edges, mine, keep=direction == "outgoing")
        parts.append(met.select("start", F.lit(direction).alias("direction"), "relationship_id", "relationship_type", *[F.col(f"{other}_node.{c}").alias(c) for c in ("entity_id", "entity_type", "canonical_name")]))
    return parts[0].unionByName(parts[1])
