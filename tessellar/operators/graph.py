"""Operators on node and edge tables: (id, kind) and (source, target, relation). Ids are strings."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors
from tessellar.sources.tables import cut, written

#: Relations that a change travels back along, how many edges such a walk looks at and how far it goes; tiers; grades from worst on.
DEPENDENCIES = ("calls", "declares", "extends", "imports")
EDGE_BUDGET = 5000
MAX_DISTANCE = 10
TIERS = ("agent_asserted", "inferred", "reference", "resolved")
GRADES = ("broken", "inferred", "verified")
#: Ids that a broadcast may hold: some 60 bytes each.
BROADCAST_NODES = 200_000
#: Edges that a broadcast may hold, some 100 bytes each: where it does, wedges, of which there are many more, aren't shuffled.
BROADCAST_EDGES = 1_500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, relation) from either end of every edge."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "relation").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "relation"))


def schema_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes of each kind and edges of each relation there are."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


def schema_card(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind, edges by relation and by family (column family); edges without a family count in none."""
    families = edges.where("family is not null").groupBy(F.lit("family").alias("what"), F.col("family").alias("name")).agg(F.count("*").alias("n"))
    return schema_counts(nodes, edges).unionByName(families)


def relation_card(nodes: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """For every node how often it stands in each relation, zero where it doesn't."""
    counted = both_ways(edges).groupBy("node").agg(*[F.count_if(F.col("relation") == r).alias(r) for r in relations])
    return nodes.join(counted, nodes["id"] == counted["node"], "left").select("id", *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in relations])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(counted, nodes["id"] == counted["node"], "left").select("id", "kind", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """(id, kind, degree) of the nodes with the most ends of edges, of equal ones the least ids."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(n)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by degree class: orphans, 1, 2 to 4, 5 to 9, 10 and more."""
    d = F.col("degree")
    name = F.when(d == 0, "0").when(d == 1, "1").when(d < 5, "2-4").when(d < 10, "5-9").otherwise("10+")
    return degrees(nodes, edges).groupBy("kind", name.alias("degree_class")).agg(F.count("*").alias("n"), F.sum("degree").alias("ends"))


def _near(df: DataFrame, n: int) -> DataFrame:
    """A frame of n node ids, broadcast where they are few."""
    return F.broadcast(df) if n <= BROADCAST_NODES else df


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, directed: bool = True) -> DataFrame:
    """(node, depth, via): nodes within so many hops of the seeds (column id), with the least predecessor on a shortest way; seeds have null.

    Breadth first: each hop joins the frontier with the steps, which are written once, and drops what was seen. Frontier
    and seen nodes are broadcast while they are few; then a hop shuffles only what it finds.
    """
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("other")) if directed else both_ways(edges).select("node", "other")
    steps = written(steps)  # repeated ones add nothing but their rows
    frontier = cut(seeds.select(F.col("id").alias("node")).distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")))
    seen, n = frontier, frontier.count()
    n_seen = n
    for depth in range(1, max_depth + 1):
        found = steps.join(_near(frontier.select("node"), n), "node").groupBy("other").agg(F.min("node").alias("via"))
        fresh = found.join(_near(seen.select(F.col("node").alias("other")), n_seen), "other", "left_anti")
        frontier = cut(fresh.select(F.col("other").alias("node"), F.lit(depth).alias("depth"), "via"))
        n = frontier.count()
        if not n:
            break
        seen, n_seen = seen.unionByName(frontier), n_seen + n
    return seen


def allowed(edges: DataFrame, relations: Sequence[str] | None = None, families: Sequence[str] | None = None) -> DataFrame:
    """The edges with one of the relations and one of the families; None allows all, an edge without a family belongs to none."""
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    return edges if families is None else edges.where(F.col("family").isin(*families))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The distinct edges that a walk of so many hops from the seeds crosses, either way: those that touch a node nearer than that."""
    edges = written(edges.select("source", "relation", "target").distinct())
    near = reach(edges, seeds, hops - 1, directed=False).select("node").distinct()
    n = near.count()
    from_them = edges.join(_near(near.withColumnRenamed("node", "source"), n), "source", "left_semi")
    to_them = edges.join(_near(near.withColumnRenamed("node", "target"), n), "target", "left_semi")
    return from_them.select("source", "relation", "target").unionByName(to_them.select("source", "relation", "target")).distinct()


def focus(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The distinct edges among nodes within so many hops of the seeds."""
    near = reach(edges, seeds, hops, directed=False).select("node").distinct()
    inside = edges.join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi")
    return inside.select("source", "relation", "target").distinct()


EDGE = "struct<source:string,target:string,relation:string>"


def _ordered(edges: DataFrame) -> DataFrame:
    """(node, other, e): distinct edges from either end; edges are ordered by source, target and relation."""
    e = edges.select(F.struct("source", "target", "relation").alias("e")).distinct()
    return e.select(F.col("e.source").alias("node"), F.col("e.target").alias("other"), "e").unionByName(e.select(F.col("e.target").alias("node"), F.col("e.source").alias("other"), "e"))


def two_sided(steps: DataFrame, start: str, target: str, max_depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Layers from the start (node) and from the target (node, e, next: the least edge back towards it) over steps (node, other, e), until they meet; none from the target if they don't.

    In each round the side with fewer nodes goes on. No node is in layers of both sides but in the last one of each.
    """
    spark = steps.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    ahead, back = [one(start)], [one(target)]
    counts, seen, n_seen = [1, 1], [ahead[0], back[0]], [1, 1]
    for _ in range(max_depth if start != target else 0):
        side = int(counts[1] < counts[0])
        layers = (ahead, back)[side]
        reached = steps.join(_near(layers[-1].select("node"), counts[side]), "node")
        fresh = reached.join(_near(seen[side].withColumnRenamed("node", "other"), n_seen[side]), "other", "left_anti")
        layer = fresh.select("other").distinct() if side == 0 else fresh.groupBy("other").agg(F.min(F.struct("e", F.col("node").alias("next"))).alias("p")).select("other", "p.*")
        layers.append(cut(layer.withColumnRenamed("other", "node")))
        counts[side] = layers[-1].count()
        if not counts[side]:
            break
        seen[side], n_seen[side] = seen[side].unionByName(layers[-1].select("node")), n_seen[side] + counts[side]
        if not ahead[-1].join(_near(back[-1].select("node"), counts[1]), "node", "left_semi").isEmpty():
            return ahead, back
    return ahead, []


def trace(edges: DataFrame, start: str, target: str, max_depth: int) -> DataFrame:
    """(hop, source, relation, target, explain): the edges of the shortest way either way, none if there is none within so many hops.

    Of equally long ways the one whose list of edges is least, edges being ordered by source, target and relation. Both ends
    walk towards each other; what the walk from the start reached and is on no shortest way is left out going back from where
    they met, and each node that stays points along its least edge, so that the way is read from pointers.
    """
    steps = written(_ordered(edges))
    ahead, back = two_sided(steps, start, target, max_depth)
    pointers, kept = [], back[-1].select("node") if back else None
    if back:
        kept = cut(ahead[-1].join(kept, "node", "left_semi"))
        for layer in reversed(ahead[:-1]):
            held = steps.join(_near(kept, kept.count()), "node").join(layer.withColumnRenamed("node", "other"), "other", "left_semi")
            pointers.append(cut(held.groupBy("other").agg(F.min(F.struct("e", F.col("node").alias("next"))).alias("p")).select(F.col("other").alias("node"), "p.*")))
            kept = pointers[-1].select("node")
        pointers = pointers[::-1] + back[:0:-1]
    at = edges.sparkSession.createDataFrame([(start, [])], f"node string, way array<{EDGE}>")
    for p in pointers:  # one row goes along
        at = p.join(F.broadcast(at), "node").select(F.col("next").alias("node"), F.concat("way", F.array("e")).alias("way"))
    hops = at.select(F.posexplode("way").alias("hop", "e"))
    return hops.select((F.col("hop") + 1).alias("hop"), "e.source", "e.relation", "e.target", F.concat("e.source", F.lit(" -"), "e.relation", F.lit("-> "), "e.target").alias("explain"))


def dependency_closure(edges: DataFrame, start: str, relations: Sequence[str] = DEPENDENCIES, budget: int | None = EDGE_BUDGET, max_distance: int = MAX_DISTANCE) -> tuple[DataFrame, str | None]:
    """(node, distance, via) of what depends on a node, and what stopped the walk: budget, distance or nothing.

    Edges with these relations are followed from target to source. ``via`` lists the edges from the consumer down to the
    node. The walk takes edges in breadth-first order and looks at no more of them than the budget; without one, at all.
    """
    used = allowed(edges, relations).select(F.struct("source", "target", "relation").alias("e")).distinct()
    back = written(used.select(F.col("e.target").alias("node"), F.col("e.source").alias("other"), "e"))
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [])], f"node string, way array<{EDGE}>")
    out = spark.createDataFrame([], f"node string, distance int, via array<{EDGE}>")
    seen, expanded, stopped, n_seen, held = frontier.select("node"), 0, None, 1, 1
    for distance in range(1, max_distance + 1):
        looked = cut(back.join(_near(frontier, held), "node").select("other", F.concat("way", F.array("e")).alias("way")))
        n = looked.count()
        if budget is not None and expanded + n > budget:
            looked, stopped = looked.orderBy("way").limit(budget - expanded), "budget"
        expanded += n
        fresh = looked.join(_near(seen.withColumnRenamed("node", "other"), n_seen), "other", "left_anti")
        frontier = cut(fresh.groupBy("other").agg(F.min("way").alias("way")).withColumnRenamed("other", "node"))
        out = out.unionByName(frontier.select("node", F.lit(distance).alias("distance"), F.reverse("way").alias("via")))
        n_fresh = frontier.count()
        if stopped or not n_fresh:
            break
        seen, n_seen, held = seen.unionByName(frontier.select("node")), n_seen + n_fresh, n_fresh * 3 * distance  # a way holds three names an edge
        if distance == max_distance:
            stopped = "distance"
    return out, stopped


def impact(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, role): direct dependents and dependencies of a node, and what else is within the depth."""
    near = neighbours(edges, edges.sparkSession.createDataFrame([(start,)], "id string"), depth)
    near = cut(near)
    up = near.where(F.col("target") == start).select(F.col("source").alias("node"), F.lit("dependent").alias("role"))
    down = near.where(F.col("source") == start).select(F.col("target").alias("node"), F.lit("dependency").alias("role"))
    direct = up.unionByName(down).distinct()
    every = near.select(F.explode(F.array("source", "target")).alias("node")).distinct().where(F.col("node") != start)
    return direct.unionByName(every.join(direct.select("node"), "node", "left_anti").select("node", F.lit("transitive").alias("role")))


def bound_reasons(stopped: str | None, omitted: DataFrame, truncated: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """(reason) for which an impact is a lower bound: what stopped the walk, edges left out (relation, omitted, reason), tables read in part. No rows: it is exact."""
    spark = omitted.sparkSession
    known = {"budget": f"the walk stopped after {EDGE_BUDGET} edges", "distance": f"the walk stopped at {MAX_DISTANCE} hops"}
    own = [(known[stopped],)] if stopped else []
    own += [(f"the {name} read stopped at its {limit}-row budget",) for name, limit in truncated]
    left = omitted.select(F.concat(F.col("omitted").cast("string"), F.lit(" "), "relation", F.lit(" edges were not carried: "), "reason").alias("reason"))
    return spark.createDataFrame(own, "reason string").unionByName(left)


def affected(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(what, id) of a reached set (node): documents and requirements in it, routes that it or what they handle is in, tables that it touches, tests of it. Nodes have kind and, for artifacts, class."""
    hit = nodes.join(reached.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    at = reached.select("node").distinct()
    docs = hit.where(F.col("class").isin("adr", "doc", "instruction", "spec", "todo")).select(F.lit("doc").alias("what"), "id")
    needs = hit.where("kind = 'requirement'").select(F.lit("requirement").alias("what"), "id")
    routes = hit.where("kind = 'route'").select("id").unionByName(edges.where("relation = 'handles'").join(at.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("id")))
    touched = edges.join(at.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("id")).join(nodes.where("kind = 'db_object'").select("id"), "id", "left_semi")
    tables = hit.where("kind = 'db_object'").select("id").unionByName(touched)
    tests = edges.where("relation = 'tests'").join(at.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    out = docs.unionByName(needs)
    for what, rows in (("route", routes), ("table", tables), ("test", tests)):
        out = out.unionByName(rows.select(F.lit(what).alias("what"), "id"))
    return out.distinct()


def tier_tally(edges: DataFrame) -> DataFrame:
    """One row: distinct edges by tier, unstated ones too."""
    tier = F.col("tier")
    one = edges.dropDuplicates(["source", "target", "relation"])
    return one.agg(*[F.count_if(tier == t).alias(t) for t in TIERS], F.count_if(tier.isNull() | ~tier.isin(*TIERS)).alias("unstated"))


def simple(edges: DataFrame) -> DataFrame:
    """(a, b): the undirected edges, each once, no loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def top_hubs(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The nodes of highest degree, equal ones by id."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(n)


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, restart: float = 0.25, rounds: int = 25) -> DataFrame:
    """(id, rank): personalised PageRank over undirected edges, the largest rank made 1.

    Edges count as often as they occur; loops and edges to unknown nodes don't. Nodes without edges give their rank to the
    seeds. Seeds listed twice weigh twice; without known seeds all nodes restart alike.
    """
    known = nodes.select("id").distinct()
    inner = edges.where("source <> target").join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    steps = both_ways(inner).groupBy("node", "other").agg(F.count("*").alias("times"))
    degree = steps.groupBy("node").agg(F.sum("times").alias("degree"))
    steps = written(steps.join(degree, "node").select("node", "other", (F.col("times") / F.col("degree")).alias("share")))
    seeded = seeds.join(known, "id", "left_semi").groupBy("id").agg(F.count("*").alias("w"))
    total = seeded.agg(F.sum("w")).first()[0]
    if not total:
        seeded, total = known.withColumn("w", F.lit(1)), known.count()
    base = known.join(seeded, "id", "left").join(degree.select(F.col("node").alias("id"), "degree"), "id", "left")
    base = cut(base.select("id", (F.coalesce("w", F.lit(0)) / F.lit(float(total or 1))).alias("start"), F.col("degree").isNull().alias("loose")))
    # a node without edges gets only what restarts and what such nodes lose, so their sum follows from the round before
    held = float(base.where("loose").agg(F.sum("start")).first()[0] or 0.0)
    now, lost = base.withColumn("rank", F.col("start")), held
    for k in range(rounds):
        got = steps.join(now.select(F.col("id").alias("node"), "rank"), "node").groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = restart * F.col("start") + (1 - restart) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("start"))
        now = base.join(got.withColumnRenamed("other", "id"), "id", "left").select("id", "start", "loose", rank.alias("rank"))
        lost = held * (restart + (1 - restart) * lost)
        if k % 5 == 4 or k + 1 == rounds:
            now = cut(now)
    top = now.agg(F.max("rank")).first()[0] or 1.0
    return now.select("id", (F.col("rank") / F.lit(top)).alias("rank"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): of the simple undirected graph, each triangle counted at its three nodes; each is found once, at its two least-degree corners."""
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    up = cut(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = up.alias("x").join(up.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = up.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    closed = F.broadcast(closed) if up.count() <= BROADCAST_EDGES else closed
    return wedges.join(closed, ["v", "w"]).select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def collapse(nodes: DataFrame, edges: DataFrame, group: Column) -> DataFrame:
    """Nodes with equal group values made one; (group, other, edges) counts edges between groups, unordered, inner ones too."""
    named = nodes.select("id", group.alias("g"))
    both = edges.join(named.select(F.col("id").alias("source"), F.col("g").alias("a")), "source").join(named.select(F.col("id").alias("target"), F.col("g").alias("b")), "target")
    return both.groupBy(F.least("a", "b").alias("group"), F.greatest("a", "b").alias("other")).agg(F.count("*").alias("edges"))


def supernodes(nodes: DataFrame, group: Column) -> DataFrame:
    """(group, members, findings, grade, kind) of nodes (id, kind, grade, findings): the sum of findings, the worst grade, the kind that most have (the least of equally frequent ones)."""
    rows = nodes.select(F.concat(F.lit("community:"), group.cast("string")).alias("group"), "kind", "findings", F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("grade")).alias("g"))
    by_kind = rows.groupBy("group", "kind").agg(F.count("*").alias("c"), F.sum("findings").alias("f"), F.min(F.when(F.col("g") > 0, F.col("g"))).alias("g"))
    out = by_kind.groupBy("group").agg(F.sum("c").alias("members"), F.sum("f").alias("findings"), F.min("g").alias("g"), F.min_by("kind", F.struct((-F.col("c")).alias("c"), "kind")).alias("kind"))
    return out.select("group", "members", "findings", F.element_at(F.array(*[F.lit(g) for g in GRADES]), F.coalesce("g", F.lit(len(GRADES))).cast("int")).alias("grade"), "kind")


def type_grades(nodes: DataFrame) -> DataFrame:
    """(kind, grade, n): nodes by kind and grade."""
    return nodes.groupBy("kind", "grade").agg(F.count("*").alias("n"))


def visible(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that a condition keeps, and the edges with both ends among them."""
    kept = nodes.where(keep)
    ends = kept.select("id")
    inside = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inside


def view(nodes: DataFrame, edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """(source, target, relation, tier, derived): edges with both ends known, each once, and a derived reference from every requirement's (id, source_id) document."""
    known = nodes.select("id").distinct()
    inside = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    derived = requirements.select(F.col("source_id").alias("source"), F.col("id").alias("target"), F.lit("references").alias("relation"), F.lit("resolved").alias("tier"), F.lit(True).alias("derived")).join(known.withColumnRenamed("id", "source"), "source", "left_semi")
    return inside.select("source", "target", "relation", "tier", F.lit(False).alias("derived")).dropDuplicates(["source", "target", "relation"]).unionByName(derived.select("source", "target", "relation", "tier", "derived"))


def hierarchy(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, group): the innermost package directory that holds a file, else its first two directories, else its own one; files at the root have ``.``."""
    up = ancestors(F.col("path"))
    rows = files.select("path").distinct()
    held = rows.select("path", F.explode(up).alias("dir")).join(packages.select(F.col("path").alias("dir")).distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("package"))
    two = F.coalesce(F.try_element_at(up, F.lit(2)), F.try_element_at(up, F.lit(1)), F.lit("."))
    return rows.join(held, "path", "left").select("path", F.coalesce("package", two).alias("group"))


def modules(edges: DataFrame, paths: DataFrame, rounds: int = 10, least: int = 2) -> DataFrame:
    """(key, member, name): communities of a repository's files by label propagation, with in-place updates in the order of paths.

    The updates of one round depend on each other in that order, so one repository (column repo) is one group; repositories
    are dealt to tasks. A file takes the label that most of its neighbours have, the least of equally frequent ones.
    """
    near = edges.select("repo", "source", "target").where("source <> target")
    rows = paths.select("repo", F.col("path").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(near)
    return rows.groupBy("repo").applyInPandas(lambda df: _propagated(df, rounds, least), "repo string, key string, member string, name string")


def _propagated(df: pd.DataFrame, rounds: int, least: int) -> pd.DataFrame:
    known = sorted(set(df.loc[df.target.isna(), "source"]))
    place = {p: i for i, p in enumerate(known)}
    around: list[list[int]] = [[] for _ in known]
    for a, b in zip(df.source, df.target, strict=True):
        if b is not None and a in place and b in place:
            around[place[a]].append(place[b])
            around[place[b]].append(place[a])
    label = list(range(len(known)))
    for _ in range(rounds):
        before = list(label)
        for i, others in enumerate(around):
            if others:
                counts = Counter(label[j] for j in others)
                label[i] = min(counts, key=lambda x: (-counts[x], x))
        if label == before:
            break
    out = []
    for own in sorted(set(label)):
        members = [known[i] for i, x in enumerate(label) if x == own]
        if len(members) >= least:
            shared = os.path.commonpath([os.path.dirname(m) for m in members]) if all("/" in m for m in members) else ""
            out += [(df.repo.iloc[0], f"module:{members[0]}", m, shared or members[0]) for m in members]
    return pd.DataFrame(out, columns=["repo", "key", "member", "name"])
