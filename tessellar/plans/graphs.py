"""Graph queries over the star tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.columns import rounded
from tessellar.operators import graph, reports, resolve
from tessellar.sources.tables import star_edges, star_nodes, table

SQL_NODES = """nodes as (select 'r:' || r_regionkey id, 'region' kind from region union all select 'n:' || n_nationkey, 'nation' from nation union all select 'c:' || c_custkey, 'customer' from customer
  union all select 's:' || s_suppkey, 'supplier' from supplier union all select 'p:' || p_partkey, 'part' from part)"""
SQL_EDGES = """edges as (select 'n:' || n_nationkey source, 'r:' || n_regionkey target, 'part_of' relation from nation union all select 'c:' || c_custkey, 'n:' || c_nationkey, 'part_of' from customer
  union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'part_of' from supplier union all select distinct 's:' || l_suppkey, 'p:' || l_partkey, 'produces' from lineitem),
ends as (select source node, target other, relation from edges union all select target, source, relation from edges)"""
RELATIONS = ["part_of", "produces"]


def graph_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.schema_counts(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


SQL_SCHEMA = f"with {SQL_NODES}, {SQL_EDGES} select 'node' what, kind name, count(*) n from nodes group by kind union all select 'edge', relation, count(*) from edges group by relation"


def relation_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_card(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), RELATIONS)


SQL_CARD = f"""with {SQL_NODES}, {SQL_EDGES} select id, count(*) filter (where relation = 'part_of') part_of, count(*) filter (where relation = 'produces') produces
from nodes left join ends on node = id group by id"""


def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_histogram(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


SQL_DEGREES = f"""with {SQL_NODES}, {SQL_EDGES}, d as (select id, kind, count(node) degree from nodes left join ends on node = id group by all)
select kind, case when degree = 0 then '0' when degree = 1 then '1' when degree < 5 then '2-4' when degree < 10 then '5-9' else '10+' end degree_class, count(*) n, sum(degree)::bigint ends from d group by all"""


def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, mean degree and share of orphans, one row of sums."""
    d = graph.degrees(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    n, ends = F.count("*"), F.sum("degree")
    return d.agg(n.alias("nodes"), F.floor(ends / 2).cast("long").alias("edges"), rounded(ends / n, 4).alias("mean_degree"), rounded(F.count_if(F.col("degree") == 0) / n, 4).alias("orphans"))


SQL_DENSITY = f"""with {SQL_NODES}, {SQL_EDGES}, d as (select id, count(node) degree from nodes left join ends on node = id group by all)
select count(*) nodes, (sum(degree) // 2)::bigint edges, round((sum(degree) / count(*))::decimal(28,12), 4)::decimal(18,4) mean_degree, round((count(*) filter (where degree = 0) / count(*))::decimal(28,12), 4)::decimal(18,4) orphans from d"""


def neighbors_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that two hops from nation 1 cross."""
    nodes = star_nodes(spark, sf_dir)
    return graph.neighbours(star_edges(spark, sf_dir), nodes.where("id = 'n:1'"), 2)


SQL_NEIGHBOURS = f"""with {SQL_EDGES}, h1 as (select 'n:1' node union select other from ends where node = 'n:1')
select distinct source, relation, target from edges where source in (select node from h1) or target in (select node from h1)"""


def neighbors_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at region 2, membership only."""
    return graph.neighbours(graph.allowed(star_edges(spark, sf_dir), ["part_of"]), star_nodes(spark, sf_dir).where("id = 'r:2'"), 1)


SQL_NEIGHBOURS_1 = f"with {SQL_EDGES} select distinct source, relation, target from edges where relation = 'part_of' and (source = 'r:2' or target = 'r:2')"


def focus_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the nodes within two hops of nation 1."""
    return graph.focus(star_edges(spark, sf_dir), star_nodes(spark, sf_dir).where("id = 'n:1'"), 2)


SQL_FOCUS = f"""with {SQL_EDGES}, h1 as (select 'n:1' node union select other from ends where node = 'n:1'), h2 as (select node from h1 union select other from ends join h1 using (node))
select distinct source, relation, target from edges where source in (select node from h2) and target in (select node from h2)"""


def trace_path_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the way from customer 0 to customer 1."""
    return graph.trace(star_edges(spark, sf_dir), "c:0", "c:1", 6)


SQL_EXPLAINED = f"""with recursive {SQL_EDGES}, steps as materialized (select distinct node, other, {{'s': e.source, 't': e.target, 'r': e.relation}} e from (select source node, target other, {{'source': source, 'target': target, 'relation': relation}} e from edges
  union all select target, source, {{'source': source, 'target': target, 'relation': relation}} from edges)),
dist as materialized (with recursive w as (select 'c:0' node, 0 d union select other, d + 1 from w join (select distinct node, other from steps) x using (node) where d < 6) select node, min(d) d from w group by node),
goal as (select d from dist where node = 'c:1'),
walk as (select 'c:0' node, 0 d, []::struct(s varchar, t varchar, r varchar)[] way union all
  select node, d, way from (select s.other node, w.d + 1 d, list_append(w.way, s.e) way, row_number() over (partition by s.other order by list_append(w.way, s.e)) k
    from walk w join steps s on s.node = w.node join dist x on x.node = s.other and x.d = w.d + 1 where w.d < (select d from goal)) where k = 1)
select unnest(range(1, len(way) + 1))::int hop, unnest(way).s source, unnest(way).r relation, unnest(way).t target, unnest(way).s || ' -' || unnest(way).r || '-> ' || unnest(way).t explain from walk where node = 'c:1'"""


def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops and least predecessors of all nodes reached from customer 7, either way, six hops at most."""
    nodes = star_nodes(spark, sf_dir)
    return graph.reach(star_edges(spark, sf_dir), nodes.where("id = 'c:7'"), 6, directed=False)


SQL_TRACE = f"""with recursive {SQL_EDGES}, steps as materialized (select distinct node, other from ends),
walk as (select 'c:7' node, 0 depth union select other, depth + 1 from walk join steps using (node) where depth < 6),
best as materialized (select node, min(depth) depth from walk group by node)
select b.node, b.depth::int as depth, (select min(s.node) from steps s join best p on p.node = s.node where s.other = b.node and p.depth = b.depth - 1) via from best b"""


def dependency_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What region 0 affects: edges followed backwards, ten hops at most."""
    back = star_edges(spark, sf_dir).where("relation = 'part_of'").select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    return graph.reach(back, star_nodes(spark, sf_dir).where("id = 'r:0'"), 10)


SQL_IMPACT = f"""with recursive {SQL_EDGES}, walk as (select 'r:0' node, 0 depth, null::varchar via union all select source, depth + 1, target from walk join edges on target = node and relation = 'part_of' where depth < 10)
select node, depth::int as depth, min(via) via from walk group by all having depth = min(depth)"""
SQL_IMPACT = SQL_IMPACT.replace(" group by all having depth = min(depth)", " group by node, depth")


def affected_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the customers, suppliers and parts that hang on it."""
    edges = star_edges(spark, sf_dir)
    held = edges.where("relation = 'part_of' and target like 'n:%'").select(F.col("target").alias("nation"), F.col("source").alias("id"))
    made = held.join(edges.where("relation = 'produces'").select(F.col("source").alias("id"), F.col("target").alias("part")), "id").select("nation", "part").distinct()
    parts = made.groupBy("nation").agg(F.count("*").alias("parts"))
    direct = held.groupBy("nation").agg(F.count_if(F.col("id").startswith("c:")).alias("customers"), F.count_if(F.col("id").startswith("s:")).alias("suppliers"))
    return direct.join(parts, "nation", "left").select("nation", "customers", "suppliers", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))


SQL_ROLLUP = """select 'n:' || n_nationkey nation, (select count(*) from customer where c_nationkey = n_nationkey) customers, (select count(*) from supplier where s_nationkey = n_nationkey) suppliers,
(select count(distinct l_partkey) from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey = n_nationkey) parts from nation
where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier)"""


def impact_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on region 1 through membership, with the way it does, within 500 edges."""
    found, stopped = graph.dependency_closure(star_edges(spark, sf_dir), "r:1", ["part_of"], budget=500)
    way = F.array_join(F.transform("via", lambda e: F.concat(e["source"], F.lit(">"), e["target"])), " ")
    return found.select("node", "distance", way.alias("via"), F.lit(stopped or "none").alias("stopped_by"))


SQL_BOUNDED = f"""with {SQL_EDGES}, e as (select distinct source, target from edges where relation = 'part_of'),
l1 as (select source node, 1 distance, source || '>r:1' via, [source] way from e where target = 'r:1'), n1 as (select count(*) n from l1),
l2 as (select e.source node, 2 distance, e.source || '>' || e.target || ' ' || l1.via via, row_number() over (order by l1.node, e.source) k from e join l1 on e.target = l1.node),
kept as (select l2.* from l2, n1 where k <= 500 - n1.n)
select node, distance, via, case when (select count(*) from l2) > 500 - (select n from n1) then 'budget' else 'none' end stopped_by from (select node, distance, via from l1 union all select node, distance, via from kept)"""


def impact_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and other neighbours of nation 3 within two hops."""
    return graph.impact(star_edges(spark, sf_dir), "n:3", 2)


SQL_ROLES = f"""with {SQL_EDGES}, d as (select source node, 'dependent' role from edges where target = 'n:3' union select target, 'dependency' from edges where source = 'n:3'),
near as (select source, target from edges where source = 'n:3' or target = 'n:3' or source in (select node from d) or target in (select node from d))
select node, role from d union select node, 'transitive' from (select source node from near union select target from near) where node <> 'n:3' and node not in (select node from d)"""


def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nodes of highest degree."""
    return graph.top_hubs(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


SQL_HUBS = f"with {SQL_NODES}, {SQL_EDGES} select id, kind, count(*) degree from nodes join ends on node = id group by all order by degree desc, id limit 5"


def supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities of their customers and suppliers: findings are cents of debt, grades go by balance."""
    party = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    party = party.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b")))
    grade = F.when(F.col("b") < -900, "broken").when(F.col("b") < 5000, "inferred").otherwise("verified")
    return graph.supernodes(party.select("id", "kind", "k", grade.alias("grade"), F.when(F.col("b") < 0, 1).otherwise(0).alias("findings")), F.col("k"))


SQL_SUPERNODES = """with p as (select 'customer' kind, c_nationkey k, c_acctbal b from customer union all select 'supplier', s_nationkey, s_acctbal from supplier), c as (select k, kind, count(*) c from p group by all)
select 'community:' || k "group", count(*) members, sum((b < 0)::int)::bigint findings, case when min(b) < -900 then 'broken' when min(b) < 5000 then 'inferred' else 'verified' end grade, (select kind from c where c.k = p.k order by c desc, kind limit 1) kind from p group by k"""


def module_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of source files by their imports, the top directory of each being its repository."""
    from tessellar.plans.repository import Repository

    repo = Repository(spark, sf_dir)
    links = resolve.import_links(repo.imports, repo.targets, repo.owners).where("kind = 'imports'").select(F.lit("star").alias("repo"), "source", "target").distinct()
    paths = links.select("repo", F.explode(F.array("source", "target")).alias("path")).distinct()
    return graph.modules(links, paths)


def pagerank_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all nodes around customers 1 and 2."""
    nodes = star_nodes(spark, sf_dir)
    ranks = graph.pagerank(nodes, star_edges(spark, sf_dir), nodes.where("id in ('c:1', 'c:2')"))
    return ranks.select("id", rounded(F.col("rank"), 6).alias("rank"))


SQL_PAGERANK = f"""with recursive {SQL_NODES}, {SQL_EDGES}, known as (select id from nodes),
ok as (select node, other from ends where node in (select id from known) and other in (select id from known) and node <> other),
steps as materialized (select node, other, count(*)::double / sum(count(*)) over (partition by node) share from ok group by node, other),
base as materialized (select id, case when id in ('c:1', 'c:2') then 0.5::double else 0 end start, id not in (select node from steps) loose from known),
walk as (select 0 k, id, start::double r from base
  union all
  select any_value(k) + 1, x.id, 0.25 * any_value(x.start) + 0.75 * sum(got) from (
    select w.k, s.other id, w.r * s.share got, b.start from walk w join steps s on s.node = w.id join base b on b.id = s.other where w.k < 25
    union all select k, seeds.id, lost * seeds.start, seeds.start from (select w.k, sum(w.r) lost from walk w join base bw on bw.id = w.id and bw.loose where w.k < 25 group by w.k) q, (select id, start from base where start > 0) seeds
    union all select w.k, w.id, 0, b.start from walk w join base b on b.id = w.id where w.k < 25) x group by x.id)
select id, round((r / max(r) over ())::decimal(28,12), 6)::decimal(18,6) rank from walk where k = 25"""


def triangle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the graph of parts that were ordered together."""
    pairs = reports.co_change_pairs(_touches(spark, sf_dir))
    edges = pairs.select(F.concat(F.lit("p:"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("p:"), F.col("b").cast("string")).alias("target"))
    return graph.triangles(edges)


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("item"), F.col("l_shipdate").alias("at"))


SQL_PAIRS = """t as (select l_orderkey c, l_partkey i, max(l_shipdate) t from lineitem group by all), fit as (select c from t group by c having count(*) between 2 and 50),
own as (select t.* from t join fit using (c)), pairs as (select x.i a, y.i b, count(*) times, max(x.t) last from own x join own y on x.c = y.c and x.i < y.i group by x.i, y.i)"""
SQL_TRIANGLES = f"""with {SQL_PAIRS}, e as materialized (select a, b from pairs), tri as (select x.a, x.b, y.b c from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b)
select 'p:' || n node, count(*) triangles from (select unnest([a, b, c]) n from tri) group by n"""


def collapse_supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between kinds of nodes."""
    return graph.collapse(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), F.col("kind"))


SQL_COLLAPSE = f"""with {SQL_NODES}, {SQL_EDGES} select least(a.kind, b.kind) "group", greatest(a.kind, b.kind) other, count(*) edges from edges join nodes a on a.id = source join nodes b on b.id = target group by 1, 2"""

QUERIES = {f.__name__: f for f in (graph_schema_counts, relation_card, degree_histogram, graph_density, neighbors_d1, neighbors_d2, focus_graph, trace_path, trace_path_explained, dependency_impact, impact_bounded, impact_roles, affected_rollup, top_hubs, supernodes, module_clusters, pagerank_seeded, triangle_counts, collapse_supernodes)}
ORACLES = {
    "graph_schema_counts": SQL_SCHEMA, "relation_card": SQL_CARD, "degree_histogram": SQL_DEGREES, "graph_density": SQL_DENSITY, "neighbors_d1": SQL_NEIGHBOURS_1, "neighbors_d2": SQL_NEIGHBOURS, "focus_graph": SQL_FOCUS, "trace_path_explained": SQL_EXPLAINED, "impact_bounded": SQL_BOUNDED, "impact_roles": SQL_ROLES, "top_hubs": SQL_HUBS, "supernodes": SQL_SUPERNODES, "trace_path": SQL_TRACE,
    "dependency_impact": SQL_IMPACT, "affected_rollup": SQL_ROLLUP, "pagerank_seeded": SQL_PAGERANK, "triangle_counts": SQL_TRIANGLES, "collapse_supernodes": SQL_COLLAPSE,
}
