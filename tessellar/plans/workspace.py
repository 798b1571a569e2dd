"""Views of the star repository and of events as a workspace, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import paths
from tessellar.operators import graph, pages, publish, workspace
from tessellar.plans.graphs import SQL_EDGES, SQL_NODES, SQL_PAIRS, _touches
from tessellar.plans.activity import SQL_WEIGHTS
from tessellar.plans.repository import SQL_CODE_LINKS, SQL_DOC_LINKS, SQL_FINDINGS, SQL_REPO, Repository, code_links, containment_edges, doc_links, findings, implements_links, routes, schema_links
from tessellar.operators import reports
from tessellar.repository import star
from tessellar.sources import reports as report_sources
from tessellar.sources.tables import shared_dir, star_edges, star_nodes, table


def repository_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph of the repository: code, documents, requirements, schema, routes and containment as edges with families, counted by relation."""
    repo = Repository(spark, sf_dir)
    edges = code_links(spark, sf_dir, repo).select("source", "target", F.col("kind").alias("relation"), F.lit("artifact").alias("from"))
    edges = edges.unionByName(doc_links(spark, sf_dir, repo).select("source", "target", F.lit("references").alias("relation"), F.lit("artifact").alias("from")))
    edges = edges.unionByName(implements_links(spark, sf_dir, repo).select(F.col("target").alias("source"), F.col("identity").alias("target"), F.lit("implements").alias("relation"), F.lit("artifact").alias("from")))
    schema = schema_links(spark, sf_dir, repo)
    edges = edges.unionByName(schema.select(F.coalesce("source", "path").alias("source"), "target", F.col("kind").alias("relation"), F.when(F.col("source").isNotNull(), "db_object").otherwise("artifact").alias("from")))
    edges = edges.unionByName(routes(spark, sf_dir, repo).select(F.col("url").alias("source"), F.col("path").alias("target"), F.lit("handles").alias("relation"), F.lit("route").alias("from")))
    edges = edges.unionByName(containment_edges(spark, sf_dir, repo).select("source", "target", F.lit("contains").alias("relation"), F.lit("directory").alias("from")))
    return edges.distinct().groupBy("relation", paths.edge_family(F.col("relation"), F.col("from")).alias("family")).agg(F.count("*").alias("n"))


SQL_GRAPH = SQL_REPO + """, i as (select count(*) n from (select distinct m.path, q from pairs join m on m.p = pairs.p join p on p.p = q)), dl as (""" + SQL_DOC_LINKS[len(SQL_REPO) :].replace(", l as (", "with l as (", 1) + """),
r as (select 'imports' relation, 'structure' family, (select n from i) + (select count(*) from t join p using (p)) + 2 * (select count(*) from k) n union all select 'calls', 'structure', (select n from i) + (select count(*) from t where exists (select 1 from orders, n where o_orderkey % n = t.p))
 union all select 'tests', 'evidence', count(*) from t join p using (p) union all select 'references', 'doc', count(*) from dl union all select 'implements', 'evidence', count(*) from o join p on o % 3 = 0 and p.p = x
 union all select 'defines', 'database', count(*) from k union all select 'references', 'database', count(*) from k union all select 'modifies', 'database', count(*) from k union all select 'queries', 'database', count(*) from m where p % 30 < 25 union all select 'handles', 'route', count(*) from k
 union all select 'contains', 'hierarchy', count(*) from (select distinct array_to_string(a[1:i], '/') s, array_to_string(a[1:i + 1], '/') t from (select string_split(path, '/') a from f), lateral (select unnest(range(1, len(a))) i)))
select relation, family, n::bigint n from r"""


def edge_page_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges past 'p' of the star's edges by id, within 300 rows and 20,000 bytes, and whether more follow."""
    edges = star_edges(spark, sf_dir).select(F.concat_ws(">", "source", "target").alias("id"), "source", "target", "relation")
    kept, more = workspace.edge_page(edges, 7, 7, "n:2", 300, 20_000)
    return kept.select("id", "row", F.col("bytes_so_far").cast("long").alias("bytes_so_far"), F.lit(more).alias("has_more"))


SQL_EDGE_PAGE = f"""with {SQL_EDGES}, e as (select source || '>' || target id, source s, target t, relation r from edges where source || '>' || target > 'n:2'),
w as (select id, row_number() over (order by id)::int as row, sum(octet_length(encode('{{"id":"' || id || '","source":"' || s || '","target":"' || t || '","relation":"' || r || '"}}'))) over (order by id) b from e)
select id, row as "row", b::bigint bytes_so_far, (select count(*) from e) > (select count(*) from w where row <= 300 and b <= 20000) has_more from w where row <= 300 and b <= 20000"""


def page_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 edges from position 500 on, and the 300 past an edge, from a table of all edges that is written in order."""
    path, order = f"{shared_dir(spark)}/tables/sorted-{uuid.uuid4().hex}", ["id", "relation"]
    edges = star_edges(spark, sf_dir).select(F.concat_ws(">", "source", "target").alias("id"), "source", "target", "relation")
    pages.write_sorted(edges, order, path)
    at, after = pages.page_at(spark, path, order, 500, 300), pages.page_after(spark, path, order, ("n:2", ""), 300)
    return at.withColumn("page", F.lit("position")).unionByName(after.withColumn("page", F.lit("key"))).select("page", "id", "relation", "position", "left_over")


SQL_POSITIONS = f"""with {SQL_EDGES}, e as (select source || '>' || target id, relation, row_number() over (order by source || '>' || target, relation) - 1 p, count(*) over () n from edges),
k as (select count(*) before from e where id <= 'n:2')
select 'position' page, id, relation, p::bigint "position", greatest(0, n - 800)::bigint left_over from e where p between 500 and 799
union all select 'key', id, relation, p::bigint, greatest(0, n - before - 300)::bigint from e, k where p between before and before + 299"""


def neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's neighbours."""
    return workspace.neighbour_ids(star_nodes(spark, sf_dir), star_edges(spark, sf_dir)).select("id", F.md5(F.array_join("neighbours", ",")).alias("digest"), F.size("neighbours").alias("n"))


SQL_NEIGHBOUR_IDS = f"with {SQL_NODES}, {SQL_EDGES} select id, md5(coalesce(string_agg(distinct other, ',' order by other), '')) digest, count(distinct other)::int n from nodes left join ends on node = id group by id"


def co_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were ordered together three times or more, as nodes."""
    pairs = reports.co_change_pairs(_touches(spark, sf_dir)).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "times")
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("path"))
    return workspace.co_changed_nodes(pairs, nodes)


SQL_CO_CHANGED = f"with {SQL_PAIRS} select 'p:' || a source, 'p:' || b target, times, least(1.0::double, times / 10) confidence from pairs where times >= 3 and a in (select p_partkey from part) and b in (select p_partkey from part)"


def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings of low quality by severity and title: labels as findings."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "toxic").otherwise("quality").alias("kind"), F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("odd").alias("severity"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return workspace.finding_filter(rows, kind="quality")


SQL_FINDING_FILTER = "select doc_id id, 'quality' kind, case when quality = 0 then 'medium' else 'odd' end severity, 'open' status, case when quality = 0 then 3 else 6 end severity_rank from labels where doc_id % 2 = 0 and coalesce(toxic, 0) <> 1"


def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as library items with a tag and a word in one of their fields."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit("body").alias("content"), F.lit("repo").alias("repository"), F.col("p_brand").alias("path"), F.lit("c0ffee").alias("commit"), F.array(F.lower("p_type"), F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("tags"))
    return workspace.library_filter(items, " Brand#1", "ECONOMY").select("id", "name", "path")


SQL_LIBRARY = "select p_partkey id, p_name as name, p_brand path from part where p_type = 'ECONOMY' and contains(lower(concat_ws(chr(10), p_name, p_type, 'body', 'repo', p_brand, 'c0ffee', p_type, 'size' || p_size)), 'brand#1')"


def module_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as modules of their customers: ready where the stored digest is that of the members, stale or pending else."""
    c = table(spark, sf_dir, "customer")
    clusters = c.select(F.lit("star").alias("repo"), F.concat(F.lit("module:"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_name").alias("member"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("name"))
    files = c.select(F.lit("star").alias("repo"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("blob"))
    digest = workspace.member_digest(F.col("c_name"), F.col("c_mktsegment"))
    stored = c.where("c_nationkey % 3 <> 0").groupBy("c_nationkey").agg(digest.alias("d")).select(F.lit("star").alias("repo"), F.concat(F.lit("module:"), F.col("c_nationkey").cast("string")).alias("key"), F.when(F.col("c_nationkey") % 3 == 1, F.col("d")).otherwise("old").alias("digest"), F.concat(F.lit("about "), F.col("c_nationkey").cast("string")).alias("summary"))
    return workspace.module_states(clusters, files, stored)


SQL_MODULES = """select 'star' repo, 'module:' || c_nationkey key, 'nation ' || c_nationkey as name, count(*) members, md5(string_agg(c_name || ':' || c_mktsegment, chr(10) order by c_name)) digest, case c_nationkey % 3 when 0 then 'pending' when 1 then 'ready' else 'stale' end state, case when c_nationkey % 3 = 1 then 'about ' || c_nationkey end summary from customer group by c_nationkey"""


def page_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of suppliers by nation: how many of their edges lead out, and to how many parts and places."""
    nodes = star_nodes(spark, sf_dir).select("id", F.col("id").alias("path"))
    members = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("page"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("path"))
    symbols = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("name"))
    whole, cited = workspace.page_skeletons(members, nodes, star_edges(spark, sf_dir), symbols)
    n = cited.groupBy("page").agg(F.count("*").alias("cited"))
    count = lambda r: F.coalesce(F.try_element_at("relations", F.lit(r)), F.lit(0)).cast("long")
    return whole.join(n, "page", "left").select("page", F.size("members").alias("members"), count("part_of").alias("part_of"), count("produces").alias("produces"), F.array_join("symbols", ",").alias("symbols"), "cited")


SQL_PAGES = """select 'nation' || s_nationkey page, count(distinct s_suppkey)::int members, count(distinct s_suppkey) part_of, count(distinct (s_suppkey, l_partkey)) filter (where l_partkey is not null) produces, string_agg(distinct s_name, ',' order by s_name) symbols, 1 + count(distinct l_partkey) filter (where l_partkey in (select p_partkey from part)) cited
from supplier left join lineitem on l_suppkey = s_suppkey group by s_nationkey"""


def change_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest consumers of nation 4 through membership taken as imports."""
    edges = star_edges(spark, sf_dir).where("relation = 'part_of'").withColumn("relation", F.lit("imports"))
    return workspace.change_brief(star_nodes(spark, sf_dir).select("id", F.concat(F.lit("path/"), "id").alias("path")), edges, "n:4")


SQL_BRIEF = f"""with {SQL_EDGES}, e as (select distinct source s from edges where relation = 'part_of' and target = 'n:4'), k as (select s, 'path/' || s path from e order by s limit 25)
select s consumer, path, 1 distance, greatest((select count(*) from e) - 25, 0) omitted, true complete, (select sum(greatest(1, ceil(length(path) / 4)))::bigint from k) cost from k"""


def touched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses of two workspaces: nodes of one, without a revoked token."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("workspace"), F.col("event_type").alias("token"), F.array(F.get_json_object("props", "$.k"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("nodes"), F.col("ts").alias("at"))
    return workspace.touched_nodes(rows, "w1", ["error"])


SQL_TOUCHED = """with n as (select event_id, unnest(list_distinct([json_extract_string(props, '$.k'), user_id::varchar])) node, ts from events where event_id % 2 = 1 and event_type <> 'error') select node, count(*) touches, max(ts) last_at from n group by 1"""


def hierarchy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group that each file of the repository folds into; db is a package."""
    packages = spark.createDataFrame([("db",)], "path string")
    return graph.hierarchy(star.files(spark, sf_dir), packages)


SQL_HIERARCHY = SQL_REPO + """, d as (select path, string_split(path, '/') a from f) select path, case when a[1] = 'db' and len(a) > 1 then 'db' when len(a) = 1 then '.' when len(a) = 2 then a[1] else a[1] || '/' || a[2] end "group" from d"""


def _published_parties(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A store at its second version, with the outcomes of both: customers without debts and suppliers as nodes after all customers; places renamed among the edges, of which those that the second plan hasn't stay."""
    path = f"{shared_dir(spark)}/tables/store-{uuid.uuid4().hex}"
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = c.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    later = c.where("c_acctbal >= 0").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.when(F.col("c_nationkey") == 5, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") != 6, F.col("c_nationkey")).cast("long").alias("nation"))
    later = later.unionByName(s.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation")))
    edges = star_edges(spark, sf_dir)
    moved = edges.where("target = 'n:7' or source like 'n:%'").withColumn("relation", F.when(F.col("target") == "n:7", "located_in").otherwise(F.col("relation")))
    keys = {"nodes": ["id"], "edges": ["source", "target"]}
    first = publish.publish(spark, path, {"nodes": nodes, "edges": edges}, keys, keep=["edges"], expected=0)
    second = publish.publish(spark, path, {"nodes": later, "edges": moved}, keys, keep=["edges"], expected=1)
    return path, first.unionByName(second)


def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the rows of two tables when two plans are published one after the other."""
    told = _published_parties(spark, sf_dir)[1]
    same = F.when(F.col("outcome").isin("unchanged", "untouched", "kept"), "same").otherwise(F.col("outcome"))
    return told.groupBy("version", "table", same.alias("outcome")).agg(F.sum("n").alias("n"))


_SQL_PARTIES = f"""{SQL_EDGES}, n1 as (select 'c:' || c_custkey id, c_name as name, c_nationkey::bigint nation from customer),
n2 as (select 'c:' || c_custkey id, case when c_nationkey = 5 then upper(c_name) else c_name end as name, case when c_nationkey <> 6 then c_nationkey end::bigint nation from customer where c_acctbal >= 0 union all select 's:' || s_suppkey, s_name, s_nationkey from supplier),
w as (select n1.id is null fresh, n2.id is null gone, n1.name is distinct from n2.name or n1.nation is distinct from n2.nation differs, n2.* from n1 full join n2 using (id))"""
SQL_PUBLISH = f"""with {_SQL_PARTIES}, o as (select 1 "version", 'nodes' "table", 'inserted' outcome from n1 union all select 1, 'edges', 'inserted' from edges
union all select 2, 'nodes', case when fresh then 'inserted' when gone then 'removed' when differs then 'updated' else 'same' end from w union all select 2, 'edges', case when target = 'n:7' then 'updated' else 'same' end from edges)
select "version"::bigint "version", "table", outcome, count(*) n from o group by all"""


def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that readers find after both plans, and the version that gave each its values."""
    path = _published_parties(spark, sf_dir)[0]
    return publish.read(spark, path, "nodes", "id string, name string, nation long").withColumn("nation", F.col("nation").cast("string"))


SQL_PUBLISHED = f"with {_SQL_PARTIES} select id, name, nation::varchar nation, case when fresh or differs then 2 else 1 end::bigint since from w where not gone"


def _repository_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = Repository(spark, sf_dir)
    id_ = lambda c: F.concat(F.lit("artifact:"), c)
    artifacts = repo.files.select(id_("path").alias("id"), "path", "classification")
    edges = code_links(spark, sf_dir, repo).select(id_("source").alias("source"), id_("target").alias("target"), F.col("kind").alias("relation"))
    edges = edges.unionByName(implements_links(spark, sf_dir, repo).select(id_("target").alias("source"), F.concat(F.lit("requirement:"), "identity").alias("target"), F.lit("implements").alias("relation")))
    path = lambda c: F.format_string("src/b%d/p%d.ts", F.col(c) % 25, F.col(c))
    pairs = reports.co_change_pairs(_touches(spark, sf_dir)).select(path("a").alias("a"), path("b").alias("b"), "times", "last")
    as_of = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).first()[0]
    return reports.workspace_risk(artifacts, edges, findings(spark, sf_dir, repo).withColumn("status", F.lit("open")), pairs, F.lit(as_of))


def repository_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the repository by risk, their importance their PageRank over imports and calls."""
    return _repository_risk(spark, sf_dir).drop("item")


_SQL_RISK = f"""rule as materialized ({SQL_FINDINGS}), link as materialized ({SQL_CODE_LINKS}), file as materialized ({SQL_REPO} select path, class from f), {SQL_PAIRS},
known_pairs as (select * from pairs where a in (select p_partkey from part) and b in (select p_partkey from part)), {SQL_WEIGHTS.replace("from pairs", "from known_pairs")},
dep as materialized (select source, target from link where kind in ('imports', 'calls') and source <> target),
ok as (select source node, target other from dep union all select target, source from dep),
steps as materialized (select node, other, count(*)::double / sum(count(*)) over (partition by node) share from ok group by node, other),
base as materialized (select path id, 1.0::double / count(*) over () start, path not in (select node from steps) loose from file),
walk as (select 0 k, id, start::double r from base
  union all
  select any_value(k) + 1, x.id, 0.25 * any_value(x.start) + 0.75 * sum(got) from (
    select w.k, s.other id, w.r * s.share got, b.start from walk w join steps s on s.node = w.id join base b on b.id = s.other where w.k < 25
    union all select k, base.id, lost * base.start, base.start from (select w.k, sum(w.r) lost from walk w join base bw on bw.id = w.id and bw.loose where w.k < 25 group by w.k) q, base
    union all select w.k, w.id, 0, b.start from walk w join base b on b.id = w.id where w.k < 25) x group by x.id),
ranked as (select id, r / max(r) over () rank from walk where k = 25),
held as (select path item, count(*) n from (select path from rule union all select target from rule where target is not null) group by 1),
fan as (select target, count(*) n from dep group by 1), co as (select 'src/b' || (item % 25) || '/p' || item || '.ts' item, weight from weights),
r as (select path, coalesce(held.n, 0) findings, case when class = 'code_metadata' and path not in (select target from link where kind = 'tests') then 1 else 0 end::bigint untested,
  case when fan.n > 0 then round((2 * rank)::decimal(28,12), 3) else 0 end::decimal(18,3) fan_in, least(1, coalesce(weight, 0))::decimal(18,3) co_change, 0::decimal(18,3) audit, coalesce(fan.n, 0) dependents
  from file left join held on held.item = path left join fan on fan.target = path left join co on co.item = path left join ranked on ranked.id = path),
scored as (select * exclude (dependents), (findings + untested + fan_in + co_change + audit)::decimal(18,3) score from r where findings > 0 or untested > 0 or dependents > 0 or co_change > 0)"""
_SQL_LEVEL = "case when score >= 4 then 'high' when score >= 2.5 then 'elevated' when score >= 1 then 'moderate' else 'low' end"
SQL_REPOSITORY_RISK = f"with recursive {_SQL_RISK} select *, {_SQL_LEVEL} as level from scored"


def graph_schema_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind, edges by relation and by family."""
    kind = F.when(F.col("source").startswith("r:"), "region").otherwise("artifact")
    return graph.schema_card(star_nodes(spark, sf_dir), star_edges(spark, sf_dir).withColumn("family", paths.edge_family(F.col("relation"), kind)))


SQL_SCHEMA_CARD = f"with {SQL_NODES}, {SQL_EDGES} select 'node' what, kind as name, count(*) n from nodes group by 2 union all select 'edge', relation, count(*) from edges group by 2 union all select 'family', 'semantic', count(*) from edges"


def degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes with the most ends of edges."""
    return graph.top_degrees(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


SQL_DEGREE_TOP = f"with {SQL_NODES}, {SQL_EDGES} select id, kind, count(other) degree from nodes left join ends on node = id group by id, kind order by degree desc, id limit 10"


def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deliveries: pushes of their lines' parts, check and workflow runs, pings; some runs are queued, some commits have no full hash."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), "l_partkey")).alias("modified"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, sha = F.col("o_orderkey"), F.sha2(F.col("o_orderkey").cast("string"), 256).substr(1, 40)
    head = F.when(key % 7 == 0, "main").otherwise(sha)
    run = F.struct(head.alias("head_sha"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failure").alias("conclusion"))
    body = F.struct(F.when(key % 3 == 0, "queued").otherwise("completed").alias("action"), head.alias("after"), F.struct(F.lit(1).alias("id"), F.lit("a/star").alias("full_name")).alias("repository"), F.struct(key.alias("id")).alias("installation"), run.alias("check_run"), run.alias("workflow_run"), F.array(F.struct(sha.alias("id"), F.col("modified"))).alias("commits"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("push", "check_run", "workflow_run", "ping")]), (key % 4 + 1).cast("int"))
    events = orders.select(key.cast("string").alias("delivery"), kind.alias("event"), F.to_json(body).alias("payload"))
    return report_sources.webhook_events(events).select("delivery", "event", "outcome", "action", "sha", "conclusion", F.col("installation").cast("string").alias("installation"), "repository", F.transform("commits", lambda c: F.concat_ws(",", c["paths"])).alias("c")).select("*", F.md5(F.concat_ws(";", "c")).alias("paths_digest")).drop("c")


SQL_WEBHOOKS = """with l as (select l_orderkey k, list_sort(list_distinct(list('p' || l_partkey))) ps from lineitem group by 1),
e as (select o_orderkey k, (['push', 'check_run', 'workflow_run', 'ping'])[(o_orderkey % 4 + 1)::int] event, case when o_orderkey % 3 = 0 then 'queued' else 'completed' end a, case when o_orderkey % 7 = 0 then 'main' else substr(sha256(o_orderkey::varchar), 1, 40) end s,
  case o_orderstatus when 'F' then 'success' when 'O' then 'failure' end c, case when o_orderkey % 4 = 0 and len(ps) between 2 and 50 then array_to_string(ps, ',') else '' end p from orders left join l on l.k = o_orderkey),
r as (select *, case when event = 'ping' or event <> 'push' and a = 'queued' then 'ignored' when s = 'main' then 'rejected' else 'accepted' end outcome from e)
select k::varchar delivery, event, outcome, case when outcome = 'accepted' and event <> 'push' then a end "action", case when outcome = 'accepted' then s end sha, case when outcome = 'accepted' and event <> 'push' then c end conclusion,
case when outcome = 'accepted' then k end::varchar installation, case when outcome = 'accepted' then 'a/star' end repository, md5(case when outcome = 'accepted' then p else '' end) paths_digest from r"""


def artifact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as artifacts with how often each relation leads to and from them."""
    nodes = star_nodes(spark, sf_dir).select("id", F.col("id").alias("path"), "kind")
    cards = workspace.artifact_cards(nodes, star_edges(spark, sf_dir))
    count = lambda m, r: F.coalesce(F.try_element_at(m, F.lit(r)), F.lit(0)).cast("long")
    return cards.select("id", "kind", *[count(m, r).alias(f"{m}_{r}") for m in ("incoming", "outgoing") for r in ("part_of", "produces")])


SQL_CARDS = f"""with {SQL_NODES}, {SQL_EDGES}, i as (select target id, count(*) filter (where relation = 'part_of') a, count(*) filter (where relation = 'produces') b from edges group by 1), o as (select source id, count(*) filter (where relation = 'part_of') a, count(*) filter (where relation = 'produces') b from edges group by 1)
select id, kind, coalesce(i.a, 0) incoming_part_of, coalesce(i.b, 0) incoming_produces, coalesce(o.a, 0) outgoing_part_of, coalesce(o.b, 0) outgoing_produces from nodes left join i using (id) left join o using (id)"""

QUERIES = {f.__name__: f for f in (repository_graph, edge_page_bounded, page_by_position, neighbour_ids, co_changed_nodes, finding_filter, library_filter, module_states, page_skeletons, change_brief, touched_nodes, hierarchy_groups, artifact_cards, publish_plan, published_rows, repository_risk, graph_schema_card, degree_top, webhook_events)}
ORACLES = {
    "repository_graph": SQL_GRAPH, "edge_page_bounded": SQL_EDGE_PAGE, "page_by_position": SQL_POSITIONS, "neighbour_ids": SQL_NEIGHBOUR_IDS, "co_changed_nodes": SQL_CO_CHANGED, "finding_filter": SQL_FINDING_FILTER, "library_filter": SQL_LIBRARY,
    "module_states": SQL_MODULES, "page_skeletons": SQL_PAGES, "change_brief": SQL_BRIEF, "touched_nodes": SQL_TOUCHED, "hierarchy_groups": SQL_HIERARCHY, "artifact_cards": SQL_CARDS, "publish_plan": SQL_PUBLISH, "published_rows": SQL_PUBLISHED,
    "repository_risk": SQL_REPOSITORY_RISK, "graph_schema_card": SQL_SCHEMA_CARD, "degree_top": SQL_DEGREE_TOP, "webhook_events": SQL_WEBHOOKS,
}
