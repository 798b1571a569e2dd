"""Answers, grades, receipts and content of the star's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import assurance, graph, progress, resolve, retrieval, sinks, trials, workspace
from tessellar.plans.graphs import SQL_EDGES, SQL_NODES
from tessellar.sources import reports as report_sources
from tessellar.sources.tables import star_edges, star_nodes, table


def _named(letter: str, key: str):
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def affected_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers of nations below 12, these nations and what is made there affect: parts with even keys are documents, regions tables, nations routes; customers test their nation."""
    key = F.substring_index("id", ":", -1).cast("long")
    kind = F.when(F.col("kind") == "region", "db_object").when(F.col("kind") == "nation", "route").otherwise("artifact")
    nodes = star_nodes(spark, sf_dir).select("id", kind.alias("kind"), F.when((F.col("kind") == "part") & (key % 2 == 0), "doc").alias("class"))
    edges = star_edges(spark, sf_dir)
    relation = F.when(F.col("source").startswith("c:"), "tests").when(F.col("source").startswith("n:"), "queries").when(F.col("source").startswith("s:") & (F.col("relation") == "part_of"), "imports").otherwise(F.col("relation"))
    near = edges.where("source like 's:%' and relation = 'part_of'").where(F.substring_index("target", ":", -1).cast("long") < 12)
    made = edges.where("relation = 'produces'").join(near.select("source"), "source", "left_semi").select(F.col("target").alias("node"))
    reached = near.select(F.explode(F.array("source", "target")).alias("node")).unionByName(made).distinct()
    return graph.affected(nodes, edges.withColumn("relation", relation), reached)


SQL_AFFECTED = """with s as (select s_suppkey s, s_nationkey n from supplier where s_nationkey < 12 and s_nationkey in (select n_nationkey from nation))
select distinct 'doc' what, 'p:' || p_partkey id from part join lineitem on l_partkey = p_partkey where p_partkey % 2 = 0 and l_suppkey in (select s from s)
union all select distinct 'route', 'n:' || n from s union all select distinct 'table', 'r:' || n_regionkey from s join nation on n_nationkey = n where n_regionkey in (select r_regionkey from region)
union all select distinct 'test', 'c:' || c_custkey from customer where c_nationkey in (select n from s)"""


def edge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by tier: membership is resolved, products are references or of no tier that is known."""
    even = F.substring_index("target", ":", -1).cast("long") % 2 == 0
    return graph.tier_tally(star_edges(spark, sf_dir).withColumn("tier", F.when(F.col("relation") == "part_of", "resolved").when(even, "reference").otherwise("guess")))


SQL_TIERS = f"with {SQL_EDGES}, e as (select distinct source, target, relation from edges) select 0::bigint agent_asserted, 0::bigint inferred, count(*) filter (where relation = 'produces' and string_split(target, ':')[2]::bigint % 2 = 0) reference, count(*) filter (where relation = 'part_of') resolved, count(*) filter (where relation = 'produces' and string_split(target, ':')[2]::bigint % 2 = 1) unstated from e"


def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are left when customers are hidden."""
    return graph.visible(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), F.col("kind") != "customer")[1].select("source", "target", "relation")


SQL_VISIBLE = f"with {SQL_NODES}, {SQL_EDGES} select source, target, relation from edges where source in (select id from nodes where kind <> 'customer') and target in (select id from nodes where kind <> 'customer')"


def receipts_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts of their customers: each names the order with the next smaller key; where dates go another way, the chain breaks."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("repository"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").cast("string").alias("digest"), F.lag(F.col("o_orderkey").cast("string")).over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("previous"))
    return assurance.receipt_chain(rows).select("repository", "digest", "previous", "continuous")


SQL_RECEIPTS = """with r as (select o_custkey::varchar repository, o_orderdate made, o_orderkey::varchar digest, lag(o_orderkey::varchar) over (partition by o_custkey order by o_orderkey) previous from orders)
select repository, digest, previous, previous is not distinct from lag(digest) over (partition by repository order by made, digest) continuous from r"""


def tasks_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks whose keys changed: every third keeps its key, the others are known again by their title."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("task "), (F.col("p_partkey") % 700).cast("string")).alias("title"))
    todos = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("a:"), "p_partkey").alias("source_key"), "title")
    incoming = p.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "a:").otherwise("b:"), "p_partkey").alias("source_key"), F.upper("title").alias("title"))
    return progress.migrated_keys(todos, incoming)


SQL_MIGRATED = "with t as (select p_partkey p, p_partkey % 700 t from part where p_partkey % 3 <> 0) select min(p) id, min('b:' || p) source_key from t group by t"


def url_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main handler of each nation's url among its customers' files."""
    c = table(spark, sf_dir, "customer")
    return resolve.main_handlers(c.select(F.concat(F.lit("/nations/"), "c_nationkey").alias("url"), F.concat(F.lit("api/"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path")))


SQL_HANDLERS = "select '/nations/' || c_nationkey url, arg_min('api/' || c_custkey || '.py', {'n': -length(c_custkey::varchar), 'p': 'api/' || c_custkey || '.py'}) path from customer group by 1"


def relations_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges a client that knows membership only isn't shown."""
    return resolve.kept_edges(star_edges(spark, sf_dir), spark.createDataFrame([("part_of",)], "relation string"))[1]


SQL_OMITTED = f"with {SQL_EDGES} select relation, count(*) omitted from edges where relation <> 'part_of' group by 1"


def fact_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks with two facts, of which answers hold the one, the other or both."""
    c = table(spark, sf_dir, "customer")
    fact = lambda n, *aliases: F.struct(F.lit(n).alias("fact"), F.array(*aliases).alias("aliases"))
    nation = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    facts = c.select(F.col("c_custkey").alias("task"), F.explode(F.array(fact("a", F.lower("c_mktsegment"), F.lit("no segment")), fact("b", nation))).alias("f")).select("task", "f.*")
    answers = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("task"), F.concat(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none"), F.lit(" of "), F.when(F.col("c_custkey") % 3 == 0, nation).otherwise("nowhere")).alias("answer"))
    return trials.fact_grades(facts, answers)


SQL_FACTS = "select c_custkey task, (m)::bigint matched, 2::bigint facts, m / 2 score from (select c_custkey, case when c_custkey % 7 = 0 then 0 else (c_custkey % 2 = 0)::int + (c_custkey % 3 = 0)::int end m from customer)"


def fix_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as fixes of the parts in them."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("paths"))
    commits = table(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("subject"), "paths")
    return trials.fix_touches(commits, "^[12]")


SQL_FIXES = "select l_partkey::varchar path, count(distinct l_orderkey) touches from lineitem join orders on o_orderkey = l_orderkey where regexp_matches(o_orderpriority, '^[12]') group by 1"


def arms_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second lines of orders as two arms of a trial: units that both have."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.lit("star").alias("model"), F.lit(1).alias("trial"), F.col("l_linenumber").cast("string").alias("arm"), F.when(F.col("l_returnflag") != "R", F.col("l_discount").cast("double")).alias("score"), F.col("l_quantity").cast("long").alias("tokens"))
    return trials.paired(lines, "1", "2")


SQL_PAIRED = "select a.l_orderkey task, 'star' model, 1 trial, case when a.l_returnflag <> 'R' then a.l_discount::double else 0 end baseline_score, case when b.l_returnflag <> 'R' then b.l_discount::double else 0 end treatment_score, a.l_quantity::bigint baseline_tokens, b.l_quantity::bigint treatment_tokens from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2"


def arm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as trials of arms by their flag: tokens a call, and the share read from a cache; an arm without calls has null."""
    lines = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("long")
    return trials.tokens_a_call(lines.select(F.col("l_returnflag").alias("arm"), quantity.alias("input"), F.when(F.col("l_linestatus") == "O", quantity).otherwise(0).alias("cached"), F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_linenumber")).alias("calls")))


SQL_ARM_TOKENS = "select l_returnflag arm, case when l_returnflag <> 'A' then sum(l_quantity::bigint)::double / sum(l_linenumber)::double end tokens_per_call, coalesce(sum(l_quantity::bigint) filter (where l_linestatus = 'O'), 0)::double / sum(l_quantity::bigint)::double cache_share from lineitem group by 1"


def titles_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as titles and conversations as runs: which come more than once."""
    counts = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    runs = counts.groupBy(F.col("conv_id").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("counts"))
    return trials.todo_duplication(runs)


SQL_REPEATED = "select role title, count(*)::bigint n, count(distinct conv_id) runs from conversations where role is not null group by 1 having count(*) > 1"


def files_to_summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose stored digest is missing, blank or another one's."""
    p = table(spark, sf_dir, "part")
    stored = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 1, " ").when(F.col("p_partkey") % 5 == 2, "old").otherwise(F.concat(F.col("p_type"), F.lit(" ")))
    return workspace.to_summarise(p.select(F.col("p_partkey").alias("path"), F.col("p_type").alias("blob"), stored.cast("string").alias("summary_blob"))).select("path")


SQL_TO_SUMMARISE = "select p_partkey path from part where p_partkey % 5 < 3"


def omissions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories that leave out edges: sums, and the last reason."""
    n = table(spark, sf_dir, "nation")
    return workspace.omitted_edges(n.select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("r"), "n_regionkey").alias("relation"), F.col("n_nationkey").cast("long").alias("omitted"), F.col("n_name").alias("reason")))


SQL_OMISSIONS = "select 'r' || n_regionkey relation, sum(n_nationkey)::bigint omitted, arg_max(n_name, n_nationkey) reason from nation group by 1"


def node_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers, suppliers and places have to show; places have nothing."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    asked = star_nodes(spark, sf_dir).where("kind <> 'part'")
    return workspace.node_content(asked, customer=c.select(_named("c", "c_custkey").alias("id"), F.col("c_name").alias("content")), supplier=s.select(_named("s", "s_suppkey").alias("id"), F.col("s_name").alias("content")))


SQL_CONTENTS = "select 'c:' || c_custkey id, 'customer' kind, c_name content from customer union all select 's:' || s_suppkey, 'supplier', s_name from supplier union all select 'n:' || n_nationkey, null, null from nation union all select 'r:' || r_regionkey, null, null from region"


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return sinks.last_write(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_id", "event_type"])


SQL_LAST_EVENTS = "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1"


def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with the path of nation 3: one of several repositories, and so ambiguous."""
    artifacts = table(spark, sf_dir, "customer").select(_named("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("repository"), F.concat(F.lit("n"), "c_nationkey").alias("path"))
    return retrieval.lookup(artifacts, "n3", star_edges(spark, sf_dir)).select("id", "repository", "path", "ambiguous", F.array_join("neighbours", ",").alias("neighbours"))


SQL_LOOKUP = "select id, repository, path, n > 1 ambiguous, case when n = 1 then 'n:3' end neighbours from (select 'c:' || c_custkey id, c_mktsegment repository, 'n3' path, count(*) over () n, row_number() over (order by c_mktsegment, 'c:' || c_custkey) k from customer where c_nationkey = 3) where k <= 25"


def finding_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where findings on parts stand, of documents of which some lack a line or are no JSON."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    span = F.struct(F.concat(F.lit("src/p"), key).alias("path"), key.cast("int").alias("startLine"), F.when(key % 4 != 0, (key + 1).cast("int")).alias("endLine"))
    text = F.when(key % 5 == 0, "{broken").otherwise(F.to_json(F.struct(span.alias("span"), F.when(key % 3 == 0, "resolved").otherwise("sure").alias("tier"), F.lit("rule").alias("method"))))
    return p.select(key.alias("id"), workspace.provenance(text).alias("v")).select("id", "v.*")


SQL_PROVENANCE = """select p_partkey id, case when w then 'src/p' || p_partkey else '' end path, case when w then p_partkey else 0 end::int start_line, case when w then p_partkey + 1 else 0 end::int end_line,
case when r and p_partkey % 3 = 0 then 'resolved' else 'unknown' end tier, case when r then 'rule' end "method" from (select p_partkey, p_partkey % 5 <> 0 r, p_partkey % 5 <> 0 and p_partkey % 4 <> 0 w from part)"""


def issue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as issue exports with a line for each order, the last one broken: items that aren't done are open."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit('{"id":"o'), "o_orderkey", F.lit('","title":" Order '), "o_orderkey", F.lit('","status":"open"}')).alias("line"))
    exports = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("ls")).select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.array_join(F.concat(F.col("ls.line"), F.array(F.lit("{"))), "\n").alias("text"))
    return report_sources.issue_items(exports).select("path", F.col("line").cast("long").alias("line"), "source_key", "status", "title")


SQL_ISSUES = "select 'c' || o_custkey path, row_number() over (partition by o_custkey order by o_orderkey) line, 'beads:c' || o_custkey || ':o' || o_orderkey source_key, 'open' status, 'Order ' || o_orderkey title from orders"

def memory_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to their users' memory: thirty keys, two texts, every eleventh removes."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    writes = e.select(i.alias("seq"), F.lit("memory").alias("name"), F.concat(F.lit("k"), (i * 7 % 30).cast("string")).alias("entry_key"), F.col("user_id").cast("string").alias("anchor"), F.concat(F.lit("text "), (i % 2).cast("string")).alias("text"), (i % 11 == 0).alias("remove"))
    return sinks.memory_states(writes)


SQL_MEMORY = """with recursive w as materialized (select event_id seq, user_id a, 'k' || (event_id * 7 % 30) k, event_id % 2 t, event_id % 11 = 0 rm, row_number() over (partition by user_id order by event_id) n from events),
fold as (select a, 0::bigint n, null::bigint seq, null::varchar outcome, []::struct(k varchar, t bigint)[] held from (select distinct a from w)
  union all select a, n, seq, outcome, case outcome when 'invalidated' then rest when 'noop' then held when 'rejected_cap' then held else list_append(rest, {'k': k, 't': t}) end from (
    select w.*, held, list_filter(held, lambda x: x.k <> w.k) rest, list_filter(held, lambda x: x.k = w.k)[1].t known,
      case when rm then case when known is null then 'noop' else 'invalidated' end when known = w.t then 'noop' when known is null and len(held) >= 12 then 'rejected_cap' when known is null then 'added' else 'updated' end outcome
    from fold f join w on w.a is not distinct from f.a and w.n = f.n + 1))
select seq, outcome from fold where n > 0"""

QUERIES = {f.__name__: f for f in (affected_set, edge_tiers, visible_edges, receipts_continuous, tasks_migrated, url_handlers, relations_omitted, fact_grades, fix_touches, arms_paired, arm_tokens, titles_repeated, files_to_summarise, omissions_merged, node_contents, last_events, artifact_lookup, finding_provenance, issue_items, memory_outcomes)}
ORACLES = {
    "affected_set": SQL_AFFECTED, "edge_tiers": SQL_TIERS, "visible_edges": SQL_VISIBLE, "receipts_continuous": SQL_RECEIPTS, "tasks_migrated": SQL_MIGRATED, "url_handlers": SQL_HANDLERS, "relations_omitted": SQL_OMITTED,
    "fact_grades": SQL_FACTS, "fix_touches": SQL_FIXES, "arms_paired": SQL_PAIRED, "arm_tokens": SQL_ARM_TOKENS, "titles_repeated": SQL_REPEATED, "files_to_summarise": SQL_TO_SUMMARISE, "omissions_merged": SQL_OMISSIONS,
    "node_contents": SQL_CONTENTS, "last_events": SQL_LAST_EVENTS, "artifact_lookup": SQL_LOOKUP, "finding_provenance": SQL_PROVENANCE, "issue_items": SQL_ISSUES, "memory_outcomes": SQL_MEMORY,
}
