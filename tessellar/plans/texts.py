"""Search, packing, routing and rule queries over documents, pages, labels and conversations, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import words
from tessellar.functions.columns import tokens
from tessellar.operators import reports, retrieval, search_index
from tessellar.plans.graphs import SQL_EDGES
from tessellar.sources.tables import shared_dir, star_edges, table

SEARCH = "small ring"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers, customers and documents as index entries."""
    row = lambda df, key, path, title, tags, symbols: df.select(key.alias("id"), path.alias("path"), title.alias("title"), key.alias("search_key"), F.array().cast("array<string>").alias("headings"), tags.alias("tags"), symbols.alias("symbols"))
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    customer, docs = table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents")
    place = F.when(F.col("s_suppkey") % 7 == 0, "small/ring").otherwise("other")
    out = row(part, text("p:", "p_partkey"), text("part/", "p_partkey"), F.col("p_name"), F.array("p_type"), F.array("p_brand"))
    out = out.unionByName(row(supplier, text("s:", "s_suppkey"), F.concat(F.lit("supplier/"), place, F.lit("/"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.array().cast("array<string>"), F.array().cast("array<string>")))
    out = out.unionByName(row(customer, text("c:", "c_custkey"), text("customer/", "c_custkey"), F.col("c_name"), F.array("c_mktsegment"), F.array().cast("array<string>")))
    first = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    return out.unionByName(row(docs, text("d:", "doc_id"), text("doc/", "doc_id"), first, F.array("lang"), F.array("source")))


def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for two words, by tier."""
    return retrieval.search(_entries(spark, sf_dir), star_edges(spark, sf_dir), SEARCH, compose=False).withColumn("points", F.col("points").cast("int"))


SQL_SEARCH = f"""with {SQL_EDGES}, e as (select 'p:' || p_partkey id, 'part/' || p_partkey path, p_name title, p_type tags, p_brand symbols from part
  union all select 's:' || s_suppkey, 'supplier/' || case when s_suppkey % 7 = 0 then 'small/ring' else 'other' end || '/' || s_suppkey, s_name, '', '' from supplier
  union all select 'c:' || c_custkey, 'customer/' || c_custkey, c_name, c_mktsegment, '' from customer
  union all select 'd:' || doc_id, 'doc/' || doc_id, coalesce(split_part(text, chr(10), 1), ''), coalesce(lang, ''), coalesce(source, '') from documents),
n as (select id, path, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) t, lower(title || ' ' || tags) h, lower(path || ' ' || symbols) p, lower(tags) g, lower(symbols) s from e),
d as (select id, path, case when 'small ring' in (t, lower(path), lower(id), trim(g), trim(s)) then 'exact' when contains(h, 'small') and contains(h, 'ring') then 'title-heading' when contains(p, 'small') and contains(p, 'ring') then 'path-symbol' end tier from n),
a as (select id, path, coalesce(tier, case when id in (select other from ends where node in (select id from d where tier is not null)) then 'graph-neighbor' end) tier from d)
select id, path, tier, case tier when 'exact' then 400 when 'title-heading' then 300 when 'path-symbol' then 200 else 100 end points from a where tier is not null"""


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits, found through a trigram index of all entries that is written first."""
    path = f"{shared_dir(spark)}/tables/index-{uuid.uuid4().hex}"
    search_index.write_index(_entries(spark, sf_dir), path, compose=False)
    return search_index.indexed_search(spark, path, star_edges(spark, sf_dir), SEARCH).withColumn("points", F.col("points").cast("int"))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 hits by points, path and id, and how many there are."""
    return retrieval.search_page(search_tiers(spark, sf_dir))


SQL_SEARCH_PAGE = f"select *, count(*) over () eligible, greatest(count(*) over () - 20, 0) omitted from ({SQL_SEARCH}) order by points desc, path, id limit 20"


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits with the points of their connection added."""
    return retrieval.search(_entries(spark, sf_dir), star_edges(spark, sf_dir), SEARCH, compose=False, connected=True)


def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of parts and suppliers around the rings, 1,200 tokens."""
    rows = _entries(spark, sf_dir).where("id like 'p:%' or id like 's:%'").select("id", "path", F.lit("code").alias("kind"), F.concat("tags", "symbols", F.array("title")).alias("symbols"))
    return retrieval.repo_map(rows, star_edges(spark, sf_dir), ["ring"])


def context_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for a task, with relations from each to the one before it."""
    return _ranked(spark, sf_dir)


TASK = "the und les from d7"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") == 3, "agents").otherwise(F.element_at(F.array(*[F.lit(k) for k in retrieval.KIND_POINTS]), (F.col("doc_id") % 7 + 1).cast("int")))
    path = F.when(F.col("doc_id") == 3, "AGENTS.md").otherwise(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")))
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), kind.alias("kind"), path.alias("path"), F.lit("note").alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.array().cast("array<string>").alias("related"))
    ids = docs.where("doc_id > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("d"), (F.col("doc_id") - 1).cast("string")).alias("target"), F.col("lang").alias("source_label"), F.lit(None).cast("string").alias("target_label"))
    return retrieval.context_ranking(rows, ids, TASK)


SQL_RANKED = """with d as (select doc_id, 'd' || doc_id id, case when doc_id = 3 then 'agents' else (['agents', 'claude', 'spec', 'todo_progress', 'skill', 'cursor_rule', 'adr'])[(doc_id % 7 + 1)::int] end kind, case when doc_id = 3 then 'AGENTS.md' else 'notes/' || doc_id || '.md' end path, coalesce(text, '') content, lang from documents),
w as (select *, len(list_intersect(['d7', 'from', 'les', 'the', 'und'], regexp_split_to_array(lower(path || ' note ' || content), '[^\\pL\\pN]+'))) keywords from d),
g as (select id, count(*) graph from (select 'd' || doc_id id, 'd' || (doc_id - 1) far from documents where doc_id > 0 union all select 'd' || (doc_id - 1), 'd' || doc_id || ' ' || coalesce(lang, '') from documents where doc_id > 0) where len(list_intersect(['d7', 'from', 'les', 'the', 'und'], regexp_split_to_array(lower(far), '[^\\pL\\pN]+'))) > 0 group by 1)
select w.id, path, kind, keywords::int keywords, coalesce(graph, 0) graph, (case when path = 'AGENTS.md' then 10000 else 0 end + 100 * coalesce(graph, 0) + 10 * keywords + case kind when 'agents' then 100 when 'claude' then 90 when 'spec' then 50 when 'todo_progress' then 40 when 'skill' then 30 when 'cursor_rule' then 20 else 10 end)::bigint score,
  greatest(1, ceil(length(content) / 4))::bigint cost, keywords > 0 or coalesce(graph, 0) > 0 or path = 'AGENTS.md' relevant from w left join g using (id)"""


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of that ranking in 6,000 tokens, and what it leaves out."""
    return retrieval.context_pack(_ranked(spark, sf_dir), 6000)


SQL_CONTEXT = f"""with recursive r as materialized ({SQL_RANKED}), o as materialized (select *, row_number() over (order by score desc, path, id) k from r where relevant),
f as (select 0::bigint k, 0::bigint used, false took union all select o.k, case when used + cost <= 6000 then used + cost else used end, used + cost <= 6000 from f join o on o.k = f.k + 1),
t as (select o.id, row_number() over (order by o.k) rank from f join o using (k) where took)
select r.id, path, cost, rank::int as rank, case when rank is not null then 'selected' when not relevant then 'No task-term or evidence-graph match.' else 'Token budget reserved for higher-ranked documents.' end reason from r left join t using (id)"""


def term_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by words of a question in their path and text."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return retrieval.term_ranking(docs, "Which web text has the words und and les?")


SQL_TERMS = """with q as (select ['which', 'web', 'text', 'has', 'the', 'words', 'und', 'and', 'les'] q), d as (select concat_ws('/', source, lang, doc_id) path, coalesce(text, '') c from documents)
select path, score from (select path, (12 * len(list_intersect(q, regexp_split_to_array(lower(path), '[^\\pL\\pN_-]+'))) + 3 * len(list_intersect(q, regexp_split_to_array(lower(c), '[^\\pL\\pN_-]+'))))::bigint score from d, q) where score > 0"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties as nodes: paths by place, summaries by balance, relations by orders."""
    from tessellar.functions import paths

    c = table(spark, sf_dir, "customer")
    kinds = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("relations"), F.array_sort(F.collect_set("o_orderstatus")).alias("families"))
    path = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("apps/web/", "db/", "docs/", "src/", "x/")]), (F.col("c_nationkey") % 5 + 1).cast("int")), F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".ts"))
    rows = c.join(kinds, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("path", path)
    state = F.when(F.col("c_acctbal") > 5000, "current").when(F.col("c_acctbal") > 0, "stale").otherwise("missing")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_acctbal") < 0, "open").otherwise("done").alias("status"), "path", paths.domain(F.col("path"), F.lit("code_metadata")).alias("domain"), paths.unit(F.col("path"), F.lit("code_metadata")).alias("unit"), "families", "relations", state.alias("summary_state"))


def query_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that pass all kinds of filters at once, the first 50 by type, path and id."""
    found = retrieval.query_nodes(_nodes(spark, sf_dir), types=["BUILDING", "MACHINERY", "FURNITURE"], statuses=["done"], domains=["frontend", "shared"], units=["code"], families=["F", "P"], relations=["1-URGENT", "2-HIGH"], without_relations=["9-NONE"], has_summary=True, path="N1", path_glob="**/n1*/*.ts")
    return retrieval.limited(found.select("id", "type", "path"), ["type", "path", "id"], 50)


SQL_QUERY = """with k as (select o_custkey, list(distinct o_orderpriority) r, list(distinct o_orderstatus) f from orders group by 1),
n as (select c_custkey id, c_mktsegment type, (['apps/web/', 'db/', 'docs/', 'src/', 'x/'])[(c_nationkey % 5 + 1)::int] || 'n' || c_nationkey || '/c' || c_custkey || '.ts' path, c_acctbal b, c_nationkey nk, r, f from customer left join k on o_custkey = c_custkey),
h as (select id, type, path from n where type in ('BUILDING', 'MACHINERY', 'FURNITURE') and b > 5000 and nk % 5 in (0, 2, 3) and list_has_any(f, ['F', 'P']) and list_has_all(r, ['1-URGENT', '2-HIGH']) and nk::varchar like '1%')
select *, greatest((select count(*) from h) - 50, 0) dropped from h order by type, path, id limit 50"""


def context_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that fit into 300 tokens, the system's first, then by length of role and turn; those that don't fit are skipped."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens(F.col("text")).alias("cost"))
    return retrieval.pack(turns, "conv_id", [F.when(F.col("role") == "system", 0).otherwise(1), F.length("role"), F.col("turn")], "turn", F.col("cost"), 300)


SQL_PACK = """with recursive t as (select conv_id, turn, ceil(coalesce(length(text), 0) / 4)::bigint cost, row_number() over (partition by conv_id order by case when role = 'system' then 0 else 1 end, length(role), turn) k from conversations),
f as (select conv_id, 0::bigint k, 0::bigint used, ''::varchar items from (select distinct conv_id from t)
  union all select f.conv_id, t.k, case when used + cost <= 300 then used + cost else used end, case when used + cost <= 300 then case when items = '' then turn::varchar else items || ',' || turn end else items end from f join t on t.conv_id = f.conv_id and t.k = f.k + 1)
select conv_id, used, items from f qualify row_number() over (partition by conv_id order by k desc) = 1"""


def next_fit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 1,500 characters of each conversation's turns in order."""
    return retrieval.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long"), 1500)


SQL_BATCHES = """with recursive t as (select conv_id, coalesce(length(text), 0)::bigint size, row_number() over (partition by conv_id order by turn) k from conversations),
f as (select conv_id, 0::bigint k, 0::bigint n, 0::bigint held, 0::bigint largest from (select distinct conv_id from t)
  union all select f.conv_id, t.k, case when n = 0 or held + size > 1500 then n + 1 else n end, case when n = 0 or held + size > 1500 then size else held + size end, greatest(largest, case when n = 0 or held + size > 1500 then size else held + size end) from f join t on t.conv_id = f.conv_id and t.k = f.k + 1)
select conv_id, n n_batches, largest from f qualify row_number() over (partition by conv_id order by k desc) = 1"""


def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every user's turn, where it goes, what answers it and where to go if nothing does."""
    signals, way = retrieval.route(F.col("text"))
    found = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", signals.alias("s"), way.alias("route"))
    tools, other = retrieval.route_tools(F.col("route"))
    return found.select("conv_id", "turn", F.array_join("s", ",").alias("signals"), "route", F.array_join(tools, ",").alias("tools"), other.alias("fallback"))


_SIGNALS = ", ".join(f"case when regexp_matches(text, '{p}') then '{name}' end" for name, p in retrieval.ROUTES.items())
SQL_ROUTE = f"""with s as (select conv_id, turn, list_filter([{_SIGNALS}], lambda x: x is not null) s from conversations where role = 'user')
select conv_id, turn, coalesce(array_to_string(s, ','), '') signals, case when len(s) > 0 then 'graph' else 'search' end route, case when len(s) > 0 then 'search_index,get_neighbors,trace_path,impact_of,query_brain' else 'search_index,get_artifact' end tools, case when len(s) > 0 then 'search' else 'graph' end fallback from s"""


def prompt_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's turn shows, and the most points it can have on each axis."""
    shown, most = words.prompt_signals(F.col("text")), words.rubric_ceilings(F.col("text"))
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", *[c.alias(n) for n, c in shown.items()], most.alias("m"))
    return rows.select("conv_id", "turn", *shown, "m.*")


SQL_PROMPTS = f"""with s as (select conv_id, turn, regexp_matches(text, '{words.PROMPT_SIGNALS["verification"]}') verification, regexp_matches(text, '{words.PROMPT_SIGNALS["context"]}') context, regexp_matches(text, '{words.PROMPT_SIGNALS["stop"].replace("'", "''")}') stop,
len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))::int words from conversations where role = 'user' and text is not null)
select *, case when words < 8 then 1 else 2 end batch_size, case when context then 2 else 0 end context_grounding, 2 no_over_instruction, case when words < 8 then 0 else 2 end specificity, case when stop then 2 else 0 end stop_condition, case when verification then 2 else 0 end verifiability from s"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, how often, and the pages they lead to (the smallest id of a url)."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("times"))
    known = pages.where("url is not null").groupBy(F.col("url").alias("href")).agg(F.min("page_id").alias("leads_to"))
    return links.join(known, "href", "left").select("page_id", "href", "times", "leads_to")


SQL_LINKS = """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages), c as (select page_id, href, count(*) times from l group by all), k as (select url href, min(page_id) leads_to from pages group by 1)
select page_id, c.href, times, leads_to from c left join k on k.href = c.href"""


def path_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by first path segment and depth."""
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("facet"), F.size(parts).alias("depth")).groupBy("facet", "depth").agg(F.count("*").alias("n"))


SQL_FACETS = """with p as (select list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') a from pages) select coalesce(a[1], '') facet, len(a)::int as depth, count(*) n from p group by all"""


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of licence lines that one language's documents state and that differ, with how many documents state each; a document may state several."""
    lines = F.array_distinct(F.regexp_extract_all("text", F.lit(r"Licensed under ([A-Za-z0-9 .,-]*)"), F.lit(1)))
    stated = table(spark, sf_dir, "documents").select("lang", F.explode(lines).alias("licence")).where("licence <> ''").groupBy("lang", "licence").agg(F.count("*").alias("n"))
    other = stated.select("lang", F.col("licence").alias("other"), F.col("n").alias("n_other"))
    return stated.join(other, "lang").where("licence < other").select("lang", "licence", "other", "n", "n_other")


SQL_CONTRADICTIONS = """with l as (select lang, unnest(list_distinct(regexp_extract_all(text, 'Licensed under ([A-Za-z0-9 .,-]*)', 1))) licence from documents), s as (select lang, licence, count(*) n from l where licence <> '' group by all)
select a.lang, a.licence, b.licence other, a.n, b.n n_other from s a join s b on a.lang = b.lang and a.licence < b.licence"""


def untested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label covers."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "lang", "source")


SQL_UNTESTED = "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)"


def reconcile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new findings (toxic labels) do to known ones (labels of low quality; those of both are dismissed)."""
    labels = table(spark, sf_dir, "labels")
    before = labels.where("quality = 0").select("doc_id", F.when(F.col("toxic") == 1, "dismissed").otherwise("open").alias("status"))
    return reports.reconcile(before, labels.where("toxic = 1").select("doc_id"), "doc_id", "status")


SQL_RECONCILE = """select coalesce(a.doc_id, b.doc_id) doc_id, case when a.status = 'dismissed' then 'dismissed' when b.doc_id is null then 'resolved' when a.status is null then 'opened' else 'kept' end state
from (select doc_id, case when toxic = 1 then 'dismissed' else 'open' end status from labels where quality = 0) a full join (select doc_id from labels where toxic = 1) b on a.doc_id = b.doc_id"""


def severity_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings of each source by severity, zero where there are none."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    high, medium = (F.col("toxic") == 1), (F.col("quality") == 0) & (F.col("toxic") == 0)
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count_if(high).alias("high"), F.count_if(medium).alias("medium"), F.count_if(F.col("toxic").isNotNull() & ~high & ~medium).alias("none"))


SQL_SEVERITY = """select source, count(*) filter (where toxic = 1) high, count(*) filter (where quality = 0 and toxic = 0) medium, count(*) filter (where toxic = 0 and quality <> 0) "none" from documents left join labels using (doc_id) group by 1"""


def instruction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents by source and language, and of those short enough to be always loaded."""
    t = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(t).alias("tokens"), F.coalesce(F.sum(F.when(t <= 200, t)), F.lit(0)).alias("always"))


SQL_COST = """select source, lang, count(*) n, sum(ceil(coalesce(length(text), 0) / 4))::bigint tokens, coalesce(sum(ceil(coalesce(length(text), 0) / 4)) filter (where ceil(coalesce(length(text), 0) / 4) <= 200), 0)::bigint always from documents group by all"""


def query_all_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of every priority there is."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    n = orders.select("o_orderpriority").distinct().count()
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.col("n") == n).select("o_custkey")


SQL_ALL = "select o_custkey from orders group by 1 having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders)"


def query_any_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_semi")


SQL_ANY = "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')"


def query_none_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    buyers = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(buyers, "c_custkey", "left_anti")


SQL_NONE = "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey is not null)"


def todo_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of turns that come again in their conversation, in lower case with one blank for white space, numbered by turn."""
    from pyspark.sql import Window as W

    title = F.lower(F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+", " ")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"))
    return turns.withColumn("occurrence", F.row_number().over(W.partitionBy("conv_id", "title").orderBy("turn")))


SQL_OCCURRENCES = r"""with t as (select conv_id, turn, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))) title from conversations) select conv_id, turn, title, row_number() over (partition by conv_id, title order by turn)::int occurrence from t"""

QUERIES = {f.__name__: f for f in (search_tiers, search_indexed, search_page, search_ranked, repo_map, context_ranking, context_pack, term_ranking, query_nodes, prompt_signals, context_pack_greedy, next_fit_batches, route_question, page_links, path_facets, contradictions, untested_documents, reconcile_findings, severity_dashboard, instruction_cost, query_all_priorities, query_any_urgent, query_none_urgent, todo_occurrences)}
ORACLES = {
    "search_tiers": SQL_SEARCH, "search_indexed": SQL_SEARCH, "search_page": SQL_SEARCH_PAGE, "context_ranking": SQL_RANKED, "context_pack": SQL_CONTEXT, "term_ranking": SQL_TERMS, "query_nodes": SQL_QUERY, "prompt_signals": SQL_PROMPTS, "context_pack_greedy": SQL_PACK, "next_fit_batches": SQL_BATCHES, "route_question": SQL_ROUTE,
    "page_links": SQL_LINKS, "path_facets": SQL_FACETS, "contradictions": SQL_CONTRADICTIONS, "untested_documents": SQL_UNTESTED, "reconcile_findings": SQL_RECONCILE, "severity_dashboard": SQL_SEVERITY,
    "instruction_cost": SQL_COST, "query_all_priorities": SQL_ALL, "query_any_urgent": SQL_ANY, "query_none_urgent": SQL_NONE, "todo_occurrences": SQL_OCCURRENCES,
}
