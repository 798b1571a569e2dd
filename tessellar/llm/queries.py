"""The queries of this package: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import centroids, chat, decontam, html_text, langid, linededup, media, mixing, neardup, quality, url_filters, warc, whitening
from tessellar.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query, and the host labels whose URLs make its list.
URL_RULES = (
    url_filters.Rule("block", "net/"),
    url_filters.Rule("allow", "example.net/en/"),
    url_filters.Rule("block", "example.com/de/"),
    url_filters.Rule("allow", "org/fr/"),
)
LISTED_HOSTS = r"(^|\.)(spam-farm|casino-win)\."


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the list holds the URLs seen on known hosts."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(url_filters.url_host(F.col("url")).rlike(LISTED_HOSTS))
    return url_filters.judge_urls(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as part of a raw transcript, its speaker recovered; the model counts two thirds of the conversations."""
    raw = chat.as_raw(table(spark, sf_dir, "conversations"))
    model = chat.train(raw.where(crc_mod(F.col("conv_id"), 3) != 1))
    found = chat.format_chats(raw, model)
    return found.select("conv_id", "turn", F.col("role").alias("role_pred"), "n_lines", "n_turns", "rendered")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a progressive JPEG file and read back, with its full-resolution RGB tensor."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.read_media(media.texts_to_media(docs))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "tensor")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place has."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability that mixes sources, languages and topics to tempered shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    found = mixing.mix(docs, dims, mixing.n_tokens(F.col("text")))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"), "sampled")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows of ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_sha256(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out)
    found = quality.score_quality(docs, model, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's centroid after three of Lloyd's rounds over two trees."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by the wrapper of its host."""
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened coordinates on the eight leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL_URL = """
with u as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path,
  regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) query, rest from u),
c as (select *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^&]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') canon from h),
r as (select *, case when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule from c)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when rest <> '' and canon in (select canon from c where regexp_matches(host, '(^|\\.)(spam-farm|casino-win)\\.')) then 'block' else 'allow' end verdict from r
"""

SQL_WARC = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha256(b) payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first then first end refers_to from f
"""

SQL_DECONTAMINATION = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
i as (select item_id, w, least(len(w), 10) n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) k from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[k + 1 : k + n], ' ') g from i),
sizes as (select distinct n from windows),
e as (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) k from d, sizes where len(w) >= n),
g as (select doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') g from e),
found as (select g.doc_id, g.n, g.k, windows.item_id from g join windows on g.n = windows.n and g.g = windows.g),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from found) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item_id::varchar item from found) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits on hits.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

SQL_NEAR_DUPLICATES = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
e as (select doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) k from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[k + 1 : k + 5], ' ') g from e),
n as (select doc_id, count(*) n from s group by doc_id),
classes as (select doc_id, min(doc_id) over (partition by md5(string_agg(g, chr(10) order by g))) c from s group by doc_id),
t as materialized (select s.doc_id, g from s join classes using (doc_id) where doc_id = c),
common as (select a.doc_id a, b.doc_id b, count(*) n_both from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * n_both >= 75 * (x.n + y.n - n_both) union select c, doc_id from classes where c <> doc_id),
sides as materialized (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id r from n union select reach.doc_id, sides.b from reach join sides on sides.a = reach.r)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(r, d.doc_id) component_id, coalesce(r, d.doc_id) = d.doc_id kept
from d left join n on n.doc_id = d.doc_id left join (select doc_id, min(r) r from reach group by doc_id) m on m.doc_id = d.doc_id
"""

SQL_MIXING = """
with recursive d as (select doc_id, source, lang, case when text like '%Licensed under%' then 'licence' when regexp_matches(coalesce(text, ''), '[0-9]@[a-z0-9]+\\.') then 'contact' when text like '% | %' then 'table' else 'prose' end topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
cells as (select source, lang, topic, sum(n_tokens)::double tokens from d group by all),
whole as (select sum(tokens) w from cells),
gs as (select source, sum(tokens) ** 0.7 g from cells group by 1 having sum(tokens) > 0), gl as (select lang, sum(tokens) ** 0.7 g from cells group by 1 having sum(tokens) > 0), gt as (select topic, sum(tokens) ** 0.7 g from cells group by 1 having sum(tokens) > 0),
goals as (select cells.*, w, coalesce(gs.g, 0) / (select sum(g) from gs) s_source, coalesce(gl.g, 0) / (select sum(g) from gl) s_lang, coalesce(gt.g, 0) / (select sum(g) from gt) s_topic
  from cells, whole left join gs on gs.source is not distinct from cells.source left join gl on gl.lang is not distinct from cells.lang left join gt on gt.topic is not distinct from cells.topic),
r as (select 0 k, source, lang, topic, tokens, w, s_source, s_lang, s_topic, tokens raked from goals
  union all
  select k + 1, source, lang, topic, tokens, w, s_source, s_lang, s_topic, coalesce(b * s_topic * w / nullif(sum(b) over (partition by topic), 0), 0) from (
    select *, coalesce(a * s_lang * w / nullif(sum(a) over (partition by lang), 0), 0) b from (
      select *, coalesce(raked * s_source * w / nullif(sum(raked) over (partition by source), 0), 0) a from r where k < 30))),
f as materialized (select source, lang, topic, tokens, raked, raked / tokens ratio from r where k = 30 and tokens > 0 and raked > 0),
o as (select *, sum(tokens) over (order by ratio desc) held, sum(raked) over (order by ratio) - raked_here rest, 0.8 * (select sum(tokens) from f) budget from (select *, sum(raked) over (partition by ratio) raked_here from f)),
s as (select coalesce(max((budget - held) / nullif(rest, 0)) filter (where (budget - held) / nullif(rest, 0) * ratio >= 1), (select 0.8 * sum(tokens) / sum(raked) from f)) scale from o),
rates as (select cells.source, cells.lang, cells.topic, case when cells.tokens = 0 then 1 else least(1, coalesce(ratio, 0) * scale) end p, case when cells.tokens = 0 then 1 when ratio > 0 then ratio * scale / least(1, ratio * scale) end weight
  from cells, s left join f on f.source is not distinct from cells.source and f.lang is not distinct from cells.lang and f.topic is not distinct from cells.topic)
select doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) probability, round(weight, 6) weight, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < p sampled
from d join rates on rates.source is not distinct from d.source and rates.lang is not distinct from d.lang and rates.topic is not distinct from d.topic
"""

_SQL_ROUND = """
d{r} as materialized (select v.i, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint distance from v, c{r} c),
a{r} as materialized (select i, x, arg_min(k, (distance, k)) k, min(distance) distance from d{r} group by i, x),
m{r} as (select k, j, sum(x[j])::hugeint s, count(*)::hugeint n from a{r}, (select unnest(range(1, 65)) j) group by k, j),
n{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by j) x from m{r} group by k),
c{next} as materialized (select c.k, coalesce(n.x, c.x) x from c{r} c left join n{r} n on n.k = c.k),"""

SQL_CENTROIDS = (
    """
with v as materialized (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), embedding) i, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as (select i - 1 k, x from v where i <= 16),"""
    + "".join(_SQL_ROUND.format(r=r, next=r + 1) for r in range(4))
    + """
w as (select k, sum(distance)::bigint cluster_inertia from a3 group by k)
select v.vec_id, a3.k::int as cluster, a3.distance, cluster_inertia, (select sum(distance)::bigint from a3) inertia, sha256(array_to_string(c3.x, ',')) centroid_sha256
from a3 join v on v.i = a3.i join w on w.k = a3.k join c3 on c3.k = a3.k
"""
)

#: For pages of one article each, without elements to be left out inside it, and with these references alone, as the tables have.
SQL_HTML = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) h from pages),
b as (select page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '<[^<>]*>', '', 'g') t from a),
c as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) text from b)
select page_id, url, text, length(text)::bigint n_chars from c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_chat_formatting, op3_language_id, op4_near_duplicates, op5_media, op6_line_dedup, op7_mixing, op8_warc, op9_decontamination, op10_quality, op11_centroid_clustering, op12_html_extraction, op13_embedding_whitening)
}

ORACLES: dict[str, str] = {"op1_url_filters": SQL_URL, "op4_near_duplicates": SQL_NEAR_DUPLICATES, "op7_mixing": SQL_MIXING, "op8_warc": SQL_WARC, "op9_decontamination": SQL_DECONTAMINATION, "op11_centroid_clustering": SQL_CENTROIDS, "op12_html_extraction": SQL_HTML}
