"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter.

Every listed canonical URL sets four bits of one 64-bit block; a page whose bits are all set in its block is a
possible hit and goes to an exact join with the list, which removes the false positives. All other pages skip the
join. The filter has at most ``max_blocks`` rows of 16 bytes, so its broadcast is bounded whatever the list's
length; past that bound it only lets more pages through to the exact join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import ascii_lower

MAX_RULES = 1000
BITS_PER_URL = 12
#: Query parameters that do not change what a URL names.
TRACKING = "utm_[^&]*|ref|fbclid|gclid"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host followed by the start of a path, like ``example.com/de/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, other query parameters sorted; null and schemeless: null."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(
            F.regexp_replace(url_host(url), r"^www\.", ""),
            F.regexp_replace(url_path(url), "/$", ""),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")),
        ),
    )


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (ties: the first in text order), or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; list the URLs instead")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """Four bits of a 64-bit word, taken from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter as rows (block, mask); blocks with no key are absent."""
    c = F.col(column)
    return keys.select(_block(c, blocks).alias("_block"), _bits(c).alias("_set")).groupBy("_block").agg(F.bit_or("_set").alias("_mask"))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url", listed_url: str = "url", max_blocks: int = 1 << 20
) -> DataFrame:
    """Adds host, path, canonical_url, rule, listed and verdict to every row.

    verdict is the longest fitting rule's, else ``block`` if the canonical URL is listed, else ``allow``. Columns of
    these names that the input has are replaced; its other columns stay. A null url and one without ``://`` have empty host and
    path, fit no rule, are never listed and so are allowed. Repeated rows are judged one by one. An empty list lists nothing.
    """
    added = ["host", "path", "canonical_url", "rule", "listed", "verdict"]
    keep = [c for c in pages.columns if c not in added or c == url]
    names = listed.select(canonical_url(F.col(listed_url)).alias("_key")).where("_key is not null").distinct()
    n, blocks = names.count(), 64
    while blocks * 64 < n * BITS_PER_URL and blocks < max_blocks:
        blocks *= 2
    u = F.col(f"`{url}`")
    host, path = url_host(u), url_path(u)
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), host.alias("_host"), path.alias("_path"), canonical_url(u).alias("_key"))
    keyed = keyed.withColumn("_block", _block(F.col("_key"), blocks))
    seen = keyed.join(F.broadcast(bloom_blocks(names, "_key", blocks)), "_block", "left")  # at most max_blocks rows
    bits = _bits(F.col("_key"))
    possible = F.coalesce(F.col("_mask").bitwiseAND(bits) == bits, F.lit(False))
    exact = seen.where(possible).join(names.withColumn("_listed", F.lit(True)), "_key", "left")
    rest = seen.where(~possible).withColumn("_listed", F.lit(False))
    out = exact.select("_row", "_host", "_path", "_key", "_listed").unionByName(rest.select("_row", "_host", "_path", "_key", "_listed"))
    rule, verdict = match_rule(F.col("_host"), F.col("_path"), rules)
    is_listed = F.coalesce("_listed", F.lit(False))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in keep if c not in added],
        *([F.col("_row").getField(url).alias(url)] if url in added else []),
        *[
            c
            for name, c in (
                ("host", F.col("_host").alias("host")),
                ("path", F.col("_path").alias("path")),
                ("canonical_url", F.col("_key").alias("canonical_url")),
                ("rule", rule.alias("rule")),
                ("listed", is_listed.alias("listed")),
                ("verdict", F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict")),
            )
            if name != url
        ],
    )
