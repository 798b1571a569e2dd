"""Column functions on texts: normal forms, tokens, titles, keys, digests, signals of prompts and prose."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of what a prompt shows, and the least words of a prompt that is no shell.
PROMPT_SIGNALS = {
    "verification": r"(?i)테스트|검증|증명|기준|수용|통과|\btest(s|ed|ing)?\b|\bassert\b|\bexpect\b|\bverif|\bcriteri|\bpass(es|ing)?\b",
    "context": r"(?i)[\w-]+\.[a-z]{1,4}\b|`[^`]+`|#\d+|[\w-]+/[\w-]+|스펙|문서|ADR-\d+|경로",
    "stop": r"""(?i)까지만|멈춰|중단|지\s?(?:마(?:라|세요)?|말)([\s.,!?"']|$)|금지|않는다|\bonly\b|\bstop\b|\bdo not\b|\bdon't\b|범위""",
}
SHELL_WORDS = 8
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_SPACES = r"[\t\n\f\r ]+"
TITLE_LENGTH = 240
#: Bounds of a summary.
MIN_SUMMARY, MAX_SUMMARY, MAX_SENTENCES, VERBATIM_LINE = 40, 1500, 10, 24
#: Names of code in a statement (camel case, Pascal case of two humps, constants), requirement ids.
SYMBOL = r"\b(?:[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9][A-Za-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"
REQUIREMENT = r"\bREQ-[A-Z0-9]+(?:-[A-Z0-9]+)*\b"
#: Bullet, box and number before a title, and what ends a sentence.
DECORATION = r"^\s*(?:[-*+]\s*)?(?:\[[\sxX]?\]\s*)?(?:\d+[.)]\s*)?(?:[-*+]\s*)?"
ENDING = r"[.,;:!?\s]+$"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def search_text(text: Column, compose: bool = True) -> Column:
    """Composed, trimmed, in lower case, every run of white space one blank. Without ``compose`` all stays in the JVM: for texts known to be composed."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text) if compose else text), r"\s+", " "))


def query_tokens(query: str) -> list[str]:
    """The words of a query: letters and digits of any script, ``_`` and ``-``."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}_-]+", " ".join(unicodedata.normalize("NFKC", query).split()).lower()) if t]


def has_all(text: Column, tokens: list[str]) -> Column:
    """Whether the text holds every token somewhere."""
    out = F.lit(True)
    for t in tokens:
        out = out & F.contains(text, F.lit(t))
    return out


def task_tokens(text: Column) -> Column:
    """Distinct words of letters and digits with two characters at least, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))


def slug(name: Column, most: int = 120) -> Column:
    """Letters and digits of any script in lower case, all else one hyphen, none at the ends."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most)


def todo_title(title: Column) -> Column:
    """A title to compare by: no bullet, box, number or last punctuation, one blank for white space, lower case."""
    bare = F.regexp_replace(F.regexp_replace(title, DECORATION, ""), ENDING, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def clipped(title: Column, most: int = TITLE_LENGTH) -> Column:
    """The title, or its beginning and an ellipsis where it is longer."""
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.substring(title, 1, most - 1), F.lit("…")))


def todo_key(path: Column, title: Column, occurrence: Column) -> Column:
    """The key of a task that survives edits around it: path, digest of the title, number among equal titles from the second on."""
    digest = F.substring(F.sha2(F.lower(F.trim(F.regexp_replace(title, r"\s+", " "))), 256), 1, 16)
    return F.concat(F.lit("document:"), path, F.lit(":"), digest, F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise(""))


def symbol_key(path: Column, container: Column, kind: Column, name: Column) -> Column:
    """The key of a symbol: digest of path, container, kind and name."""
    return F.md5(F.concat_ws("|", path, F.coalesce(container, F.lit("")), kind, name))


def bare_name(written: Column) -> Column:
    """The last part of a name in SQL, without quotes, in lower case."""
    return F.lower(F.trim(F.replace(F.substring_index(written, ".", -1), F.lit('"'), F.lit(""))))


def ulid_of(seed: Column) -> Column:
    """26 characters of base 32 that the seed fixes: a zero, then the last 125 of the first 128 bits of its digest."""
    digest = F.sha2(seed, 256)
    bits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)])
    place = lambda k: F.conv(F.substring(bits, 4 + 5 * k, 5), 2, 10).cast("int")
    return F.concat(F.lit("0"), *[F.substring(F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), place(k) + 1, F.lit(1)) for k in range(25)])


def tokens_utf16(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 8).cast("long")


def tokens_bytes(n: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0), n) / 4).cast("long")


def pack_tokens(text: Column) -> Column:
    """As packs count: one at least."""
    return F.greatest(F.lit(1).cast("long"), tokens_utf16(text))


def symbols_in(statement: Column) -> Column:
    """Distinct names of code that a statement spells out, in their order."""
    return F.array_distinct(F.regexp_extract_all(statement, F.lit(SYMBOL), F.lit(0)))


def requirement_id(statement: Column) -> Column:
    """The first requirement id, null without one."""
    return F.nullif(F.regexp_extract(statement, REQUIREMENT, 0), F.lit(""))


def convention(text: Column) -> Column:
    """The convention for keys of API responses that an instruction states."""
    about = text.rlike("(?i)api responses?") & text.rlike("(?i)json keys?")
    return F.when(about & text.rlike("(?i)snake_case"), "snake_case").when(about & text.rlike("(?i)camelcase"), "camelCase")


def word_count(text: Column) -> Column:
    """Words between blanks, tabs and line breaks; blanks of any kind at the ends are no part of one."""
    return F.size(F.filter(F.split(F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", ""), _SPACES), lambda w: w != ""))


def as_in_sql(pattern: str) -> str:
    """A pattern without case as SQL reads it: word characters and boundaries are ASCII (Java takes ä for one at a boundary), white space has no vertical tab, ``$`` is the very end, long s and the kelvin sign are letters s and k."""

    def put(m: re.Match) -> str:
        part = m[0].replace(r"\w", "A-Za-z0-9_").replace(r"\s", r"\t\n\f\r ")
        if part[0] == "[":
            return "[\u017f\u212a" + part[1:] if "a-z" in part else part
        return {r"\b": _BOUNDARY, r"\t\n\f\r ": f"[{part}]", "$": r"\z", "s": "[s\u017f]", "k": "[k\u212a]"}.get(part, part)

    return re.sub(r"\[[^\]]*\]|\\.|[$sk]", put, pattern)


def prompt_signals(text: Column) -> dict[str, Column]:
    """What a prompt shows: verification, context, stop condition, words."""
    return {**{name: text.rlike(as_in_sql(p)) for name, p in PROMPT_SIGNALS.items()}, "words": word_count(text)}


def rubric_ceilings(text: Column) -> Column:
    """The most points on each axis that the prompt's own words allow."""
    s = prompt_signals(text)
    shell = s["words"] < SHELL_WORDS
    points = {"batch_size": F.when(shell, 1).otherwise(2), "context_grounding": F.when(s["context"], 2).otherwise(0), "no_over_instruction": F.lit(2), "specificity": F.when(shell, 0).otherwise(2), "stop_condition": F.when(s["stop"], 2).otherwise(0), "verifiability": F.when(s["verification"], 2).otherwise(0)}
    return F.struct(*[c.alias(n) for n, c in points.items()])


def grading_text(text: Column) -> Column:
    """As answers are compared: lower case, underscores and colons as blanks, one blank for white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[_:]", " "), r"\s+", " "))


def half_up(value: Column, places: int) -> Column:
    """Rounded as ``Math.round`` does: halves up, also below zero."""
    return F.floor(value * 10**places + 0.5) / 10**places


def git_blob_sha(content: Column) -> Column:
    """The id that git gives a file's bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def is_binary(content: Column, sniffed: int = 8192) -> Column:
    """Whether bytes are no text: a zero among the first ones, or no UTF-8."""
    head = F.substring(F.hex(content), 1, 2 * sniffed)
    return head.rlike("^(?:[0-9A-F]{2})*?00") | F.try_validate_utf8(content.cast("string")).isNull()


def skip_reason(mode: Column, size: Column, binary: Column, most: int = 1 << 20) -> Column:
    """Why a tree entry isn't read: submodule, symlink, oversized, binary; null if it is."""
    return F.when(mode == "160000", "submodule").when(mode == "120000", "symlink").when(size > most, "oversized").when(binary, "binary")


def retry_seconds(attempt: Column, delay: Column) -> Column:
    """Seconds until a job is tried again: two to the power of the attempt, or the delay up to an hour, whichever is more."""
    return F.greatest(F.pow(F.lit(2.0), attempt), F.least(delay.cast("double"), F.lit(3600.0)))


def prose_faults(prose: Column, source: Column, least: int = MIN_SUMMARY, most: int = MAX_SUMMARY, sentences: int = MAX_SENTENCES, verbatim: int = VERBATIM_LINE) -> Column:
    """What rules out a summary: too short, too long or too many sentences, a code fence, several lines, a long line of the source."""
    t = F.trim(F.coalesce(prose, F.lit("")))
    copied = F.exists(F.split(F.coalesce(source, F.lit("")), "\n"), lambda x: (F.length(F.trim(x)) >= verbatim) & F.contains(t, F.trim(x)))
    n = F.size(F.regexp_extract_all(t, F.lit(r"[^.!?]+[.!?]+(?:\s|$)"), F.lit(0)))
    faults = {"too-short": F.length(t) < least, "too-long": (F.length(t) > most) | (n > sentences), "fence": t.contains("```"), "lines": t.contains("\n"), "copied": copied}
    return F.array_compact(F.array(*[F.when(c, name) for name, c in faults.items()]))


def summary_state(summary: Column, summary_blob: Column, blob: Column) -> Column:
    """missing without a summary, unknown where either digest is missing, else current or stale."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(summary), "missing").when(blank(summary_blob) | blank(blob), "unknown").when(F.trim(summary_blob) == F.trim(blob), "current").otherwise("stale")


def member_digest(path: Column, blob: Column) -> Column:
    """An aggregate: digest of the members' paths and blobs in the order of paths."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path.alias("p"), blob.alias("b")))), lambda m: F.concat(m["p"], F.lit(":"), m["b"])), "\n"))
