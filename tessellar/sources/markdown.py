"""What Markdown texts hold, line by line: headings and their sections, tasks, links, inline code, paragraphs, statements, citations.

One automaton runs over the lines of each text (``marked``, Arrow batches in tasks): it knows front matter, fences with their mark and length, inside
quotes and items too, HTML blocks and comments, headings of both forms, rules and the blocks between. Its rows have all that
the readers need, so these filter rows and look at few of them together; no line is shuffled to be numbered or counted.

Every reader takes rows with an id and a text, or the table that ``marked`` made of them once, and returns rows with
``doc_id`` and ``line`` (from 1). In fences, HTML and front matter there are no headings, tasks, links or statements. A null
text has no lines. A heading that is underlined has one line of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.words import REQUIREMENT, clipped, todo_key

#: A task item and the status that each mark stands for.
TASK = r"^(\s*)[-*+][ \t]+\[([ xX/~-])\][ \t]+(\S.*)$"
STATUS = {" ": "open", "-": "blocked", "/": "in-progress", "~": "in-progress", "x": "done"}
#: Headings of acceptance sections and of a decision's sections; prefixes of section tokens; most citations of a document.
ACCEPTANCE = ("acceptance", "acceptance criteria", "수용 기준")
DECISION = ("decision", "결정")
PREFIXES = ("ADR", "G", "MT", "OQ")
MOST_CITED = 200
DEPTHS = 10


#: HTML elements whose block ends at a blank line.
HTML_BLOCKS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
FENCE = r"^\s*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)*(`{3,}|~{3,})(.*)$"
ITEM = r"^\s*(?:[-*+]|\d+[.)])[ \t]+"
HEADING = r"^ {0,3}(#{1,6})[ \t]+(?=\S)"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
_NORMAL, _FENCE, _HTML, _FRONT, _COMMENT, _RAW = range(6)


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, text): the lines without their breaks."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    return raw.select("doc_id", (F.col("line") + 1).alias("line"), F.when(F.col("raw").contains("\r"), F.regexp_replace("raw", "\r$", "")).otherwise(F.col("raw")).alias("text"))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, text, start_byte, end_byte): bytes from the text's start, half open, line breaks left out."""
    return marked(docs, doc_id, text).select("doc_id", "line", "text", "start_byte", "end_byte")


#: Lines that one batch of ``marked`` brings at most, besides those of its last text.
BATCH_LINES = 20_000
MARKED = "line int, text string, start_byte long, end_byte long, kind string, fenced boolean, next_text string, block int, item boolean, end_of_block boolean, last int"
_QUOTE = re.compile(r"(?: {0,3}> ?)+")
_FENCE_RE, _ITEM_RE, _HEADING_RE, _UNDERLINE_RE, _RULE_RE = (re.compile(p) for p in (FENCE, ITEM, HEADING, UNDERLINE, RULE))
_RAW_START, _RAW_END = re.compile(r"(?i) {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)"), re.compile(r"(?i)</(?:script|pre|style|textarea)>")
_HTML_START, _COMMENT_START = re.compile(rf"(?i) {{0,3}}</?(?:{HTML_BLOCKS})(?:[\s/>]|$)"), re.compile(r" {0,3}<!--")
_FRONT_END = re.compile(r"(?:---|\.\.\.)\s*$")


def _kinds(texts: list[str]) -> list[str]:
    """What each line of a text is: one pass, the mode of a line is that which the line before left."""
    out: list[str] = []
    front = bool(texts) and re.match(r"---\s*$", texts[0]) is not None and any(_FRONT_END.match(t) for t in texts[1:])
    mode, mark = (_FRONT if front else _NORMAL), ""
    for k, text in enumerate(texts):
        bare = text[_QUOTE.match(text).end() :] if text.lstrip(" ").startswith(">") else text
        first = bare.strip()[:1]
        if mode == _FRONT:
            out.append("front")
            mode = _NORMAL if k and _FRONT_END.match(text) else _FRONT
        elif mode == _FENCE:
            out.append("fence")
            closing = first and first == mark[0] and _FENCE_RE.match(bare)
            if closing and not closing[2].strip() and bare.lstrip()[0] in "`~" and len(closing[1]) >= len(mark):
                mode = _NORMAL
        elif mode == _HTML:
            out.append("html" if first else "blank")
            mode = _HTML if first else _NORMAL
        elif mode == _COMMENT:
            out.append("html")
            mode = _NORMAL if "-->" in text else _COMMENT
        elif mode == _RAW:
            out.append("html")
            mode = _NORMAL if _RAW_END.search(text) else _RAW
        elif not first:
            out.append("blank")
        elif ("```" in bare or "~~~" in bare) and (opening := _FENCE_RE.match(bare)) and not (opening[1][0] == "`" and "`" in opening[2]):
            out.append("fence")
            mode, mark = _FENCE, opening[1]
        elif first == "<" and _COMMENT_START.match(bare):
            out.append("html")
            mode = _NORMAL if "-->" in text else _COMMENT
        elif first == "<" and _RAW_START.match(bare):
            out.append("html")
            mode = _NORMAL if _RAW_END.search(text) else _RAW
        elif first == "<" and _HTML_START.match(bare):
            out.append("html")
            mode = _HTML
        elif first == "#" and _HEADING_RE.match(text):
            out.append("heading")
        elif first in "=-" and out and out[-1] == "setext" and _UNDERLINE_RE.match(text):
            out.append("under")
        elif first in "*-_" and _RULE_RE.match(text):
            out.append("rule")
        elif bare is text and k + 1 < len(texts) and texts[k + 1].strip()[:1] in ("=", "-") and _UNDERLINE_RE.match(texts[k + 1]) and not _ITEM_RE.match(text):
            out.append("setext")
        else:
            out.append("text")
    return out


def _mark():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(11)]
        ids: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], names=["doc_id", *(x.split()[0] for x in MARKED.split(", "))])
            ids.clear()
            for c in columns:
                c.clear()
            return batch

        for batch in batches:
            for d in range(batch.num_rows):
                whole = batch.column("text")[d].as_py()
                if whole is None:
                    continue
                raw = whole.split("\n")
                texts = [t[:-1] if t.endswith("\r") else t for t in raw]
                kinds = _kinds(texts)
                items = [k == "text" and t.lstrip()[:1] in "-*+0123456789" and _ITEM_RE.match(t) is not None for t, k in zip(texts, kinds, strict=True)]
                fresh = [kinds[k] != "text" or items[k] or not k or kinds[k - 1] != "text" for k in range(len(texts))]
                sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in raw), np.int64, len(raw))
                starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
                ends = starts + sizes - np.fromiter((len(r) != len(t) for r, t in zip(raw, texts, strict=True)), np.int64, len(raw))
                block = np.cumsum(fresh)
                held = (range(1, len(raw) + 1), texts, starts.tolist(), ends.tolist(), kinds, [k in ("fence", "html", "front") for k in kinds], [*texts[1:], None], block.tolist(), items, [*fresh[1:], True], [len(raw)] * len(raw))
                for c, values in zip(columns, held, strict=True):
                    c.extend(values)
                ids.append(batch.column("doc_id").take(pa.array([d] * len(raw))))
                if len(columns[0]) >= BATCH_LINES:
                    yield out()
        if columns[0]:
            yield out()

    return run


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, text, start_byte, end_byte, kind, fenced, next_text, block, item, end_of_block, last) of every line; a table that is one already stays.

    kind: text, blank, heading, setext (a heading by the line below), under (that line), rule, fence, html, front; fenced:
    one of the last three. block: number of the paragraph or item that the line is of, item where one begins; last: the
    document's last line. Texts go through tasks where they are read; nothing is shuffled.
    """
    if "end_of_block" in docs.columns:
        return docs
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(_mark(), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MARKED}")


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, depth, title, last_line) of every heading; a section ends before the next heading as deep or less."""
    rows = marked(docs, doc_id, text).where("kind in ('heading', 'setext')")
    under = F.col("kind") == "setext"
    depth = F.when(under, F.when(F.col("next_text").rlike("^ *="), 1).otherwise(2)).otherwise(F.length(F.regexp_extract("text", HEADING, 1)))
    title = F.when(under, F.col("text")).otherwise(F.regexp_replace(F.regexp_replace("text", HEADING, ""), r"(?:^|[ \t]+)#+[ \t]*$", ""))
    heads = rows.select("doc_id", "line", depth.alias("depth"), F.trim(title).alias("title"), "last")
    # from the last heading upwards, the nearest below is the least line so far
    below = W.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)
    nearest = F.array(*[F.min(F.when(F.col("depth") <= d, F.col("line"))).over(below) for d in range(1, 7)])
    closing = F.element_at(nearest, F.col("depth"))
    return heads.select("doc_id", "line", "depth", "title", F.coalesce(closing - 1, F.col("last")).alias("last_line"))


def section_texts(docs: DataFrame, titles: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, last_line, start_byte, end_byte, text) of sections with these titles: the text is what isn't blank below the heading."""
    docs = marked(docs, doc_id, text)
    heads = sections(docs).where(F.lower(F.trim("title")).isin(*titles)).select("doc_id", F.col("line").alias("head"), "last_line")
    held = docs.select("doc_id", "line", "text", "start_byte", "end_byte", "kind").join(heads, "doc_id").where((F.col("line") >= F.col("head")) & (F.col("line") <= F.col("last_line")))
    shown = (F.col("line") > F.col("head")) & (F.trim("text") != "") & (F.col("kind") != "under")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    last = F.max(F.when(shown | (F.col("line") == F.col("head")), F.col("line")))
    out = held.groupBy("doc_id", "head").agg(last.alias("last_line"), F.min("start_byte").alias("start_byte"), F.max(F.when(shown | (F.col("line") == F.col("head")), F.col("end_byte"))).alias("end_byte"), joined.alias("text"))
    return out.withColumnRenamed("head", "line")


def todo_status(mark: Column) -> Column:
    """Status of a task item's mark."""
    out = F.when(F.lit(False), "")
    for m, status in STATUS.items():
        out = out.when(F.lower(mark) == m, status)
    return out


def todos(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, indent, status, title, statement, occurrence, source_key, parent_key) of task items.

    Equal titles of a document (white space and case aside) are numbered in their order, the whole title counts; the title
    shown is cut to 240 characters. The parent is the nearest item before that is indented less, of up to ten levels.
    """
    rows = marked(docs, doc_id, text).where(~F.col("fenced") & F.col("text").rlike(TASK))
    whole = F.trim(F.regexp_extract("text", TASK, 3))
    same = F.lower(F.regexp_replace(whole, r"\s+", " "))
    rows = rows.select("doc_id", "line", "start_byte", "end_byte", F.length(F.replace(F.regexp_extract("text", TASK, 1), F.lit("\t"), F.lit("    "))).alias("indent"), todo_status(F.regexp_extract("text", TASK, 2)).alias("status"), whole.alias("statement"), same.alias("_same"))
    rows = rows.withColumn("occurrence", F.row_number().over(W.partitionBy("doc_id", "_same").orderBy("line")))
    rows = rows.withColumn("source_key", todo_key(F.col("doc_id").cast("string"), F.col("statement"), F.col("occurrence")))
    depth = F.least(F.ceil(F.col("indent") / 2), F.lit(DEPTHS)).cast("int")
    before = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_depth", depth)
    shallower = F.array(*[F.last(F.when(F.col("_depth") < d, F.col("source_key")), ignorenulls=True).over(before) for d in range(1, DEPTHS + 1)])
    parent = F.when(F.col("_depth") > 0, F.try_element_at(shallower, F.col("_depth")))
    return rows.select("doc_id", "line", "start_byte", "end_byte", "indent", "status", clipped(F.col("statement")).alias("title"), "statement", "occurrence", "source_key", parent.alias("parent_key"))


def code_references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, value) of inline code."""
    rows = marked(docs, doc_id, text).where(~F.col("fenced"))
    return rows.select("doc_id", "line", "start_byte", "end_byte", F.explode(F.regexp_extract_all("text", F.lit("(?<!`)`([^`\n]+)`(?!`)"), F.lit(1))).alias("value"))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, target) of Markdown links and wiki links; titles and aliases are left out."""
    rows = marked(docs, doc_id, text).where(~F.col("fenced"))
    inline = F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]\n]*\]\(<?([^)\s>]+)>?[^)\n]*\)"), F.lit(1))
    wiki = F.transform(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1)), F.trim)
    return rows.select("doc_id", "line", F.explode(F.concat(inline, wiki)).alias("target"))


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block, line, text, start_byte, end_byte, end_of_block, item): lines of paragraphs and list items, item where one begins; a blank line, a heading or the next item ends a block."""
    rows = marked(docs, doc_id, text).where("kind = 'text'")
    return rows.select("doc_id", "block", "line", "text", "start_byte", "end_byte", "end_of_block", "item")


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, last_line, start_byte, end_byte, text): runs of lines that are neither blank nor headings, bullets left out."""
    bare = F.regexp_replace("text", r"^\s*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX/~-]\][ \t]+)?", "")
    rows = blocks(docs, doc_id, text).withColumn("bare", bare)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "bare"))), lambda x: x["bare"]), "\n")
    return rows.groupBy("doc_id", "block").agg(F.min("line").alias("line"), F.max("line").alias("last_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), joined.alias("text")).drop("block")


def statements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, n, keyword, text): sentences with MUST or SHOULD; each ends with its mark or with its paragraph."""
    bare = F.regexp_replace("text", r"^\s*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX/~-]\][ \t]+)?", "")
    ended = F.regexp_extract_all(bare, F.lit(r"[^.!?\n]*\b(?:MUST|SHOULD)\b[^.!?\n]*[.!?]+"), F.lit(0))
    open_ = F.regexp_extract_all(bare, F.lit(r"[^.!?\n]*\b(?:MUST|SHOULD)\b[^.!?\n]*(?:[.!?]+|$)"), F.lit(0))
    rows = blocks(docs, doc_id, text).select("doc_id", "line", "start_byte", "end_byte", F.posexplode(F.when(F.col("end_of_block"), open_).otherwise(ended)).alias("n", "s"))
    return rows.select("doc_id", "line", "n", "start_byte", "end_byte", F.regexp_extract("s", r"\b(MUST|SHOULD)\b", 1).alias("keyword"), F.trim("s").alias("text"))


def token_pattern(prefixes: Sequence[str] = ()) -> str:
    """A pattern for section tokens; own prefixes of one to eight capitals and digits add to the known ones."""
    own = [p.strip().upper() for p in prefixes]
    known = dict.fromkeys([*PREFIXES, *(p for p in own if p.isalnum() and p.isascii() and p[:1].isalpha() and len(p) <= 8)])
    return r"\b(?:" + "|".join(sorted(known, key=lambda p: (-len(p), p))) + r")-?\d{1,4}\b"


def declared_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefixes: Sequence[str] = ()) -> DataFrame:
    """(doc_id, token, line, heading, home_rank): headings that open with a token, the first of each token in a document.

    The rank of a home is its heading's depth, and a hundred more where no title follows the token.
    """
    pattern = token_pattern(prefixes)
    heads = sections(docs, doc_id, text).withColumn("token", F.upper(F.regexp_extract("title", f"^({pattern[2:]})(?=\\s|$)", 1))).where("token <> ''")
    rest = F.substring(F.col("title"), F.length("token") + 1, F.length("title"))
    rank = F.when(rest.rlike(r"^\s*(?:[—–:-]|$)"), 0).otherwise(100) + F.least("depth", F.lit(9))
    row = F.struct("line", F.substring("title", 1, 200).alias("heading"), rank.alias("home_rank"))
    return heads.groupBy("doc_id", "token").agg(F.min(row).alias("r")).select("doc_id", "token", "r.*")


def cited_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefixes: Sequence[str] = (), most: int = MOST_CITED) -> DataFrame:
    """(doc_id, token, line): the first line that names each token, for the first so many tokens of a document (a stated limit of the operator)."""
    found = marked(docs, doc_id, text).select("doc_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(token_pattern(prefixes)), F.lit(0))).alias("n", "token"))
    first = found.groupBy("doc_id", F.upper("token").alias("token")).agg(F.min(F.struct("line", "n")).alias("at"))
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("at")))
    return ranked.where(F.col("_k") <= most).select("doc_id", "token", F.col("at.line").alias("line"))


def requirement_ids(text: Column) -> Column:
    """Distinct requirement ids of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REQUIREMENT), F.lit(0))))
