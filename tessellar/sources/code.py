"""What source files state, line by line: imports, exports, calls, bases, schema objects, table literals, routes, rationale comments.

Readers go by patterns, not by a compiler, on texts that the lexer has freed of comments and of strings that look like
code; a statement that goes on in the next line is drawn together first, its line break moved behind it. Rows have
``path`` and ``line`` (from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.words import bare_name
from tessellar.sources.lexer import code_only, comments_only
from tessellar.sources.markdown import numbered

SCRIPT = r"\.[cm]?[jt]sx?$"
#: Patterns of statements.
IMPORT = r"""(?:^|[\n;])[ \t]*(import|export)\s+(?:type\s+)?((?:[\w$*][^'";\n]*?|[^'";]*?\{[^}]*\}[^'";]*?)\s+from\s+|)['"]([^'"\n]+)['"]"""
DYNAMIC = r"""\bimport\(\s*['"]([^'"\n]+)['"]\s*\)"""
EXPORT = r"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let|var)\*?\s+([A-Za-z_$][\w$]*)"
PY_CLASS = r"^class\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*:"
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)"
PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^()]*\)|[^\n;(]+)"
CREATE = r"(?i)^\s*create\s+(?:(table)\s+(?:if\s+not\s+exists\s+)?|(?:or\s+replace\s+)?(?:materialized\s+)?(view)\s+|(?:or\s+replace\s+)?(function)\s+)([\w.\"]+)"
ALTER = r"(?i)^\s*alter\s+table\s+(?:if\s+exists\s+)?([\w.\"]+)"
FOREIGN_KEY = r"(?i)\breferences\s+([\w.\"]+)\s*\("
TABLE_LITERALS = (r"""\.from\(\s*['"`]([\w.]+)['"`]""", r"""\.rpc\(\s*['"`]([\w.]+)['"`]""", r"""__tablename__\s*=\s*['"]([\w.]+)['"]""", r"""\bTable\(\s*['"]([\w.]+)['"]""", r"\bprisma\.(\w+)\s*\.")
DECORATOR = r"""^\s*@\s*[\w.]+\.(delete|get|head|options|patch|post|put|route)\s*\(\s*(?:path\s*=\s*)?['"]([^'"\n]{1,400})['"]"""
METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
COMMENT = r"^\s*(?://|#|\*|/\*|--)\s*(.+?)\s*(?:\*/)?\s*$"
REASON = r"^\s*(?://|#|\*|/\*|--)\s*(WHY|NOTE):\s*(.+?)\s*(?:\*/)?\s*$"

#: Statements that go on in the next line: what stands before the break, and what goes on.
_WRAPPED = {
    "script": ((r"(\b(?:class|interface)[ \t]+[\w$]+[^\n{};]*?)", r"(?:extends|implements)\b[^\n]*"), (r"(\bexport)", r"(?:default|async|function|class|const)\b[^\n]*")),
    "tables": ((r"((?:\.from|\.rpc|\bTable)\()", r"[^\n]+"),),
    "python": ((r"(?m)(^[ \t]*@[\w. \t]+\([^()\n]*)", r"[^\n]+"), (r"(?m)(^class[ \t]+\w+[ \t]*\([^()\n]*)", r"[^\n]+")),
    "sql": ((r"(?im)(^[ \t]*(?:create|alter)\b[^\n(;]*?\b(?:create|replace|alter|table|view|function|exists|materialized|only))", r"[^\n]+"), (r"(?i)(\breferences)", r"[^\n]+"), (r"(?i)(\breferences[ \t]+[\w.\"]+)", r"\([^\n]*")),
}
_ROUNDS = 4


def _drawn(files: DataFrame, kind: str) -> DataFrame:
    """The code of files, statements drawn to the line where they begin (each may go on over four lines more)."""
    out = code_only(files)
    for before, after in _WRAPPED[kind]:
        pattern, text = rf"{before}[ \t]*((?:\n[ \t]*)+)({after})", F.col("text")
        for _ in range(_ROUNDS):
            text = F.regexp_replace(text, pattern, "$1 $3$2")
        out = out.withColumn("text", F.when(F.col("text").rlike(pattern), text).otherwise(F.col("text")))  # most texts have none
    return out


def _bare(c: Column) -> Column:
    """Without white space at either end, line breaks too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _scripts(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").rlike(SCRIPT))


def _pythons(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").endswith(".py"))


def script_imports(files: DataFrame) -> DataFrame:
    """(path, n, specifier, is_re_export, names, bindings) of import and export statements with a source, and of dynamic imports.

    ``names`` are those asked of the source, ``default`` and ``*`` included; ``bindings`` pairs a local name with the one
    it stands for (null for a whole module); of re-exports, the name given on with the one it has in the source.
    """
    own = code_only(_scripts(files))
    found = own.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(0))).alias("n", "s"))
    clause = F.regexp_extract("s", IMPORT, 2)
    rows = found.select("path", "n", F.regexp_extract("s", IMPORT, 3).alias("specifier"), (F.col("s").contains("export") & (F.regexp_extract("s", IMPORT, 1) == "export")).alias("is_re_export"), _bare(F.regexp_replace(clause, r"\s+from\s+$", "")).alias("clause"))
    rows = rows.where(~F.col("is_re_export") | (F.col("clause") != ""))
    listed = F.filter(F.transform(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(_bare(x), r"^type\s+", "")), lambda x: x != "")
    pair = lambda x: F.struct(F.regexp_extract(x, r"([\w$]+)\s*$", 1).alias("local"), F.regexp_extract(x, r"^([\w$]+)", 1).alias("symbol"))
    named = F.transform(listed, pair)
    none = F.array().cast("array<struct<local:string,symbol:string>>")
    star = F.when(F.col("clause").rlike(r"\*\s+as\s+[\w$]+"), F.array(F.struct(F.regexp_extract("clause", r"\*\s+as\s+([\w$]+)", 1).alias("local"), F.lit(None).cast("string").alias("symbol")))).otherwise(none)
    default = F.when(~F.col("is_re_export") & F.col("clause").rlike(r"^[A-Za-z_$][\w$]*"), F.array(F.struct(F.regexp_extract("clause", r"^([A-Za-z_$][\w$]*)", 1).alias("local"), F.lit("default").alias("symbol")))).otherwise(none)
    rows = rows.withColumn("bindings", F.concat(default, star, named))
    asked = F.transform("bindings", lambda b: F.coalesce(b["symbol"], F.lit("*")))
    rows = rows.select("path", "n", "specifier", "is_re_export", F.when(F.col("is_re_export") & (F.size("bindings") == 0), F.array(F.lit("*"))).otherwise(asked).alias("names"), "bindings")
    lazy = own.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(DYNAMIC), F.lit(1))).alias("n", "specifier"))
    lazy = lazy.select("path", (F.col("n") + 1_000_000).alias("n"), "specifier", F.lit(False).alias("is_re_export"), F.array(F.lit("*")).alias("names"), none.alias("bindings"))
    return rows.unionByName(lazy)


def python_imports(files: DataFrame) -> DataFrame:
    """(path, n, specifier, names) of Python's imports, braced lists over lines included."""
    own = code_only(_pythons(files))
    plain = own.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(PY_IMPORT), F.lit(1))).alias("n", "s")).select("path", "n", F.explode(F.split("s", ",")).alias("s"))
    plain = plain.select("path", "n", F.regexp_extract(F.trim("s"), r"^([\w.]+)", 1).alias("specifier"), F.array(F.lit("*")).alias("names"))
    named = own.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(PY_FROM), F.lit(0))).alias("n", "s"))
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract("s", PY_FROM, 2), "[()]", ""), ","), lambda x: F.regexp_extract(_bare(x), r"^(\S+)", 1)), lambda x: x.rlike(r"^[\w*]+$"))
    return plain.unionByName(named.select("path", F.col("n") + 1_000_000, F.regexp_extract("s", PY_FROM, 1).alias("specifier"), listed.alias("names")).toDF("path", "n", "specifier", "names"))


def exported_symbols(files: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(path, line, kind, name): what scripts export, what Python defines at the left margin without a leading underscore, what Go names with a capital; of names given on (by imports that are read already, if there are), kind export."""
    rows = numbered(_drawn(files, "script"), "path", "text").withColumnRenamed("doc_id", "path")
    lower = F.lower("path")
    kinds = F.when(F.regexp_extract("text", EXPORT, 1).isin("const", "let", "var"), "variable").otherwise(F.regexp_extract("text", EXPORT, 1))
    script = rows.where(lower.rlike(SCRIPT) & F.col("text").contains("export") & F.col("text").rlike(EXPORT)).select("path", "line", kinds.alias("kind"), F.regexp_extract("text", EXPORT, 2).alias("name"))
    define = r"^(?:async\s+)?(def|class)\s+([A-Za-z]\w*)"
    python = rows.where(lower.endswith(".py") & F.col("text").rlike(define)).select("path", "line", F.when(F.regexp_extract("text", define, 1) == "def", "function").otherwise("class").alias("kind"), F.regexp_extract("text", define, 2).alias("name"))
    go_define = r"^(func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Z]\w*)"
    go = rows.where(lower.endswith(".go") & F.col("text").rlike(go_define)).select("path", "line", F.when(F.regexp_extract("text", go_define, 1) == "func", "function").otherwise(F.regexp_extract("text", go_define, 1)).alias("kind"), F.regexp_extract("text", go_define, 2).alias("name"))
    again = (script_imports(files) if given is None else given).where("is_re_export").select("path", F.explode("bindings").alias("b")).where("b.symbol is not null")
    again = again.select("path", F.lit(0).alias("line"), F.lit("export").alias("kind"), F.col("b.local").alias("name"))
    return script.unionByName(python).unionByName(go).unionByName(again)


def heritage(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, binding, member): bases of exported classes and interfaces of scripts, and of Python's public classes."""
    named = lambda df: numbered(df, "path", "text").withColumnRenamed("doc_id", "path")
    deriving = F.col("text").contains("extends") | F.col("text").contains("implements")  # no row comes of a text without
    scripts, pythons = named(_drawn(_scripts(files).where(deriving), "script")), named(_drawn(_pythons(files), "python"))
    script = r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?(class|interface)\s+([A-Za-z_$][\w$]*)(?:<[^>]*>)?\s+(.*?)\{?\s*$"
    bases = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\b(?:extends|implements)\s+([\w$.,\s<>]+?)(?=\bimplements\b|\{|$)"), F.lit(1)), lambda x: F.split(F.regexp_replace(x, "<[^>]*>", ""), ",")))
    ts = scripts.where(F.col("text").rlike(script)).select("path", "line", F.regexp_extract("text", script, 1).alias("kind"), F.regexp_extract("text", script, 2).alias("name"), F.explode(bases).alias("base"))
    py = pythons.where(F.col("text").rlike(PY_CLASS)).select("path", "line", F.lit("class").alias("kind"), F.regexp_extract("text", PY_CLASS, 1).alias("name"), F.explode(F.split(F.regexp_extract("text", PY_CLASS, 2), ",")).alias("base"))
    py = py.where("name not like '\\_%'").withColumn("base", F.regexp_replace(F.trim("base"), r"\[.*$", "")).where("base <> 'object' and not contains(base, '=')")
    both = ts.unionByName(py).withColumn("base", F.trim("base")).where(F.col("base").rlike(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?$"))
    parts = F.split("base", r"\.")
    return both.select("path", "line", "kind", "name", parts[0].alias("binding"), F.try_element_at(parts, F.lit(2)).alias("member"))


def calls(files: DataFrame) -> DataFrame:
    """(path, binding, member): distinct names that scripts call, alone or as a member; declarations and key words are no calls."""
    own = code_only(_scripts(files))
    call = r"(?<![\w$.])([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?\s*\("
    text = F.regexp_replace("text", r"\b(?:function|class)\s*\*?\s*[A-Za-z_$][\w$]*\s*\(", " ")
    rows = own.select("path", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(call), F.lit(0)))).alias("s"))
    rows = rows.select("path", F.regexp_extract("s", call, 1).alias("binding"), F.nullif(F.regexp_extract("s", call, 2), F.lit("")).alias("member"))
    return rows.where(~F.col("binding").isin("if", "for", "while", "switch", "catch", "return", "function", "import", "typeof", "await", "new", "super")).distinct()


def local_names(files: DataFrame) -> DataFrame:
    """(path, name): what scripts declare at their top level."""
    rows = numbered(code_only(_scripts(files)), "path", "text").withColumnRenamed("doc_id", "path")
    pattern = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\*?\s+([A-Za-z_$][\w$]*)"
    return rows.where(F.col("text").rlike(pattern)).select("path", F.regexp_extract("text", pattern, 1).alias("name")).distinct()


def rationales(files: DataFrame, most: int = 240) -> DataFrame:
    """(path, line, kind, text, adr): comments marked as a reason or a note, and those that name a decision, cut to so many characters."""
    rows = numbered(comments_only(files), "path", "text").withColumnRenamed("doc_id", "path").where(F.col("text").rlike(COMMENT))
    marked = F.col("text").rlike(REASON)
    body = F.when(marked, F.regexp_extract("text", REASON, 2)).otherwise(F.regexp_extract("text", COMMENT, 1))
    adr = F.nullif(F.regexp_extract(body, r"\bADR-\d{1,4}\b", 0), F.lit(""))
    kind = F.when(marked, F.lower(F.regexp_extract("text", REASON, 1))).otherwise("adr-reference")
    return rows.select("path", "line", kind.alias("kind"), F.substring(body, 1, most).alias("text"), adr.alias("adr")).where((F.col("kind") != "adr-reference") | F.col("adr").isNotNull())


def schema_statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (path, line, kind, name), the first statement of each name in a file; and links (path, line, kind, source, target): defines, modifies, references from the object in hand."""
    rows = numbered(_drawn(files.where(F.lower("path").endswith(".sql")), "sql"), "path", "text").withColumnRenamed("doc_id", "path")
    made, altered = F.regexp_extract("text", CREATE, 4), F.regexp_extract("text", ALTER, 1)
    kind = F.coalesce(*[F.nullif(F.lower(F.regexp_extract("text", CREATE, k)), F.lit("")) for k in (1, 2, 3)])
    rows = rows.withColumn("kind", kind).withColumn("made", F.when(made != "", bare_name(made))).withColumn("altered", F.when((made == "") & (altered != ""), bare_name(altered)))
    so_far = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("current", F.last(F.coalesce("made", "altered"), ignorenulls=True).over(so_far))
    objects = rows.where("made is not null").groupBy("path", F.col("made").alias("name")).agg(F.min(F.struct("line", "kind")).alias("r")).select("path", "r.line", "r.kind", "name")
    none = F.lit(None).cast("string").alias("source")
    links = rows.where("made is not null").select("path", "line", F.lit("defines").alias("kind"), none, F.col("made").alias("target"))
    links = links.unionByName(rows.where("altered is not null").select("path", "line", F.lit("modifies").alias("kind"), none, F.col("altered").alias("target")))
    keys = rows.where("current is not null").select("path", "line", F.lit("references").alias("kind"), F.col("current").alias("source"), F.explode(F.transform(F.regexp_extract_all("text", F.lit(FOREIGN_KEY), F.lit(1)), bare_name)).alias("target"))
    return objects, links.unionByName(keys.where("source <> target"))


def table_literals(files: DataFrame) -> DataFrame:
    """(path, line, name): table names in query calls and models, each once a line."""
    rows = numbered(_drawn(files, "tables"), "path", "text").withColumnRenamed("doc_id", "path")
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in TABLE_LITERALS])
    return rows.select("path", "line", F.explode(F.array_distinct(F.transform(found, bare_name))).alias("name"))


def python_routes(files: DataFrame) -> DataFrame:
    """(path, line, method, url) of route decorators; a bare route without methods takes any."""
    rows = numbered(_drawn(_pythons(files), "python"), "path", "text").withColumnRenamed("doc_id", "path").where(F.col("text").rlike(DECORATOR))
    listed = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("text", r"(?i)methods\s*=\s*\[([^\]]{0,200})\]", 1), F.lit("['\"]([A-Za-z]+)['\"]"), F.lit(1)), F.upper), lambda m: m.isin(*METHODS))
    verb = F.regexp_extract("text", DECORATOR, 1)
    methods = F.when(verb != "route", F.array(F.upper(verb))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("ANY")))
    return rows.select("path", "line", F.trim(F.regexp_extract("text", DECORATOR, 2)).alias("url"), F.explode(methods).alias("method")).where("url like '/%'")
