"""Source texts without what only looks like code: comments and strings told from statements before patterns are tried.

A text is cut into tokens by one pattern a language, from left to right: comments, strings with their escapes, templates with
nested expressions, dollar quotes, regular expressions, and what stands between. Tokens keep their line breaks, so a line is
the same line afterwards. All of it are functions of Spark; the patterns repeat without going back, so long texts are no risk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT, PYTHON, SQL, GO = "script", "python", "sql", "go"
#: Endings of each language.
ENDINGS = {SCRIPT: r"\.[cm]?[jt]sx?$", PYTHON: r"\.py$", SQL: r"\.sql$", GO: r"\.go$"}

_LINE, _BLOCK = r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*+(?:"|(?=\n)|\z)', r"'(?:[^'\\\n]|\\[\s\S])*+(?:'|(?=\n)|\z)"
_REGEX = r"(?<=[=(,:\[!&|?{};\n][ \t]{0,4}|\breturn[ \t]{1,4})/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"


def _template(depth: int) -> str:
    """A template with expressions, whose braces and templates nest so deep."""
    inner = rf"(?:[^{{}}`\"'/]|{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|/" + (rf"|{_template(depth - 1)}|\{{{_braces(depth - 1)}\}}" if depth else "") + ")*+"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})*+(?:`|\z)"


def _braces(depth: int) -> str:
    return rf"(?:[^{{}}`\"'/]|{_DOUBLE}|{_SINGLE}|/" + (rf"|{_template(depth - 1)}|\{{{_braces(depth - 1)}\}}" if depth else "") + ")*+"


#: Strings that stay in a script's code whatever they hold; with what stands around them they are one token, so that a file has few.
_PLAIN = r"[^\"'`/]++(?:(?:\"[^\"'`\\\n(){};=<>]*+\"|'[^\"'`\\\n(){};=<>]*+')[^\"'`/]*+)*+"

TOKENS = {
    SCRIPT: rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|{_template(2)}|{_REGEX}|{_PLAIN}|[\s\S]",
    PYTHON: rf"#[^\n]*+|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\"|\z)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+(?:'''|\z)|{_DOUBLE}|{_SINGLE}|[^\"'#]++|[\s\S]",
    SQL: rf"--[^\n]*+|{_BLOCK}|'(?:[^']|'')*+(?:'|\z)|\$(\w*)\$[\s\S]*?(?:\$\1\$|\z)|[^'/\-$]++|[\s\S]",
    GO: rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|`[^`]*+(?:`|\z)|[^\"'`/]++|[\s\S]",
}
#: What a string may not hold if it is to stay in the code: no statement is made of the rest.
_UNSAFE = {SCRIPT: r"[(){};=<>\n]|^.[\s\S]*['\"`][\s\S]*.$", PYTHON: r"[\n=;()]", SQL: r"[\s\S]", GO: r"[(){};=<>\n]"}
_COMMENT = {SCRIPT: r"^(?://|/\*)", PYTHON: "^#", SQL: r"^(?:--|/\*)", GO: r"^(?://|/\*)"}
_STRING = {SCRIPT: "^[\"'`]", PYTHON: "^[\"']", SQL: r"^(?:'|\$\w*\$)", GO: "^[\"'`]"}
_INSIDE = r"[^{}]*+"
for _ in range(3):
    _INSIDE = rf"(?:[^{{}}]|\{{{_INSIDE}\}})*+"
_PLACES = rf"\$\{{({_INSIDE})\}}"


def _breaks(token: Column) -> Column:
    return F.regexp_replace(token, "[^\n]+", "")


def _begins(token: Column, language: str, pattern: dict[str, str]) -> Column:
    """Whether a token begins so; two characters tell, but for the dollar quotes of SQL."""
    return (token if language == SQL else F.substring(token, 1, 2)).rlike(pattern[language])


def _code(token: Column, language: str, depth: int = 2) -> Column:
    """A token as code: comments are a blank, strings that could be read as statements are empty; expressions of a template stay, as code."""
    quote, breaks = F.substring(token, 1, 1), _breaks(token)
    if language == SCRIPT and depth:
        places = F.regexp_extract_all(token, F.lit(_PLACES), F.lit(1))
        inner = F.transform(places, lambda e: F.array_join(F.transform(F.regexp_extract_all(e, F.lit(TOKENS[SCRIPT]), F.lit(0)), lambda t: _code(t, language, depth - 1)), ""))
        breaks = F.when(quote == "`", F.concat(F.lit(" "), F.array_join(inner, " ; "), _breaks(F.regexp_replace(token, _PLACES, "")))).otherwise(breaks)
    unsafe = F.substring(token, 2, 1 << 30).rlike(_UNSAFE[language]) | (F.length(token) < 2)
    out = F.when(_begins(token, language, _COMMENT), F.concat(F.lit(" "), _breaks(token))).when(_begins(token, language, _STRING), F.when(unsafe, F.concat(quote, quote, breaks)).otherwise(token))
    if language == SCRIPT:
        out = out.when((F.length(token) > 2) & token.startswith("/"), " 0 ")  # a regular expression
    return out.otherwise(token)


def _notes(token: Column, language: str) -> Column:
    """A token as comments: all else that is no white space is a mark, so that a line of code doesn't begin with a comment."""
    return F.when(token.rlike(_COMMENT[language]), token).otherwise(F.regexp_replace(token, r"\S", "\x01"))


def _read(text: Column, path: Column, token: object) -> Column:
    out = F.when(F.lit(False), text)
    for language, ending in ENDINGS.items():
        parts = F.regexp_extract_all(text, F.lit(TOKENS[language]), F.lit(0))
        out = out.when(F.lower(path).rlike(ending), F.array_join(F.transform(parts, lambda t: token(t, language)), ""))  # noqa: B023
    return out.otherwise(text)


def code_only(files: DataFrame) -> DataFrame:
    """Files (path, text) whose texts hold code alone, by the language of their ending; those of other languages stay as they are, and so does a table that was made so (``lexed``)."""
    return files if "lexed" in files.columns else files.withColumn("text", _read(F.col("text"), F.col("path"), _code))


def lexed(files: DataFrame) -> DataFrame:
    """``code_only``, marked so that readers take it as it is."""
    return code_only(files).withColumn("lexed", F.lit(True))


def comments_only(files: DataFrame) -> DataFrame:
    """Files (path, text) whose texts hold comments alone."""
    return files.withColumn("text", _read(F.col("text"), F.col("path"), _notes))
