"""What only looks like code gives no rows, what is spread over lines does."""

import pytest
from pyspark.sql import functions as F

from tessellar.sources import code, lexer

SCRIPT = r'''import { a } from "./a"; // import { b } from "./b";
/* import { c } from "./c";
   fake(1) */
const s = "import d from './d'; fake(2)", q = 'it\'s fake(3) "', r = /["'`]fake\(4\)/g.test(s);
const t = `import e from "./e"
export function inner() {}
${real(s) + `${deep("x")} fake(5)`} fake(6)
// WHY: not a reason
`;
export class Widget
  extends Base
  implements Shape, Other {
  run() { return a() / 2 / other(); } // WHY: a trailing one is code's
}
// WHY: a reason, see ADR-7
export
async function spread() { db.from(
  'orders').then(); }
const u = "http://x/y"; last();
import {
  f,
  g as h
} from './f';
'''
PYTHON = r"""from .a import (one,
    two as second)
import os.path as p, json
s = '''
from .b import three
class Fake(Base):
'''
t = "import nothing"  # from .c import four
class Real(Base,
           Other):
    '''class Inner(Base): def x(): pass'''
def go(): pass
@app.get(
    "/items/{id}",
    name="x")
def items(): pass
# NOTE: a note
"""
SQL = r"""-- create table commented (id int);
/* create table blocked (id int); */
create table
  public.real (id int references
  other (id), note text default 'create table quoted (id int)');
create function f() returns void as $body$
create table inside (id int);
$body$ language sql;
alter table if exists
  real add column x int;
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("src/m.ts", SCRIPT), ("lib/m.py", PYTHON), ("db/m.sql", SQL), ("n.ts", None), ("e.ts", ""), ("x.txt", "// 'stays")], "path string, text string")


def test_lines_stay(files):
    for make in (lexer.code_only, lexer.comments_only):
        for r in make(files.withColumn("before", F.col("text"))).collect():
            assert (r["text"] or "").count("\n") == (r["before"] or "").count("\n"), r["path"]
    shown = {r["path"]: r["text"] for r in lexer.code_only(files).collect()}
    assert "fake" not in shown["src/m.ts"] and "real(s)" in shown["src/m.ts"] and shown["x.txt"] == "// 'stays" and shown["n.ts"] is None


def test_scripts(files):
    assert {(r["specifier"], tuple(r["names"])) for r in code.script_imports(files).collect()} == {("./a", ("a",)), ("./f", ("f", "g"))}
    assert {(r["binding"], r["member"]) for r in code.calls(files).where("path = 'src/m.ts'").collect()} >= {("a", None), ("other", None), ("real", None), ("last", None), ("deep", None)}
    assert not [r for r in code.calls(files).collect() if r["binding"].startswith("fake")]
    assert {(r["line"], r["kind"], r["name"]) for r in code.exported_symbols(files).where("path = 'src/m.ts'").collect()} == {(10, "class", "Widget"), (16, "function", "spread")}
    assert {(r["line"], r["name"], r["binding"]) for r in code.heritage(files).where("path = 'src/m.ts'").collect()} == {(10, "Widget", b) for b in ("Base", "Shape", "Other")}
    assert [(r["line"], r["name"]) for r in code.table_literals(files).where("path = 'src/m.ts'").collect()] == [(17, "orders")]


def test_python(files):
    assert {(r["specifier"], tuple(r["names"])) for r in code.python_imports(files).collect()} == {(".a", ("one", "two")), ("os.path", ("*",)), ("json", ("*",))}
    assert {(r["kind"], r["name"]) for r in code.exported_symbols(files).where("path = 'lib/m.py'").collect()} == {("class", "Real"), ("function", "go"), ("function", "items")}
    assert {(r["name"], r["binding"]) for r in code.heritage(files).where("path = 'lib/m.py'").collect()} == {("Real", "Base"), ("Real", "Other")}
    assert [(r["line"], r["url"], r["method"]) for r in code.python_routes(files).collect()] == [(13, "/items/{id}", "GET")]


def test_schema_and_reasons(files):
    objects, links = code.schema_statements(files)
    assert [(r["line"], r["kind"], r["name"]) for r in objects.orderBy("line").collect()] == [(3, "table", "real"), (6, "function", "f")]
    assert {(r["line"], r["kind"], r["source"], r["target"]) for r in links.collect()} == {(3, "defines", None, "real"), (6, "defines", None, "f"), (9, "modifies", None, "real"), (3, "references", "real", "other")}
    assert [(r["path"], r["line"], r["kind"], r["text"], r["adr"]) for r in code.rationales(files).orderBy("path").collect()] == [("lib/m.py", 17, "note", "a note", None), ("src/m.ts", 15, "why", "a reason, see ADR-7", "ADR-7")]


def test_long_texts(spark):
    texts = [("a.ts", '"' + "x\\n" * 200_000 + '"'), ("b.ts", "/*" + "*" * 300_000), ("c.ts", "`" + "a${b}" * 50_000), ("d.sql", "$$" + "x" * 300_000), ("e.py", '"""' + '"' * 100_000), ("f.ts", "f(1);\n" * 50_000)]
    out = lexer.code_only(spark.createDataFrame(texts, "path string, text string")).select("path", F.length("text").alias("n")).collect()
    assert {r["path"]: r["n"] for r in out}["f.ts"] == 6 * 50_000 and len(out) == 6


def test_imports_are_few_tokens(spark):
    text = "\n".join(f"import {{ a{i} }} from '../b/p{i}.ts'; /* '{i}' */" if i % 50 == 0 else f'import {{ a{i} }} from "../b/p{i}.ts";' for i in range(200)) + "\nconst q = \"it's\", r = 'a\\'(b', s = \"x=1\";"
    row = spark.createDataFrame([("a.ts", text)], "path string, text string")
    assert row.select(F.size(F.regexp_extract_all("text", F.lit(lexer.TOKENS[lexer.SCRIPT]), F.lit(0)))).first()[0] < 30
    assert len(code.script_imports(row).collect()) == 200 and lexer.code_only(row).first().text.endswith('const q = "", r = \'\', s = "";')
    again = lexer.lexed(row)
    assert lexer.code_only(again) is again and len(code.script_imports(again).collect()) == 200
