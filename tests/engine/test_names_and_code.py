import pytest

from graphloom.functions import scalar
from graphloom.operators import dependencies, hierarchy, patterns, resolve
from graphloom.sources import code, files


def column(spark, f, *rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(f(*[df[c] for c in df.columns])).collect()]


def test_scalars(spark):
    assert column(spark, scalar.is_handle, "a.b_1", "1a", "a..b", "", "é", None) == [True, False, False, False, False, False]
    assert column(spark, scalar.symbol_class, "M.__init__", "a.__len__", "_x", "M.f", "m.f", "a.b.c", "x", "") == ["class_constructor", "magic_method", "private_member", "class_member", "module_function", "qualified_member", "simple_member", "unknown"]
    assert column(spark, scalar.identifier_form, "a/b.py:3", "a.py", "a.b", "A", "x:3") == ["file_line", "file", "dotted", "bare", "bare"]
    rel = lambda m, t, n, p: scalar.relative_import(m, t, n, p)
    got = column(spark, rel, ("a.b.c", "x", 1, False), ("a.b", "x", 1, True), ("a.b.c", None, 2, False), ("a", "x", 3, False), ("a.b", "y.z", 0, False), ("a", None, 1, False), schema="m string, t string, n int, p boolean")
    assert got == ["a.b.x", "a.b.x", "a", None, "y.z", None]
    assert column(spark, scalar.normal_claim, "  A  b\n C ", None) == ["a b c", ""]
    assert column(spark, lambda c: scalar.sanitize_text(c, 5), "a\x00b\x07c\tdef", None) == ["abc\t", ""]
    assert column(spark, lambda c: scalar.module_name(c, "/p/src"), "/p/src/a/b.py", "/p/src/a/__init__.py", "/q/a.py", "/p/src/a.txt") == ["a.b", "a", None, None]
    assert column(spark, scalar.prefixes, "a.b.c") == [["a", "a.b", "a.b.c"]]
    assert column(spark, scalar.reexport_statements, "a.b.C") == [["from a import C", "from a.b import C"]]
    assert column(spark, lambda c: scalar.path_scope(c, "/p", ("/ns",), ("/usr/lib",)), "/p/a.py", "/p/dist/a.py", "/p/x/dist/a.py", "/v/site-packages/p/a.py", "/usr/lib/os.py", "/ns/a.py", "/z") == ["project", "external", "project", "external", "external", "project", "external"]


SOURCES = {
    "pkg": ("pkg/__init__.py", "from .base import Root as Root\nfrom .base import *\n"),
    "pkg.base": ("pkg/base.py", "import os\nfrom missing import gone\n\n\ndef helper(x: int) -> 'list[str] | None':\n    def inner():\n        os.getcwd()\n    return x\n\n\nclass Root:\n    def run(self):\n        helper(1)\n        self.stop()\n        helper(2)\n        (lambda: unknown())()\n        print(x)\n\n    def stop(self):\n        pass\n"),
    "pkg.mid": ("pkg/mid.py", "from pkg import Root\nfrom . import base\n\n\nclass Mid(Root):\n    pass\n\n\nclass Leaf(Mid, base.Root):\n    pass\n"),
    "bad": ("bad.py", "def broken(:\n"),
}


@pytest.fixture(scope="module")
def facts(spark):
    return code.facts(spark.createDataFrame([(m, *fc) for m, fc in SOURCES.items()], "module string, file string, content string")).cache()


def test_tables_of_sources(spark, facts):
    t = code.tables(facts)
    nodes = {r.handle: r for r in t["nodes"].collect()}
    assert nodes["pkg.base.Root.run"].kind == "method" and nodes["pkg.mid"].kind == "module" and nodes["pkg.base.helper"].signature == "helper(x: int) -> 'list[str] | None'"
    edges = {(r.src, r.kind, r.dst) for r in t["edges"].collect()}
    assert {d for s, k, d in edges if (s, k) == ("pkg.base.Root.run", "callees")} == {"pkg.base.helper", "pkg.base.Root.stop"}
    assert ("pkg.mid.Mid", "superclasses", "pkg.base.Root") in edges and ("pkg.base.Root", "subclasses", "pkg.mid.Leaf") in edges
    assert ("pkg.mid", "imports", "pkg.base.Root") in edges and ("pkg.mid", "imports", "pkg.base") in edges
    assert ("pkg.base.Root.stop", "enclosing_scope", "pkg.base.Root") in edges
    un = [(r.src, r.edge, r.target) for r in t["unresolved"].collect()]
    assert ("pkg.base", "imports", "missing.gone") in un and ("pkg.base", "imports", "os") in un
    assert len([u for u in un if u[0] == "pkg.base.Root.run"]) == 2
    assert [r.file for r in code.of(facts, "parse_error").collect()] == ["bad.py"]
    refs = {(r.full_name, r.text, r.target) for r in code.of(facts, "type_ref").collect()}
    assert ("0", "list[str] | None", "Union") in refs and ("0.0.0", "str", "str") in refs


def test_resolve_forms(spark, facts):
    t = code.tables(facts)
    defs = code.of(facts, "def").select("name", "full_name", "parent", "file", "line", "col").withColumnRenamed("col", "column")
    nodes = t["nodes"]
    ask = lambda x: resolve.resolve(x, nodes, defs, t["canonical"]).first()
    assert ask("Mid").handle == "pkg.mid.Mid" and ask("pkg.Root").handle == "pkg.base.Root" and ask("pkg/mid.py").handle == "pkg.mid"
    assert ask("pkg/mid.py:5").handle == "pkg.mid.Mid" and ask("pkg/none.py").reason == "file_not_found" and ask("Nope").reason == "unresolved"
    names = {r.handle: r.re_exports for r in resolve.re_exports(t["canonical"]).collect()}
    assert "pkg.Root" in names["pkg.base.Root"]
    row = resolve.inspect(nodes, t["edges"], resolve.re_exports(t["canonical"]), "pkg.base.Root").first()
    assert row.members == 2 and row.superclasses == 0 and row.callees is None and row.re_exports
    gone = resolve.inspect(nodes, t["edges"], resolve.re_exports(t["canonical"]), "no.such").first()
    assert (gone.kind, gone.scope, gone.members) == ("variable", "external", None)
    assert resolve.find_symbol(defs, "Root.run").count() == 1 and resolve.find_symbol(defs, "oo", fuzzy=True).count() == 1


def test_canonical_circles_end_nowhere(spark):
    b = spark.createDataFrame([("a", "x", "b.x"), ("b", "x", "a.x"), ("c", "y", "d.y"), ("d", "y", "e.y"), ("s", "s", "s.s")], "module string, surface string, target string")
    got = {(r.alias, r.handle, r.hops) for r in resolve.canonical(b, spark.createDataFrame([("e.y",)], "handle string")).collect()}
    assert got == {("c.y", "e.y", 2), ("d.y", "e.y", 1)}


def test_hierarchy(spark):
    bases = [("B", 0, "A"), ("C", 0, "A"), ("D", 0, "B"), ("D", 1, "C")]
    df = spark.createDataFrame(bases, "child string, ord int, parent string")
    got = {}
    for r in hierarchy.resolution_orders(df).orderBy("ord").collect():
        got.setdefault(r.handle, []).append(r.name)
    assert got["D"] == ["D", "B", "C", "A"] and got["B"] == ["B", "A"]
    assert hierarchy.linearize("X", {"X": ["P", "Q"], "P": ["A", "B"], "Q": ["B", "A"]})[:2] == ["X", "P"]
    assert [(r.handle, r.is_direct) for r in hierarchy.subclasses(df, "A").collect()] == [("B", True), ("C", True), ("D", False)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert hierarchy.closure(loop).count() == 2
    names = df.selectExpr("child", "ord", "parent as name", "parent")
    assert [r.name for r in hierarchy.inheritance_chain(df, names, "D").collect()] == ["B", "C", "A", "object"]


def test_importers_and_listings(spark):
    i = spark.createDataFrame([("m", "a.b.c", None), ("n", "a", "b"), ("o", "ab", None), ("a.b", "a.b", None)], "module string, target string, name string")
    mods = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",)], "module string")
    assert {tuple(r) for r in dependencies.imported_by(i, mods).collect()} == {("a", "m"), ("a.b", "m"), ("a.b.c", "m"), ("a", "n"), ("a.b", "n"), ("a", "a.b")}
    ls = spark.createDataFrame([("p", "x", 0, "namespace"), ("p", "x", 0, "module"), ("p", "x", 1, "package"), ("p", ".h", 0, "module"), ("p", "__pycache__", 0, "package"), ("p", "y", 1, "package")], "package string, child string, root_rank int, kind string")
    assert {(r.child, r.kind) for r in dependencies.submodules(ls).collect()} == {("x", "module"), ("y", "package")}


WEB = '''
import flask_login
app = Flask(__name__)
bp = Blueprint("shop", __name__)
app.config["X"] = 1
class V(MethodView):
    pass
@app.route("/a", methods=["POST"])
def a(): return render_template("a.html")
@bp.route("/b")
def b(): pass
@app.route("/c")
async def c(): pass
@app.errorhandler(404)
def e(x): pass
@app.cli.command("seed")
def s(): pass
'''


def test_patterns(spark):
    src = [("web", "web.py", WEB), ("shop.models", "shop/models.py", "class M(models.Model): pass\nclass N(Other): pass\n"), ("shop.views", "shop/views.py", "def v(request): pass\ndef w(x): pass\nclass L(ListView): pass\n"), ("m", "m.py", "class A(BaseModel):\n    x: int\n    y: int = 1\n    class Config: pass\n    @property\n    def z(self): pass\nclass B(A):\n    model_config = {}\n")]
    f = code.facts(spark.createDataFrame(src, "module string, file string, content string")).cache()
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(patterns.flask_routes(f), "name", "path", "methods") == [("a", "/a", ["POST"]), ("b", "/b", ["GET"])]
    assert rows(patterns.flask_blueprints(f), "name", "blueprint") == [("bp", "shop")] and rows(patterns.flask_views(f), "name") == [("V",)]
    assert rows(patterns.flask_extensions(f), "name") == [("flask_login",)] and rows(patterns.flask_error_handlers(f), "name") == [("e",)]
    assert rows(patterns.flask_cli(f), "command") == [("seed",)] and rows(patterns.template_calls(f), "name") == [("a.html",)] and patterns.flask_config(f).count() == 1
    assert rows(patterns.django_models(f), "name") == [("M",)] and rows(patterns.django_views(f), "name", "view") == [("L", "class"), ("v", "function")]
    assert rows(patterns.pydantic_models(f), "name", "required", "optional") == [("A", ["x"], ["y"])]
    assert rows(patterns.pydantic_config(f), "model", "style") == [("m.A", "class"), ("m.B", "model_config")] and rows(patterns.pydantic_computed(f), "name") == [("z",)]
    assert rows(patterns.pydantic_inheritance(f, "A"), "relation", "name") == [("child", "B"), ("parent", "BaseModel")]


def test_file_scan_and_settings(spark, tmp_path):
    for p, t in {"a/x.py": "x = 1\n", "a/venv/y.py": "y", "a/z.txt": "z", "b/x.py": "import a\n", "a/p/__init__.py": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {(r.module, r.content) for r in files.source_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()}
    assert got == {("x", "x = 1\n"), ("x", "import a\n"), ("p", "")}
    assert files.source_files(spark, [f"{tmp_path}/b"], contains="import").count() == 1
    (tmp_path / "graphloom.json").write_text('{"packages": ["/q"], "namespaces": {"co": ["/n1", "/n2"]}}')
    s = files.configure(files.read_settings(str(tmp_path)), packages=["/q", "/r"], standalone=["/s"])
    roots = files.roots_table(spark, str(tmp_path), s)
    assert [r.root for r in files.roots_for(roots, "packages").collect()] == ["/q", "/r"] and [r.root for r in files.roots_for(roots, ["main", "namespace:co"]).collect()] == [str(tmp_path), "/n1", "/n2"]
    assert files.roots_for(roots, "namespaces").count() == 0 and files.scope_problem("namespace:x", ["co"]) and files.scope_problem("main", []) is None and files.scope_problem("standalone", [])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n')
    assert files.read_jsonl(spark, f"{tmp_path}/l.jsonl", "a int").where("a IS NOT NULL").count() == 1
    assert files.read_jsonl(spark, f"{tmp_path}/l.jsonl", "a int", keep_bad=True).count() == 2


def test_a_deep_tree_is_walked_by_all_tasks(spark, tmp_path):
    deep = tmp_path / "one"
    for k in range(40):
        deep = deep / f"d{k % 3}"
        (deep / f"side{k}").mkdir(parents=True)
        (deep / f"m{k}.py").write_text("x = 1\n")
        (deep / f"side{k}" / "n.py").write_text("y = 1\n")
    (tmp_path / "one" / "venv").mkdir()
    (tmp_path / "one" / "venv" / "z.py").write_text("z")
    want = {str(p) for p in tmp_path.rglob("*.py") if "venv" not in p.parts}
    for folders in (1, 7, files.FOLDERS):
        rows = files.listing(spark, str(tmp_path), folders=folders).collect()
        assert {r.file for r in rows} == want and len(rows) == len(want)
    (tmp_path / "one" / "bad.py").write_bytes(b"\xff\xfe")
    found = files.source_files(spark, [str(tmp_path)], errors=True).where("error IS NOT NULL").collect()
    assert [(r.file.rsplit("/", 1)[1], r.content) for r in found] == [("bad.py", None)] and "UnicodeDecodeError" in found[0].error
    assert files.source_files(spark, [str(tmp_path)]).count() == len(want)


def test_long_chains_and_circles_of_classes(spark):
    from pyspark.sql import functions as F

    chain = spark.range(1, 1500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("child"), F.lit(0).alias("ord"), F.concat(F.lit("c"), (F.col("id") - 1).cast("string")).alias("parent"))
    got = hierarchy.resolution_orders(chain)
    assert got.count() == sum(range(2, 1501)) and got.where("handle = 'c1499' AND ord = 1499").first()["name"] == "c0"
    diamonds = [(f"{a}{k}", i, f"{b}{k}") for k in range(300) for a, i, b in (("B", 0, "A"), ("C", 0, "A"), ("D", 0, "B"), ("D", 1, "C"), ("E", 0, "D"), ("F", 0, "E"), ("F", 1, "D"))]
    diamonds += [("x", 0, "y"), ("y", 0, "x"), ("z", 0, "x"), ("z", 1, "A0"), ("bad", 0, "B0"), ("bad", 1, "F0"), ("w", 0, "z")]
    rows = {}
    for r in hierarchy.resolution_orders(spark.createDataFrame(diamonds, "child string, ord int, parent string")).orderBy("ord").collect():
        rows.setdefault(r.handle, []).append(r.name)
    table = {}
    for c, _, p in sorted(diamonds):
        table.setdefault(c, []).append(p)
    assert rows == {c: hierarchy.linearize(c, table) for c in table}


def test_lexical_scopes(spark):
    text = """import a.b as ab, os.path
from . import c as cc
X = 1
class K:
    Y = X
    def f(self, p, *q: X, k=X, **r):
        nonlocal_ = [p for p in q if p]
        def g():
            nonlocal nonlocal_
            nonlocal_ = Y
            return p, (lambda s: s + X)(1)
        with ab.open(p) as h, h:
            (u, [v, *w]) = p
        try:
            pass
        except OSError as e:
            e.args
        match p:
            case K(Y=z) | {"k": z, **m}:
                z.é = m
        del u
        global X
        X = len(r)
        return (n := g())
"""
    rows = [r for r in code.facts_of("pk.m", "pk/m.py", text) if r["fact"] == "name"]
    lines = text.splitlines()
    assert all(lines[r["line"] - 1][r["col"] : r["col_end"]] == r["name"] for r in rows)
    seen = {(r["line"], r["col"]): r["full_name"] or (r["head"], tuple(r["steps"])) for r in rows}
    at = lambda line, what, nth=0: seen.get((line, [i for i in range(len(lines[line - 1])) if lines[line - 1].startswith(what, i)][nth]))
    assert at(1, "b") == ("a:a.b", ()) and at(1, "path") == ("a:os.path", ()) and at(2, "cc") == ("a:pk", ("c",))
    assert at(5, "X") == "pk.m.X" and at(6, "X") == "pk.m.X" and at(6, "q") == "pk.m.K.f.q" and at(10, "Y") == ("m:pk.m", ("Y",))  # a class's names are not seen inside its methods
    assert at(10, "nonlocal_") == "pk.m.K.f.nonlocal_" and at(11, "p") == "pk.m.K.f.p" and at(11, "X") == "pk.m.X"
    assert at(12, "open") == ("a:a.b", ("open",)) and at(12, "h", 1) == "pk.m.K.f.h" and at(13, "w") == "pk.m.K.f.w" and at(15, "pass") is None
    assert at(19, "K") == "pk.m.K" and at(20, "m") == "pk.m.K.f.m" and at(23, "X") == "pk.m.X" and at(23, "len") == ("m:pk.m", ("len",)) and at(24, "g") == "pk.m.K.f.g"
    assert code.facts_of("m", "m.py", "x = " + "(" * 60 + "1" + ")" * 60)[0]["fact"] == "file"
    huge = "x = " + "+".join(["y"] * 5000) + "\nclass C: pass\n"
    assert {r["fact"] for r in code.facts_of("m", "m.py", huge)} >= {"file", "def"} or code.facts_of("m", "m.py", huge)[0]["fact"] == "parse_error"


def test_all_lists_what_a_star_gives(spark):
    src = {
        "p": ("p/__init__.py", "from .core import *\n__all__ = ['A']\n__all__ += ['_hidden']\n"), "p.core": ("p/core.py", "from .more import *\n__all__ = ('A', '_hidden', 'far')\nclass A: pass\nclass B: pass\ndef _hidden(): pass\n"),
        "p.more": ("p/more.py", "def far(): pass\ndef _own(): pass\n"), "use": ("use.py", "from p import *\nclass C(A): pass\n\ndef f():\n    _hidden()\n    far()\n    B()\n"),
    }
    t = code.tables(code.facts(spark.createDataFrame([(m, *fc) for m, fc in src.items()], "module string, file string, content string")))
    got = {(r.alias, r.handle) for r in t.canonical.collect()}
    assert got == {("p.A", "p.core.A"), ("p._hidden", "p.core._hidden"), ("p.far", "p.more.far"), ("p.core.far", "p.more.far"), ("use.A", "p.core.A"), ("use._hidden", "p.core._hidden")}
    assert {(r.src, r.dst) for r in t.edges_of("callees").collect()} == {("use.f", "p.core._hidden")} and t.unresolved_of("callees").count() == 2
    paths = {r.handle: r.import_paths for r in resolve.with_import_paths(t.plain, t.canonical).collect()}
    assert paths["p.core.A"] == ["from p import A", "from p.core import A", "from use import A"] and paths["p.core.B"] == ["from p.core import B"] and paths["p"] == []


def test_claims_are_case_folded(spark):
    texts = ["Straße ﬁn ΣΑΣ ς", "ẞ İ ŉ ΐ և", "plain Text", "ﬃ ẖ Ⅷ ᏸ Ა", "", None]
    assert column(spark, scalar.normal_claim, *texts) == [" ".join((t or "").split()).casefold() for t in texts]


def test_closures_double(spark):
    import random

    r = random.Random(3)
    for n, m in ((12, 20), (40, 45), (1, 1)):
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] + [(f"c{k}", f"c{k + 1}") for k in range(70)]
        below = {}
        for c, p in pairs:
            below.setdefault(p, set()).add(c)
        want = set()
        for root in below:
            seen, level, d = {root}, {root}, 0
            while level:
                d += 1
                level = {c for x in level for c in below.get(x, ())} - seen
                seen |= level
                want |= {(root, x, d) for x in level}
        df = spark.createDataFrame(pairs, "child string, parent string")
        assert {tuple(x) for x in hierarchy.closure(df).collect()} == want
        roots = sorted(below)[:3]
        assert {tuple(x) for x in hierarchy.closure(df, spark.createDataFrame([(x,) for x in roots], "root string")).collect()} == {w for w in want if w[0] in roots}
