from pyspark.sql import functions as F

from graphloom.operators import hierarchy, patterns, plugins, resolve
from graphloom.sources import code, files, layout


def test_declared_layouts(tmp_path):
    for d in ("a", "b", "c", "d", "extra", "more/x"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text(
        """[tool.setuptools.packages.find]
where = ["a", "none"]
[tool.poetry]
packages = [{include = "x", from = "b"}, {include = "y"}]
[tool.hatch.build.targets.wheel]
sources = "c"
[tool.pdm.build]
package-dir = "d"
[tool.pyright]
extraPaths = ["extra", "gone"]
executionEnvironments = [{root = "r", extraPaths = ["more/x", "extra"]}, "odd"]
"""
    )
    own = [(tmp_path / p).resolve().as_posix() for p in ("extra", "more/x")]
    assert layout.detect_layout(str(tmp_path)) == ["a", "b", "c", "d", *own]
    assert layout.project_packages(str(tmp_path), {"packages": ["z", "a"]}) == ["z", "a", "b", "c", "d", *own]
    (tmp_path / "pyproject.toml").write_text("[tool\n")
    assert layout.detect_layout(str(tmp_path)) == [] and layout.detect_layout(str(tmp_path / "a")) == []


def test_discovered_layouts(tmp_path):
    project = tmp_path / "p"
    (project / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "m.py").write_text("")
    (tmp_path / "empty").mkdir()
    site = project / ".venv" / "lib" / "python3" / "site-packages"
    site.mkdir(parents=True)
    assert layout.discover(str(project)) == [str(tmp_path / "other"), str(site)]
    (project / "src" / "pkg" / "__init__.py").write_text("")
    assert layout.discover(str(project)) == ["src"] and layout.project_packages(str(project), {}) == ["src"]


def test_project_files_by_scope(spark, tmp_path):
    for f in ("p/a.py", "p/test_a.py", "p/sub/deep/b.py", "p/venv/x.py", "lib/c.py", "lib/_private/__init__.py"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(f"# {f}")
    settings = {"packages": [str(tmp_path / "lib")]}

    def seen(**how):
        return sorted(r.file.removeprefix(f"{tmp_path}/") for r in layout.project_files(spark, str(tmp_path / "p"), settings, **how).collect())

    everything = ["lib/_private/__init__.py", "lib/c.py", "p/a.py", "p/sub/deep/b.py", "p/test_a.py"]
    assert seen() == everything and seen(scope="main") == everything[2:] and seen(scope=["packages"]) == everything[:2]
    assert seen(pattern="test_*.py") == ["p/test_a.py"] and seen(scope="namespaces") == []
    assert seen(method="list", defaults={"list": "mine"}, aliases={"mine": ["packages"]}) == everything[:2]
    assert seen(method="other", general="main") == everything[2:]
    read = layout.project_files(spark, str(tmp_path / "p"), settings, pattern="b.py", contents=True).first()
    assert read.content == "# p/sub/deep/b.py" and read.module == "sub.deep.b"
    assert files.listing(spark, str(tmp_path / "p"), recursive=False).count() == 2


def test_plugins_switch_on_by_imports_and_files(spark):
    rows = [("m", "m.py", "from pydantic import BaseModel\nclass A(BaseModel):\n    x: int\nclass B:\n    pass\n"), ("manage", "manage.py", "")]
    facts = code.facts(spark.createDataFrame(rows, "module string, file string, content string")).cache()
    active = plugins.activate(facts)
    assert [p.name for p in active] == ["django", "pydantic"]
    assert {"find_models", "find_django_models"} <= set(plugins.registered_tools(active)) and "find_flask_routes" not in plugins.registered_tools(active)
    symbols = code.of(facts, "def").where("kind = 'class'").select("name", "full_name")
    assert {(r.name, r.is_model) for r in plugins.augmented(symbols, facts, active).collect()} == {("A", True), ("B", False)}
    pydantic = active[1]
    assert [r.name for r in pydantic.find_patterns("find_models", facts).collect()] == ["A"] and pydantic.find_patterns("none", facts) is None
    assert {(r.component, r.file) for r in pydantic.components(facts).collect()} == {("find_models", "m.py")}


def test_schema_templates_and_scopes(spark, tmp_path):
    text = "class A(BaseModel):\n    x: int\n    y: int = 1\n    class Config: pass\n    @validator('x')\n    def check(cls, v): return v\n    @property\n    def z(self): pass\ndef page():\n    return render_template('a.html', x=1)\n"
    facts = code.facts(spark.createDataFrame([("m", "m.py", text)], "module string, file string, content string")).cache()
    row = patterns.model_schema(facts, "A").first()
    assert (row.required, row.optional, row.validators, row.computed_fields, row.config) == (["x"], ["y"], ["check"], ["z"], "class")
    assert patterns.model_schema(facts, "B").count() == 0
    listed = spark.createDataFrame([("/p/templates/x/a.html",), ("/p/templates/b.txt",), ("/p/m.py",)], "file string")
    both = patterns.flask_templates(facts, listed).first()
    assert [(t.name, t.file) for t in both.templates] == [("x/a.html", "/p/templates/x/a.html")] and [c.template for c in both.render_calls] == ["a.html"]
    settings = {"packages": ["lib"], "namespaces": {"Co": ["/c"]}}
    assert files.suggest_scopes("n", settings) == ["namespaces", "namespace:Co"] and files.suggest_scopes("M", settings, {"mine": "all"}) == ["main", "mine"]
    assert files.list_scopes(settings)["packages"] == ["package:lib"]
    told = files.explain_scope(files.roots_table(spark, "/p", settings), ["packages", "namespaces"]).collect()
    assert sorted((r.scope, str(r.root), str(r.role)) for r in told) == [("namespaces", "None", "None"), ("packages", "lib", "package")]
    files.save_settings(str(tmp_path), settings)
    assert files.read_settings(str(tmp_path)) == settings
    df = spark.createDataFrame([("a(b",), ("ab",)], "content string")
    assert [r[0] for r in df.where(files.text_matches(F.col("content"), "a(")).collect()] == ["a(b"]


def test_subclasses_by_name(spark):
    classes = spark.createDataFrame([("A", "m.A"), ("A", "n.A"), ("B", "m.B")], "name string, handle string")
    bases = spark.createDataFrame([("m.C", "m.B"), ("m.D", "m.C"), ("m.E", "m.D"), ("m.E", "m.C")], "child string, parent string")
    assert hierarchy.find_subclasses("A", classes, bases) == (["m.A", "n.A"], None)
    alias = spark.createDataFrame([("pkg.B", "m.B")], "alias string, handle string")
    for name in ("B", "m.B", "pkg.B"):
        rows = {r.handle: r for r in hierarchy.find_subclasses(name, classes, bases, alias, hierarchy=True)[1].collect()}
        assert {h: r.chain for h, r in rows.items()} == {"m.C": ["m.C", "m.B"], "m.D": ["m.D", "m.C", "m.B"], "m.E": ["m.E", "m.C", "m.B"]} and rows["m.C"].is_direct
    assert hierarchy.find_subclasses("none", classes, bases)[1].count() == 0


def test_symbols_below_roots_with_import_paths(spark):
    defs = spark.createDataFrame([("run", "m.A.run", "m.A", "/p/m.py", 1, 0), ("run", "x.run", "x", "/q/x.py", 1, 0)], "name string, full_name string, parent string, file string, line int, column int")
    roots = spark.createDataFrame([("/p",)], "root string")
    names = spark.createDataFrame([("pkg.run", "m.A.run")], "alias string, handle string")
    row = resolve.find_symbol(defs, "run", roots=roots, names=names).collect()
    assert [r.full_name for r in row] == ["m.A.run"] and "from pkg import run" in row[0].import_paths
    assert [r.full_name for r in resolve.find_symbol(defs, "A.ru", fuzzy=True).collect()] == ["m.A.run"]
