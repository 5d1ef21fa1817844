import datetime as dt
import json

from pyspark.sql import functions as F

from graphloom.operators import catalog


def test_imports_of_a_module(spark):
    rows = [("p.m", "p/m.py", 1, "a.b", None, 0, None, "a"), ("p.m", "p/m.py", 2, None, "q", 1, "module", "q"), ("p", "p/__init__.py", 1, "q", "x", 1, "package", "x"), ("o", "o.py", 1, "ab", None, 0, None, "ab")]
    i = spark.createDataFrame(rows, "module string, file string, line int, target string, name string, level int, kind string, full_name string")
    assert [r.statement for r in catalog.find_imports(i, "p.q").collect()] == ["from .q import x", "from . import q"]
    assert [r.importer for r in catalog.find_imports(i, "a").collect()] == ["p.m"]
    mods = spark.createDataFrame([("p.q",), ("a.b",)], "module string")
    assert {tuple(r) for r in catalog.imported_modules(i, mods, "p/m.py").collect()} == {("q", "p.q"), ("a", "a.b")}


def test_projects_and_namespaces(spark):
    d = spark.createDataFrame([("x", "C", "a.C"), ("x", "C", "b.C"), ("y", "D", "D")], "project string, name string, full_name string")
    assert [tuple(r) for r in catalog.search_projects(d, "C").collect()] == [("x", 2, ["a.C", "b.C"])]
    f = spark.createDataFrame([("/1", 0, "co/a.py"), ("/2", 1, "co/b/__init__.py"), ("/2", 1, "co/b.py"), ("/2", 1, "co/a.py"), ("/1", 0, "reg/__init__.py"), ("/1", 0, "data/x.txt")], "root string, root_rank int, path string")
    assert [tuple(r) for r in catalog.namespace_packages(f).collect()] == [("co", ["/1", "/2"])]
    names = spark.createDataFrame([("co.a",), ("co.b",), ("co.z",)], "name string")
    assert {tuple(r) for r in catalog.namespace_import(f, names).collect()} == {("co.a", "/1", "co/a.py"), ("co.b", "/2", "co/b/__init__.py")}
    b = spark.createDataFrame([("A", "B"), ("C", None)], "owner string, dst string")
    assert tuple(catalog.base_resolution(b).first()) == (2, 1, 0.5) and catalog.base_resolution(b.limit(0)).first().ratio == 0.0


def test_types_scopes_and_state(spark, tmp_path):
    df = spark.createDataFrame([("list[a] | b",), (None,)], "t string").select(catalog.leaf_types_of(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a", "b"], None]
    assert catalog.leaf_types("dict[str, list[A.B] | None] | tuple[int, ...]") == ["str", "A.B", "None", "int", "..."]
    assert catalog.split_top_level("a, f(b, c), [d, e],") == ["a", "f(b, c)", "[d, e]"]
    assert catalog.resolve_scope(None, "m", {"m": "main"}, {}) == ["main"] and catalog.resolve_scope(["own", "x"], "m", {}, {"own": ["main", "packages"]}) == ["main", "packages", "x"]
    assert catalog.resolve_scope(None, "q", {}, {}) == ["all"] and json.loads(catalog.about())["name"] == "graphloom"
    lines = spark.createDataFrame([('{"end_time": "2024-01-01T00:00:00"}',), ('{"end_time": "2024-03-01T00:00:00"}',), ("broken",)], "value string")
    assert catalog.older_than(lines, 30, F.lit(dt.datetime(2024, 3, 2))).count() == 2
    p = f"{tmp_path}/s.json"
    assert catalog.read_state(p)["version"] == 1
    catalog.write_state(p, {"version": 1, "coverage": [{"unit": "u", "content_hash": "h"}], "confirmed_non_issues": []})
    assert catalog.state_tables(spark, catalog.read_state(p))["coverage"].first().unit == "u"


def test_documents_are_changed_under_a_lock(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "d" / "counts.json")

    def one(k):
        catalog.update_document(path, lambda d: d.update(n=d.get("n", 0) + 1))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(one, range(60)))
    assert catalog.update_document(path, lambda d: None) == {"n": 60}
    (tmp_path / "d" / "counts.json").write_text("not json")
    assert catalog.update_document(path, lambda d: d.update(a=1), lambda: {"v": 1}) == {"v": 1, "a": 1}
