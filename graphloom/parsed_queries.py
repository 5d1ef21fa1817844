"""Registered queries over a parsed project (plans.rendered.project), and over what has no place in the relational binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import catalog, dependencies, diagnostics, hierarchy, metrics, plugins, resolve, review, traverse
from .plans import relational as g
from .plans.rendered import project, project_tables
from .sources.code import of
from .queries import query

_P = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_nationkey + 1) % 25 AS m, 'shop.n' || s_nationkey AS pkg, 'shop.n' || s_nationkey || '.s' || s_suppkey AS mod FROM supplier),
n AS (SELECT n_nationkey AS n, 'shop.n' || n_nationkey AS pkg, 'shop.n' || n_nationkey || '.base' AS base FROM nation) """


def _edges(s, d, kind):
    return project_tables(s, d).edges_of(kind).select("src", "dst")


@query(_P + """SELECT src, dst FROM (SELECT mod AS dst, unnest(['shop', pkg, pkg || '.base', 'shop.n' || m]) AS src FROM s UNION SELECT pkg, unnest(['shop', base]) FROM n)""", base=False)
def parsed_imported_by(s, d):
    """Importing a module counts for its packages; `from . import base` for the module it names."""
    return _edges(s, d, "imported_by")


@query(_P + """SELECT 'shop' AS src, pkg AS dst FROM n UNION SELECT pkg, base FROM n UNION SELECT pkg, mod FROM s UNION SELECT 'space', 'space.n' || n FROM n UNION SELECT 'space.n' || n, 'space.n' || n || '.part' FROM n""", base=False)
def parsed_submodules(s, d):
    return _edges(s, d, "submodules")


@query(_P + """SELECT mod AS src, unnest([pkg || '.base', pkg || '.base.Base' || n, pkg || '.base.make' || n, 'shop.n' || m || '.base.Base' || m]) AS dst FROM s UNION ALL SELECT pkg, base || '.Base' || n FROM n""", base=False)
def parsed_imports(s, d):
    return _edges(s, d, "imports")


@query(_P + "SELECT mod AS src, unnest(['os', 'missing_' || (k % 3)]) AS target FROM s", base=False)
def parsed_unresolved_imports(s, d):
    return project_tables(s, d).unresolved_of("imports").select("src", "target").distinct()


@query(_P + """SELECT mod || '.Problem' || k || '.of' AS src, unnest([pkg || '.base.make' || n, mod || '.Problem' || k || '.of']) AS dst FROM s UNION ALL SELECT mod || '.use' || k, mod || '.Item' || k FROM s
UNION ALL SELECT base || unnest(['.Root', '.Right']) || n || '.run', base || '.Root' || n || '.stop' FROM n UNION ALL SELECT base || '.Root' || n || '.stop', base || '.make' || n FROM n UNION ALL SELECT base || '.make' || n, base || '.Base' || n FROM n""", base=False)
def parsed_callees(s, d):
    """`make` is called by two names and counted once; an inherited member is its definer's."""
    return _edges(s, d, "callees")


@query(_P + """SELECT mod || '.Problem' || k || '.of' AS src, 1::BIGINT AS sites FROM s""", base=False)
def parsed_unresolved_calls(s, d):
    return project_tables(s, d).unresolved_of("callees").groupBy("src").agg(F.count("*").alias("sites"))


_CLS = """, c AS (SELECT base || '.Root' || n AS handle, [] AS up FROM n UNION ALL SELECT base || '.Left' || n, [base || '.Root' || n] FROM n UNION ALL SELECT base || '.Right' || n, [base || '.Root' || n] FROM n
UNION ALL SELECT base || '.Base' || n, [base || '.Left' || n, base || '.Right' || n] FROM n UNION ALL SELECT mod || '.Item' || k, [pkg || '.base.Base' || n, 'shop.n' || m || '.base.Base' || m] FROM s
UNION ALL SELECT mod || '.Problem' || k, ['Exception'] FROM s) """


@query(_P + _CLS + "SELECT handle, array_to_string(up, ',') AS superclasses FROM c", base=False)
def parsed_superclasses(s, d):
    """As inspect shows them: in their order, those outside the project as they are written."""
    t = project_tables(s, d)
    x = resolve.details(t["nodes"], t["bases"], t["type_refs"]).where("kind = 'class'")
    return x.select("handle", F.array_join("superclasses", ",").alias("superclasses"))


@query(_P + """, four AS (SELECT n, [base || '.Base' || n, base || '.Left' || n, base || '.Right' || n, base || '.Root' || n] AS l FROM n),
o AS (SELECT l[1] AS handle, l FROM four UNION ALL SELECT l[2], [l[2], l[4]] FROM four UNION ALL SELECT l[3], [l[3], l[4]] FROM four UNION ALL SELECT mod || '.Item' || k, [mod || '.Item' || k] || a.l || b.l FROM s JOIN four a ON a.n = s.n JOIN four b ON b.n = s.m)
SELECT handle, array_to_string(l, ',') AS mro FROM o""", base=False)
def parsed_mro(s, d):
    """C3 over diamonds."""
    b = project_tables(s, d)["bases"].where("dst IS NOT NULL").select(F.col("owner").alias("child"), "ord", F.col("dst").alias("parent"))
    x = hierarchy.resolution_orders(b).groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("l"))
    return x.select("handle", F.array_join(F.transform("l", lambda y: y["name"]), ",").alias("mro"))


@query(_P + """, p AS (SELECT base || '.Root' || n || '.run' AS handle, unnest([{'i': 0, 'a': 'self', 'k': 'positional', 't': '', 'd': ''}, {'i': 1, 'a': 'a', 'k': 'positional', 't': '', 'd': ''},
  {'i': 2, 'a': 'b', 'k': 'positional_or_keyword', 't': 'int', 'd': '1'}, {'i': 3, 'a': 'args', 'k': 'var_positional', 't': '', 'd': ''}, {'i': 4, 'a': 'c', 'k': 'keyword_only', 't': '''list[Root' || n || '] | None''', 'd': 'None'},
  {'i': 5, 'a': 'kw', 'k': 'var_keyword', 't': '', 'd': ''}], recursive := true) FROM n
UNION ALL SELECT base || '.Right' || n || '.run', 0, 'self', 'positional_or_keyword', '', '' FROM n
UNION ALL SELECT base || '.Base' || n || '.__init__', unnest([{'i': 0, 'a': 'self', 'k': 'positional_or_keyword', 't': '', 'd': ''}, {'i': 1, 'a': 'size', 'k': 'positional_or_keyword', 't': 'int', 'd': ''}, {'i': 2, 'a': 'name', 'k': 'positional_or_keyword', 't': '', 'd': '''x'''}], recursive := true) FROM n
UNION ALL SELECT mod || '.Problem' || k || '.of', unnest([{'i': 0, 'a': 'cls', 'k': 'positional_or_keyword', 't': '', 'd': ''}, {'i': 1, 'a': 'item', 'k': 'positional_or_keyword', 't': 'Item' || k, 'd': ''}, {'i': 2, 'a': 'others', 'k': 'positional_or_keyword', 't': 'dict[str, Item' || k || ']', 'd': '{}'}], recursive := true) FROM s
UNION ALL SELECT mod || '.use' || k, 0, 'x', 'positional_or_keyword', 'int', '' FROM s)
SELECT handle, i AS place, a AS name, k AS kind, nullif(t, '') AS type, nullif(d, '') AS "default" FROM p""", base=False)
def parsed_parameters(s, d):
    """A default that is no plain literal is left out."""
    t = project_tables(s, d)
    x = resolve.details(t["nodes"], t["bases"], t["type_refs"])
    return x.select("handle", F.posexplode("parameters").alias("place", "p")).select("handle", "place", "p.*")


@query(_P + """SELECT base || '.Root' || n || '.run' AS handle, false AS is_async, false AS is_classmethod, false AS is_staticmethod, 'run(self, a, /, b: int=1, *args, c: ''list[Root' || n || '] | None''=None, **kw) -> ''Root' || n || '''' AS signature FROM n
UNION ALL SELECT base || '.Root' || n || '.stop', false, false, true, 'stop()' FROM n UNION ALL SELECT base || '.Right' || n || '.run', true, false, false, 'run(self)' FROM n
UNION ALL SELECT base || '.Base' || n || '.__init__', false, false, false, '__init__(self, size: int, name=''x'')' FROM n UNION ALL SELECT base || '.make' || n, false, false, false, 'make' || n || '()' FROM n
UNION ALL SELECT mod || '.Problem' || k || '.of', false, true, false, 'of(cls, item: Item' || k || ', others: dict[str, Item' || k || ']={}) -> Own' FROM s UNION ALL SELECT mod || '.use' || k, false, false, false, 'use' || k || '(x: int=len(''a''))' FROM s""", base=False)
def parsed_functions(s, d):
    t = project_tables(s, d)
    x = resolve.details(t["nodes"], t["bases"], t["type_refs"]).where("kind IN ('function', 'method')")
    return x.select("handle", "is_async", "is_classmethod", "is_staticmethod", "signature")


@query(_P + """SELECT handle, is_package, regexp_extract(handle, '^(.*)\\.', 1) AS package, file FROM (SELECT 'shop' AS handle, true AS is_package, '/p/shop/__init__.py' AS file UNION ALL SELECT pkg, true, '/p/shop/n' || n || '/__init__.py' FROM n UNION ALL SELECT base, false, '/p/shop/n' || n || '/base.py' FROM n
UNION ALL SELECT mod, false, '/p/shop/n' || n || '/s' || k || '.py' FROM s UNION ALL SELECT 'space', true, '/p/space' UNION ALL SELECT 'space.n' || n, true, '/p/space/n' || n FROM n UNION ALL SELECT 'space.n' || n || '.part', false, '/p/space/n' || n || '/part.py' FROM n)""".replace("\\\\", "\\"), base=False)
def parsed_modules(s, d):
    """Namespace packages are anchored at their directory; a file that can't be parsed is no module."""
    t = project_tables(s, d)
    x = resolve.details(t["nodes"], t["bases"], t["type_refs"]).where("kind = 'module'")
    return x.select("handle", "is_package", F.coalesce("package", F.lit("")).alias("package"), "file")


@query(_P + """SELECT base || '.Root' || n || '.run' AS owner, unnest(['return', 'b', 'c', 'c', 'c', 'c']) AS name, unnest(['0', '0', '0', '0.0', '0.0.0', '0.1']) AS path,
  unnest(['Root' || n, 'int', 'list[Root' || n || '] | None', 'list[Root' || n || ']', 'Root' || n, 'None']) AS raw, unnest([base || '.Root' || n, NULL, NULL, NULL, base || '.Root' || n, NULL]) AS handle FROM n
UNION ALL SELECT base || '.Base' || n || '.__init__', 'size', '0', 'int', NULL FROM n UNION ALL SELECT base || '.Root' || n, 'count', '0', 'int', NULL FROM n UNION ALL SELECT mod || '.use' || k, 'x', '0', 'int', NULL FROM s
UNION ALL SELECT mod || '.Problem' || k || '.of', unnest(['return', 'item', 'others', 'others', 'others']), unnest(['0', '0', '0', '0.0', '0.1']), unnest(['Own', 'Item' || k, 'dict[str, Item' || k || ']', 'str', 'Item' || k]),
  unnest([pkg || '.base.Base' || n, mod || '.Item' || k, NULL, NULL, mod || '.Item' || k]) FROM s""", base=False)
def parsed_type_refs(s, d):
    """Heads of annotations as handles, through aliases of imports."""
    return project_tables(s, d)["type_refs"].select("owner", "name", "path", "raw", "handle")


@query(_P + """SELECT '/p/shop/n' || n || '/base.py' AS file, base || '.Base' || n AS handle, 'class' AS kind, base || '.Left' || n || ',' || base || '.Right' || n AS base_classes,
  base || '.Base' || n || ',' || base || '.Left' || n || ',' || base || '.Right' || n || ',' || base || '.Root' || n || ',builtins.object' AS mro, '__init__' AS methods FROM n
UNION ALL SELECT '/p/shop/n' || n || '/s' || k || '.py', mod || '.use' || k, 'function', NULL, NULL, NULL FROM s""", base=False)
def parsed_type_info(s, d):
    """What stands at the names of all Base classes and of all use functions."""
    t = project_tables(s, d)
    at = F.when(F.col("kind") == "class", 7).otherwise(5).alias("column")  # the second character of the name
    asked = t["nodes"].where("(kind = 'class' AND handle LIKE '%.Base%') OR (kind = 'function' AND handle LIKE '%.use%')").select("file", F.col("line_start").alias("line"), at)
    x = resolve.type_info(asked, t["occurrences"], t["nodes"], t["bases"], t["edges"])
    return x.select("file", "handle", "kind", *[F.array_join(c, ",").alias(c) for c in ("base_classes", "mro", "methods")])


@query(_P + """SELECT 'shop' AS handle, 0 AS depth, NULL AS truncation_reason, false AS leaf, 0 AS place UNION ALL SELECT pkg, 1, 'max_depth', false, (row_number() OVER (ORDER BY pkg) - 1)::INTEGER FROM n""", base=False)
def parsed_outline_survey(s, d):
    """A package is surveyed one level deep: its packages have more below."""
    t = project_tables(s, d)
    return traverse.outline(t["nodes"], t["edges"], "shop").select("handle", "depth", "truncation_reason", "leaf", "place")


@query(_P + """SELECT base AS handle, 0 AS depth, 0 AS place FROM n WHERE n = 0 UNION ALL SELECT base || '.' || unnest(['Root0', 'Left0', 'Right0', 'Base0', 'make0']), 1, unnest([0, 1, 2, 3, 4]) FROM n WHERE n = 0
UNION ALL SELECT base || '.' || unnest(['Root0.count', 'Root0.run', 'Root0.stop', 'Right0.run', 'Base0.__init__']), 2, unnest([0, 1, 2, 0, 0]) FROM n WHERE n = 0""", base=False)
def parsed_outline_module(s, d):
    t = project_tables(s, d)
    return traverse.outline(t["nodes"], t["edges"], "shop.n0.base").select("handle", "depth", "place")


@query("SELECT 'base' AS asked, 'unsupported' AS what, 'wrong_kind' AS value UNION ALL SELECT 'gone', 'stubs', '0' UNION ALL SELECT 'gone', 'unresolved_imports', 'not measured' UNION ALL SELECT 'broken', 'unresolved_imports', 'not measured' UNION ALL SELECT 'shop', 'unresolved_imports', '' UNION ALL SELECT 'gone', 'unresolved_call_sites', '0' UNION ALL SELECT 'root', 'transitive_hint', 'given' UNION ALL SELECT 'callers', 'unsupported', 'deferred_reference_backend' UNION ALL SELECT 'nonsense', 'unsupported', 'unknown_edge'", base=False)
def parsed_expand_null_rules(s, d):
    """What is not measured is absent, what is measured and empty is empty, what is refused says why."""
    t = project_tables(s, d)
    ask = lambda h, e: traverse.expand(t["nodes"], t["edges"], t["unresolved"], h, e)
    imports = lambda h: (lambda x: "not measured" if x is None else ",".join(r[0] for r in x.collect()))(ask(h, "imports").unresolved_imports)
    rows = [
        ("base", "unsupported", ask("shop.n0.base.Base0", "imports").unsupported), ("gone", "stubs", str(ask("no.such", "members").stubs.count())),
        ("gone", "unresolved_imports", imports("no.such")), ("broken", "unresolved_imports", imports("broken")), ("shop", "unresolved_imports", imports("shop")),
        ("gone", "unresolved_call_sites", str(ask("no.such", "callees").unresolved_call_sites.first()[0])), ("root", "transitive_hint", "given" if ask("shop.n0.base.Root0", "subclasses").transitive_hint else "none"),
        ("callers", "unsupported", ask("shop", "callers").unsupported), ("nonsense", "unsupported", ask("shop", "nonsense").unsupported),
    ]
    return s.createDataFrame(rows, "asked string, what string, value string")


@query(_P + """SELECT mod AS module, unnest(['os', 'missing_' || (k % 3), 'base', 'shop.n' || m]) AS name FROM s UNION ALL SELECT mod, 'base' FROM s WHERE false UNION ALL SELECT pkg, 'base' FROM n""", base=False)
def parsed_written_imports(s, d):
    """The second derivation of imports, from what is written alone."""
    return dependencies.written_imports(project_tables(s, d)["imports"])


@query(_P + """SELECT mod AS module, 'Item' || k || ',Problem' || k AS classes, 'use' || k AS functions, 'missing_' || (k % 3) || ',os,shop' AS imports_from, 23 AS lines FROM s""", base=False)
def parsed_module_profile(s, d):
    t = project_tables(s, d)
    defs = of(t["facts"], "def").where("parent = module").select("module", "name", "kind", F.col("flag").alias("is_async"))
    imports = of(t["facts"], "import").select("module", F.coalesce("target", F.lit("")).alias("target"), "level")
    files = of(t["facts"], "file").select("module", F.col("end_line").alias("lines"), F.lit(False).alias("has_tests"))
    x = dependencies.module_profile(defs, imports, files).where("module LIKE 'shop.n%.s%'")
    return x.select("module", *[F.array_join(c, ",").alias(c) for c in ("classes", "functions", "imports_from")], "lines")


@query(_P + "SELECT 'space' AS name, 'space' AS handle, '/p/space' AS file", base=False)
def namespace_anchor(s, d):
    """Of three bare names only the namespace package has a directory to stand for it."""
    files = project(s, d).select(F.lit("/p").alias("root"), F.lit(0).alias("root_rank"), F.substring("file", 4, 1000).alias("path"))
    asked = s.createDataFrame([("space",), ("shop",), ("nothing",)], "name string")
    return resolve.namespace_anchor(asked, catalog.namespace_packages(files))


@query("SELECT 'lib' || (p_partkey % 7) || '.P' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'lib.core.P' || p_partkey ELSE 'lib' || (p_partkey % 7) || '.P' || p_partkey END AS handle, 'class' AS kind FROM part WHERE p_size > 10", base=False)
def external_names(s, d):
    """Dotted names outside the project, by a table of what installed packages define and re-export."""
    k = F.col("p_partkey").cast("string")
    p = g.read(s, d, "part").select("p_size", F.concat(F.lit("lib"), (F.col("p_partkey") % 7).cast("string")).alias("module"), F.concat(F.lit("P"), k).alias("leaf"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("lib.core.P"), k)).alias("target"))
    stubs = p.where("p_size > 10").select("module", "leaf", "target", F.lit("class").alias("kind"))
    return resolve.external_names(p.select(F.concat_ws(".", "module", "leaf").alias("name")), stubs)


@query(_P + "SELECT handle, count(*) OVER () AS n FROM (SELECT unnest(['shop.n0.base.Base0', 'shop.n0.base.Left0', 'shop.n0.base.Right0']) AS handle FROM n WHERE n = 0 UNION ALL SELECT mod || '.Item' || k FROM s WHERE n = 0 OR m = 0)", base=False)
def parsed_subclasses(s, d):
    """All classes below one, across modules and re-exports."""
    b = project_tables(s, d)["bases"].where("dst IS NOT NULL").select(F.col("owner").alias("child"), F.col("dst").alias("parent"))
    x = hierarchy.subclasses(b, "shop.n0.base.Root0").select("handle")
    return x.withColumn("n", F.lit(x.count()).cast("long"))


@query("SELECT 'src.s' || s_suppkey || '.Model' || s_suppkey AS full_name, true AS is_model FROM supplier UNION ALL SELECT 'src.s' || s_suppkey || '.helper', false FROM supplier", base=False)
def plugin_symbols(s, d):
    """Symbol results with what the active plugins add."""
    from .plans.rendered import facts

    f = facts(s, d)
    active = plugins.activate(f)
    hits = of(f, "def").where("name = 'helper' OR name LIKE 'Model%'").select("name", "full_name")
    return plugins.augmented(hits, f, active).select("full_name", "is_model")


@query("SELECT 'find_flask_routes' AS component, count(*) AS files FROM supplier", base=False)
def plugin_components(s, d):
    from .plans.rendered import facts

    f = facts(s, d)
    flask = next(p for p in plugins.activate(f) if p.name == "flask")
    return flask.components(f).where("component = 'find_flask_routes'").groupBy("component").agg(F.count_distinct("file").alias("files"))


_CALLS = "WITH calls AS (SELECT event_type AS name, user_id AS key, event_id AS seq, ts, value AS duration_ms, CASE WHEN floor(value)::BIGINT % 3 = 0 THEN 'E_' || event_type END AS error FROM events) "


@query(_CALLS + ", h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM calls WHERE error IS NOT NULL) SELECT key, count(*) AS held, count(DISTINCT error) AS kinds, string_agg(error, ',' ORDER BY seq) FILTER (r <= 10) AS recent_errors FROM h WHERE r <= 100 GROUP BY key", base=False)
def error_report(s, d):
    return diagnostics.error_report(g.calls(s, d)).withColumn("recent_errors", F.array_join("recent_errors", ","))


@query("SELECT user_id AS connection, min(ts) AS start_time, date_diff('microsecond', min(ts), TIMESTAMP '2030-01-01') / 1e6 AS uptime_seconds, date_diff('microsecond', max(ts), TIMESTAMP '2030-01-01') / 1e6 AS idle_seconds, count(*) AS total_events, arg_max(event_type, (ts, event_type)) <> 'shutdown' AS alive FROM events GROUP BY 1", base=False)
def connection_summary(s, d):
    e = g.read(s, d, "events").select(F.col("user_id").alias("connection"), "ts", F.col("event_type").alias("event"))
    return diagnostics.connection_summary(e, "2030-01-01 00:00:00").drop("recent_events")


@query("SELECT s_suppkey, '/w/a/f' || s_suppkey || '.py' AS key, true AS same FROM supplier", base=False)
def path_keys(s, d):
    """Four ways to write a path."""
    k = F.col("s_suppkey").cast("string")
    ways = [F.concat(F.lit("a/f"), k, F.lit(".py")), F.concat(F.lit("a\\x\\..\\f"), k, F.lit(".py")), F.concat(F.lit("/w//./a/f"), k, F.lit(".py")), F.concat(F.lit("../w/a/./f"), k, F.lit(".py"))]
    written = F.element_at(F.array(*ways), (F.col("s_suppkey") % 4 + 1).cast("int"))
    x = g.read(s, d, "supplier").select("s_suppkey", scalar.path_key(written, "/w").alias("key"), scalar.same_path(written, F.concat(F.lit("./a/f"), k, F.lit(".py")), "/w").alias("same"))
    return x


@query(_CALLS + "SELECT name, count(*) AS \"count\", count(error) AS errors FROM calls GROUP BY name", base=False)
def metrics_json(s, d):
    """Written as JSON documents and read from them."""
    j = metrics.as_json(metrics.duration_stats(g.calls(s, d)))
    x = F.from_json("json", "name string, count long, errors long")
    return j.select(x.alias("x")).select("x.*")


@query("SELECT doc_id AS id, doc_id % 3 <> 0 AS corroborated FROM documents", base=False)
def corroborated_imports(s, d):
    """Findings about imports hold if what is written says so too."""
    f = g.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("shop.n0").alias("module"), F.when(F.col("doc_id") % 3 == 0, "json").otherwise("base").alias("target"))
    ok = review.corroborated_by_imports(f, dependencies.written_imports(project_tables(s, d)["imports"]))
    return f.join(ok.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left").select("id", F.col("_i").isNotNull().alias("corroborated"))
