"""Registered queries of the engine and the SQL that states their results, over the relational binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import dependencies, hierarchy, metrics, resolve, review, tables, traverse
from .plans import relational as g
from .plans.registry import registry
from .streaming import changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the SQL of most queries begins with.
BASE = r"""
m AS (
  SELECT n_nationkey, regexp_replace(r_name, '[^A-Za-z0-9_]', '_', 'g') AS region,
    regexp_replace(r_name, '[^A-Za-z0-9_]', '_', 'g') || '.' || regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS module
  FROM nation JOIN region ON n_regionkey = r_regionkey
), cls AS (
  SELECT module, module || '.C' || c_custkey AS handle, c_custkey AS ord, c_custkey AS custkey FROM customer JOIN m ON c_nationkey = n_nationkey
  UNION ALL SELECT module, module || '.S' || s_suppkey, s_suppkey + (1::BIGINT << 40), NULL FROM supplier JOIN m ON s_nationkey = n_nationkey
), met AS (
  SELECT c.handle AS class, c.handle || '.O' || o_orderkey AS handle, o_orderkey AS orderkey FROM orders JOIN cls c ON o_custkey = custkey
), nodes AS (
  SELECT DISTINCT region AS handle, 'module' AS kind, 'project' AS scope FROM m UNION ALL SELECT module, 'module', 'project' FROM m
  UNION ALL SELECT handle, 'class', 'project' FROM cls UNION ALL SELECT handle, 'method', 'project' FROM met
  UNION ALL SELECT 'PARTS.P' || p_partkey, 'class', 'external' FROM part
), sites AS (
  SELECT t.handle AS src, l_linenumber, l_partkey, p_size > 25 AS resolvable FROM lineitem JOIN part ON l_partkey = p_partkey JOIN met t ON l_orderkey = t.orderkey
), callees AS (
  SELECT src, 'PARTS.P' || l_partkey AS dst, min(l_linenumber::BIGINT * 4294967296 + l_partkey) AS ord FROM sites WHERE resolvable GROUP BY src, l_partkey
), imp AS (
  SELECT DISTINCT a.module, b.module AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN m a ON c_nationkey = a.n_nationkey JOIN m b ON s_nationkey = b.n_nationkey
), bas AS (
  SELECT 'PARTS.P' || p_partkey AS child, 'PARTS.P' || (p_partkey // 2) AS parent, p_partkey AS ord FROM part WHERE p_partkey > 1
), calls AS (
  SELECT event_type AS name, user_id AS key, event_id AS seq, ts, value AS duration_ms, CASE WHEN floor(value)::BIGINT % 3 = 0 THEN 'E_' || event_type END AS error FROM events
)
"""


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with its SQL if SQL can state it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + BASE + ("," + sql.strip()[4:] if sql.strip().startswith("AND ") else sql) if base else sql)
        return f

    return add


# --- edges -----------------------------------------------------------------------------------------------------------


def _ordered(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "ord")


@query("SELECT module AS src, handle AS dst, ord FROM cls UNION ALL SELECT class, handle, orderkey FROM met")
def expand_members(s: SparkSession, d: str) -> DataFrame:
    return _ordered(g.members(s, d))


@query("SELECT region AS src, module AS dst, n_nationkey::BIGINT AS ord FROM m")
def expand_submodules(s, d):
    return _ordered(g.submodules(s, d))


@query("SELECT handle AS src, module AS dst, 0::BIGINT AS ord FROM cls UNION ALL SELECT handle, class, 0 FROM met")
def expand_enclosing_scope(s, d):
    return _ordered(g.enclosing(s, d))


@query("SELECT src, dst, ord FROM callees")
def expand_callees(s, d):
    return _ordered(g.callees(s, d))


@query("SELECT t.handle AS src, count(*) FILTER (NOT resolvable) AS unresolved_call_sites FROM met t LEFT JOIN sites ON src = t.handle GROUP BY t.handle")
def unresolved_call_sites(s, d):
    """0 is measured and empty: every method has a row."""
    n = g.unresolved(s, d).groupBy("src").agg(F.count("*").alias("n"))
    return g.methods(s, d).select(F.col("handle").alias("src")).join(n, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("unresolved_call_sites"))


@query("SELECT module AS src, target AS dst FROM imp")
def expand_imports(s, d):
    return g.imports(s, d).select("src", "dst")


@query("SELECT DISTINCT k.module AS src, i.module AS dst FROM imp i JOIN (SELECT module FROM m UNION SELECT region FROM m) k ON (i.target = k.module OR starts_with(i.target, k.module || '.')) AND i.module <> k.module")
def expand_imported_by(s, d):
    """Importing a nation counts as importing its region."""
    i = g.nation_imports(s, d).select("module", "target", F.lit(None).cast("string").alias("name"))
    m = g.modules(s, d)
    return dependencies.imported_by(i, m.select("module").union(m.select("region")).distinct())


@query("SELECT child, parent FROM bas")
def superclasses(s, d):
    n = g.read(s, d, "part").select(g.part_handle(F.col("p_partkey")).alias("handle"), F.lit("class").alias("kind"))
    return hierarchy.superclasses(g.bases(s, d), n).select(F.col("src").alias("child"), F.col("dst").alias("parent"))


@query("SELECT child AS handle FROM bas WHERE parent = 'PARTS.P3'")
def subclasses_direct(s, d):
    return hierarchy.subclasses(g.bases(s, d), "PARTS.P3", indirect=False).select("handle")


@query("AND down AS (SELECT child AS handle, 1 AS depth FROM bas WHERE parent = 'PARTS.P3' UNION ALL SELECT child, depth + 1 FROM down JOIN bas ON parent = down.handle) SELECT handle, depth = 1 AS is_direct, depth FROM down")
def subclasses_closure(s, d):
    return hierarchy.subclasses(g.bases(s, d), "PARTS.P3")


@query("AND up AS (SELECT child AS root, parent AS handle, 1 AS depth FROM bas UNION ALL SELECT root, parent, depth + 1 FROM up JOIN bas ON child = up.handle) SELECT root, handle, depth FROM up")
def ancestors_closure(s, d):
    b = g.bases(s, d)
    return hierarchy.closure(b.select(F.col("parent").alias("child"), F.col("child").alias("parent")))


@query("AND up AS (SELECT child AS root, parent AS handle, 1 AS depth FROM bas UNION ALL SELECT root, parent, depth + 1 FROM up JOIN bas ON child = up.handle) SELECT DISTINCT root AS handle, 0 AS ord, root AS name FROM up UNION ALL SELECT root, depth, handle FROM up")
def method_resolution_order(s, d):
    b = g.bases(s, d)
    return hierarchy.resolution_orders(b.select("child", F.lit(0).alias("ord"), "parent"))


@query(
    """SELECT edge, status FROM (VALUES ('members', 'implemented'), ('callees', 'implemented'), ('imports', 'implemented'), ('imported_by', 'implemented'), ('subclasses', 'implemented'),
  ('superclasses', 'implemented'), ('enclosing_scope', 'implemented'), ('submodules', 'implemented'), ('callers', 'deferred_reference_backend'), ('references', 'deferred_reference_backend'),
  ('read_by', 'deferred_reference_backend'), ('written_by', 'deferred_reference_backend'), ('passed_by', 'deferred_reference_backend'), ('overrides', 'deferred_reference_backend'),
  ('overridden_by', 'deferred_reference_backend'), ('decorated_by', 'deferred_reference_backend'), ('decorates', 'deferred_reference_backend')) t(edge, status)""",
    base=False,
)
def edge_registry(s, d):
    return registry(s)


# --- traversal -------------------------------------------------------------------------------------------------------

_TREE = """AND lev AS (SELECT 'PARTS.P1' AS handle, 0 AS depth UNION ALL SELECT child, depth + 1 FROM lev JOIN bas ON parent = handle WHERE depth < 4),
ranked AS (SELECT handle, depth, row_number() OVER (ORDER BY depth, substr(handle, 8)::BIGINT) AS r FROM lev),
kept AS (SELECT handle, depth FROM ranked WHERE r <= 20) """


def _tree(s, d):
    b = g.inheritance(s, d).where("kind = 'subclasses'")
    n = g.read(s, d, "part").select(g.part_handle(F.col("p_partkey")).alias("handle"), F.lit("class").alias("kind"), F.lit("external").alias("scope"))
    none = s.createDataFrame([], "src string, edge string, target string")
    return traverse.trace(n, b, none, ["PARTS.P1"], ["subclasses"], max_depth=4, max_nodes=20)


@query(_TREE + "SELECT handle, depth FROM kept")
def trace_nodes(s, d):
    return _tree(s, d).nodes.select("handle", "depth")


@query(_TREE + "SELECT parent AS \"from\", child AS \"to\", 'subclasses' AS kind FROM bas JOIN kept a ON a.handle = parent JOIN kept b ON b.handle = child")
def trace_edges(s, d):
    return _tree(s, d).edges


@query(_TREE + "SELECT true AS truncated, 'max_depth,max_nodes' AS reasons")
def trace_meta(s, d):
    meta = _tree(s, d).meta
    return s.createDataFrame([(meta["truncated"], ",".join(meta["truncation_reasons"]))], "truncated boolean, reasons string")


_WIDE = """AND start AS (SELECT class AS handle FROM met ORDER BY substr(class, strpos(class, '.C') + 2)::BIGINT LIMIT 1),
l1 AS (SELECT t.handle FROM met t JOIN start s ON t.class = s.handle), l2 AS (SELECT DISTINCT dst AS handle FROM callees JOIN l1 ON src = l1.handle),
allnodes AS (SELECT handle, 0 AS depth FROM start UNION ALL SELECT handle, 1 FROM l1 UNION ALL SELECT handle, 2 FROM l2) """


def _wide(s, d):
    n, e = g.graph(s, d, g.members, g.callees)
    first = g.methods(s, d).select("class").distinct().orderBy(F.substring_index("class", ".C", -1).cast("long")).first()
    return traverse.trace(n, e, g.unresolved(s, d), [first[0]] if first else [], ["members", "callees"], max_depth=2, max_nodes=100_000)


@query(_WIDE + "SELECT handle, depth FROM allnodes")
def trace_members_callees(s, d):
    return _wide(s, d).nodes.select("handle", "depth")


@query(_WIDE + "SELECT src, count(*) AS unresolved_call_sites FROM sites JOIN allnodes ON src = handle WHERE NOT resolvable GROUP BY src")
def trace_unresolved(s, d):
    return _wide(s, d).unresolved_call_sites


@query("AND reg AS (SELECT min(region) AS handle FROM m), t AS (SELECT handle, 0 AS depth FROM reg UNION ALL SELECT module, 1 FROM m JOIN reg ON region = reg.handle) SELECT t.handle, depth, 'module' AS node_kind FROM t")
def outline_packages(s, d):
    """A package root is surveyed by submodules, one level deep."""
    root = g.modules(s, d).agg(F.min("region")).first()[0]
    n = g.nodes(s, d).where("kind = 'module'")
    return traverse.outline(n, g.submodules(s, d), root, max_depth=1, kind="submodules").select("handle", "depth", "node_kind")


@query("AND c AS (SELECT class AS handle FROM met ORDER BY substr(class, strpos(class, '.C') + 2)::BIGINT LIMIT 1) SELECT handle, 0 AS depth, 'class' AS node_kind, false AS leaf FROM c UNION ALL SELECT t.handle, 1, 'method', true FROM met t JOIN c ON t.class = c.handle")
def outline_members(s, d):
    first = g.methods(s, d).select("class").distinct().orderBy(F.substring_index("class", ".C", -1).cast("long")).first()
    return traverse.outline(*g.graph(s, d, g.members), first[0] if first else "", max_depth=3).select("handle", "depth", "node_kind", "leaf")


@query()
def outline_budget(s, d):
    """The budget is a sequential fold, which SQL can't state; tests hold it against a model."""
    n = g.read(s, d, "part").select(g.part_handle(F.col("p_partkey")).alias("handle"), F.lit("class").alias("kind"), F.lit("project").alias("scope"))
    return traverse.outline(n, g.inheritance(s, d).where("kind = 'subclasses'"), "PARTS.P1", max_depth=5, max_nodes=20, kind="subclasses")


# --- names -----------------------------------------------------------------------------------------------------------


def _defs(s, d):
    n = g.nodes(s, d)
    return n.select(scalar.leaf(F.col("handle")).alias("name"), F.col("handle").alias("full_name"))


def _files(s, d):
    h = F.col("handle")
    return g.nodes(s, d).withColumn("file", F.concat(F.when(F.col("kind") == "module", F.replace(h, F.lit("."), F.lit("/"))).otherwise(F.replace(scalar.parent(h), F.lit("."), F.lit("/"))), F.lit(".py"))).withColumn("line_start", F.lit(1))


@query(
    """AND asked AS (SELECT DISTINCT 'C' || c_custkey AS name FROM customer UNION SELECT 'S' || s_suppkey FROM supplier UNION SELECT 'P' || p_partkey FROM part UNION SELECT 'NATION_0' UNION SELECT 'NOTHING'),
  h AS (SELECT regexp_extract(handle, '[^.]*$') AS leaf, handle FROM nodes)
  SELECT name, count(handle) = 1 AS found, count(handle) > 1 AS ambiguous, CASE WHEN count(handle) = 1 THEN max(handle) END AS handle, count(handle) AS n, CASE WHEN count(handle) = 0 THEN 'unresolved' END AS reason
  FROM asked LEFT JOIN h ON leaf = name GROUP BY name"""
)
def resolve_bare(s, d):
    r = lambda t, c, p: g.read(s, d, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("name"))
    asked = r("customer", "c_custkey", "C").union(r("supplier", "s_suppkey", "S")).union(r("part", "p_partkey", "P")).union(s.createDataFrame([("NATION_0",), ("NOTHING",)], "name string")).distinct()
    return resolve.bare_names(asked, _defs(s, d), _files(s, d))


@query("AND a AS (SELECT module || '.Item' AS handle, 'project' AS scope, module || '.py' AS file, n_nationkey % 3 AS line FROM m UNION ALL SELECT 'lib' || p_partkey || '.Item', 'external', 'lib.py', p_size FROM part WHERE p_size = 1) SELECT handle, row_number() OVER (ORDER BY CASE scope WHEN 'project' THEN 0 ELSE 1 END, file, line, handle) AS place FROM a")
def resolve_ambiguous_order(s, d):
    """What the name Item may mean, in the order that candidates come in."""
    own = g.modules(s, d).select(F.concat("module", F.lit(".Item")).alias("handle"), F.lit("project").alias("scope"), F.concat("module", F.lit(".py")).alias("file"), (F.col("n_nationkey") % 3).cast("int").alias("line_start"))
    lib = g.read(s, d, "part").where("p_size = 1").select(F.concat(F.lit("lib"), F.col("p_partkey").cast("string"), F.lit(".Item")).alias("handle"), F.lit("external").alias("scope"), F.lit("lib.py").alias("file"), F.col("p_size").cast("int").alias("line_start"))
    nodes = own.unionByName(lib)
    defs = nodes.select(F.lit("Item").alias("name"), F.col("handle").alias("full_name"))
    rows = resolve.candidates("Item", defs, nodes).select("handle").collect()
    return s.createDataFrame([(r[0], i + 1) for i, r in enumerate(rows)], "handle string, place long")


@query("SELECT DISTINCT n_name AS file, l_linenumber AS line, (l_partkey % 100)::INTEGER AS \"column\", CASE WHEN l_partkey % 100 < 60 THEN 'H' || l_linenumber || '_' || (l_partkey % 100 // 20) END AS handle FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey", base=False)
def resolve_at(s, d):
    """Positions in lines that have a name at each of columns 0-19, 20-39 and 40-59, and nothing behind."""
    l = g.read(s, d, "lineitem").join(g.read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(g.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pos = l.select(F.col("n_name").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 100).cast("int").alias("column")).distinct()
    occ = pos.select("file", "line").distinct().select("file", "line", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    occ = occ.select("file", "line", (F.col("k") * 20).alias("col_start"), (F.col("k") * 20 + 20).alias("col_end"), F.concat(F.lit("H"), F.col("line").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("handle"))
    return resolve.resolve_at(pos, occ)


@query("AND ch AS (SELECT p_partkey AS a, p_partkey // 2 AS b, 1 AS n FROM part WHERE p_partkey > 1 UNION ALL SELECT a, b // 2, n + 1 FROM ch WHERE b > 1) SELECT 'PARTS.P' || a AS alias, 'PARTS.P1' AS handle, n AS hops FROM ch WHERE b = 1 AND n <= 20")
def canonicalize_chain(s, d):
    """Every part re-exports its half, until part 1 is reached, which is defined."""
    p = g.read(s, d, "part").where("p_partkey > 1")
    b = p.select(F.lit("PARTS").alias("module"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("surface"), g.part_handle(F.floor(F.col("p_partkey") / 2).cast("long")).alias("target"))
    return resolve.canonical(b, s.createDataFrame([("PARTS.P1",)], "handle string"))


@query("SELECT 'PARTS.P' || (p_partkey // 50 * 50) AS handle, count(*) AS n, min('PARTS.P' || p_partkey) AS first_alias FROM part WHERE p_partkey % 50 > 0 AND p_partkey > 50 GROUP BY 1", base=False)
def re_exports(s, d):
    """Parts re-export the fiftieth before them."""
    k = F.col("p_partkey")
    p, home = g.read(s, d, "part").where("p_partkey > 50 AND p_partkey % 50 > 0"), g.part_handle(F.floor(k / 50).cast("long") * 50)
    names = resolve.canonical(p.select(F.lit("PARTS").alias("module"), F.concat(F.lit("P"), k.cast("string")).alias("surface"), home.alias("target")), p.select(home.alias("handle")).distinct())
    return resolve.re_exports(names).select("handle", F.size("re_exports").cast("long").alias("n"), F.element_at("re_exports", 1).alias("first_alias"))


@query(
    """AND e AS (SELECT module AS src, 'members' AS kind FROM cls UNION ALL SELECT class, 'members' FROM met UNION ALL SELECT region, 'submodules' FROM m UNION ALL SELECT child, 'superclasses' FROM bas UNION ALL SELECT src, 'callees' FROM callees),
  n AS (SELECT handle, count(*) FILTER (e.kind = 'members') AS members, count(*) FILTER (e.kind = 'submodules') AS submodules, count(*) FILTER (e.kind = 'superclasses') AS superclasses, count(*) FILTER (e.kind = 'callees') AS callees FROM nodes LEFT JOIN e ON src = handle GROUP BY handle)
  SELECT n.handle, nodes.kind, CASE WHEN nodes.kind IN ('class', 'module') THEN members END AS members, CASE WHEN submodules > 0 THEN submodules END AS submodules,
    CASE WHEN nodes.kind = 'class' THEN superclasses END AS superclasses, CASE WHEN nodes.kind = 'method' THEN callees END AS callees FROM n JOIN nodes USING (handle)"""
)
def inspect_edge_counts(s, d):
    e = g.members(s, d).unionByName(g.submodules(s, d)).unionByName(g.inheritance(s, d)).unionByName(g.callees(s, d))
    return resolve.edge_counts(g.nodes(s, d), e)


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(
    """SELECT region AS package, list_aggregate(list_sort(list(DISTINCT module)), 'string_agg', ',') AS modules, count(DISTINCT module) AS n FROM m GROUP BY region"""
)
def package_profile(s, d):
    p = dependencies.package_profile(g.modules(s, d).select(F.col("region").alias("package"), F.col("module").alias("child"), F.lit(False).alias("is_package")))
    return p.select("package", F.array_join("modules", ",").alias("modules"), F.size("modules").cast("long").alias("n"))


@query(
    """AND c AS (SELECT module, count(*) AS n, list_aggregate(list_sort(list(regexp_extract(handle, '[^.]*$'))), 'string_agg', ',') AS names FROM cls GROUP BY module)
  SELECT m.module, coalesce(c.n, 0) AS classes, coalesce(names, '') AS exports, coalesce((SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT DISTINCT split_part(target, '.', 1) AS h FROM imp WHERE imp.module = m.module)), '') AS imports_from
  FROM m LEFT JOIN c ON c.module = m.module"""
)
def module_profile(s, d):
    defs = g.classes(s, d).select("module", scalar.leaf(F.col("handle")).alias("name"), F.lit("class").alias("kind"), F.lit(False).alias("is_async"))
    imports = g.nation_imports(s, d).withColumn("level", F.lit(0))
    files = g.modules(s, d).select("module", F.lit(1).alias("lines"), F.lit(False).alias("has_tests"))
    p = dependencies.module_profile(defs, imports, files)
    return p.select("module", F.size("classes").cast("long").alias("classes"), F.array_join("exports", ",").alias("exports"), F.array_join("imports_from", ",").alias("imports_from"))


@query(
    """AND d AS (SELECT DISTINCT module AS f, target AS t FROM imp WHERE module <> target)
  SELECT (SELECT count(DISTINCT x) FROM (SELECT f AS x FROM d UNION ALL SELECT t FROM d)) AS modules, (SELECT count(*) FROM d) AS edges, (SELECT count(*) FROM cls) AS symbols,
  (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM d GROUP BY f)) AS max_fan_out, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM d GROUP BY t)) AS max_fan_in"""
)
def dependency_stats(s, d):
    deps = dependencies.dependency_graph(g.nation_imports(s, d), g.modules(s, d).select("module"))
    return dependencies.dependency_stats(deps, g.classes(s, d).select(F.col("handle").alias("symbol")))


@query("AND c AS (SELECT module FROM m WHERE n_nationkey < 5) SELECT module AS changed, module FROM c UNION SELECT c.module, imp.module FROM c JOIN imp ON target = c.module WHERE imp.module <> imp.target")
def affected_modules(s, d):
    deps = dependencies.dependency_graph(g.nation_imports(s, d), g.modules(s, d).select("module"))
    return dependencies.affected_modules(deps, g.modules(s, d).where("n_nationkey < 5").select("module"))


@query(
    """AND u AS (SELECT DISTINCT b.module, 'P' || l_partkey AS symbol FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN m b ON s_nationkey = n_nationkey)
  SELECT u.module, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM u JOIN part ON symbol = 'P' || p_partkey WHERE p_size = 1 GROUP BY u.module"""
)
def affected_symbols(s, d):
    sup = g.read(s, d, "supplier").join(g.modules(s, d), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "module")
    used = g.read(s, d, "lineitem").select("l_suppkey", "l_partkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("module", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol")).distinct()
    changed = g.read(s, d, "part").where("p_size = 1").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    return dependencies.affected_symbols(changed, used).select("module", F.array_join("symbols", ",").alias("symbols"))


# --- metrics ---------------------------------------------------------------------------------------------------------

_STATS = """AND tail AS (SELECT name, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS r FROM calls) WHERE r <= 1000),
ring AS (SELECT name, list_sort(list(duration_ms)) AS l FROM tail GROUP BY name),
stats AS (SELECT name, count(*) AS n, count(error) AS errors, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round((sum(duration_ms::DECIMAL(18, 4)) / count(*))::DOUBLE, 3) AS avg_ms, round(sum(duration_ms::DECIMAL(18, 4)), 2)::DOUBLE AS total_ms FROM calls GROUP BY name) """


def _stats(s, d):
    return metrics.duration_stats(g.calls(s, d))


@query(
    _STATS
    + """SELECT name, n AS "count", errors, round(errors / (n + errors), 6) AS error_rate, avg_ms, min_ms, max_ms, l[least(floor(len(l) * 50 / 100), len(l) - 1)::INTEGER + 1] AS p50_ms,
  l[least(floor(len(l) * 95 / 100), len(l) - 1)::INTEGER + 1] AS p95_ms, l[least(floor(len(l) * 99 / 100), len(l) - 1)::INTEGER + 1] AS p99_ms, total_ms FROM stats JOIN ring USING (name)"""
)
def metric_percentiles(s, d):
    return _stats(s, d).select("name", "count", "errors", F.round("error_rate", 6).alias("error_rate"), F.round("avg_ms", 3).alias("avg_ms"), "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms", F.round("total_ms", 2).alias("total_ms"))


@query(_STATS + "SELECT CASE WHEN name LIKE '%symbol%' OR name LIKE '%find%' THEN 'symbol_search' WHEN name LIKE '%cache%' THEN 'cache_operations' WHEN name LIKE '%file%' OR name LIKE '%read%' OR name LIKE '%write%' THEN 'file_operations' ELSE 'other' END AS section, count(*) AS metrics, sum(n)::BIGINT AS operations, sum(errors)::BIGINT AS errors, round(sum(total_ms), 2) AS total_ms FROM stats GROUP BY 1")
def metric_report(s, d):
    return metrics.report(_stats(s, d)).withColumn("total_ms", F.round("total_ms", 2))


@query(_STATS + "SELECT name, max_ms FROM stats ORDER BY max_ms DESC, name LIMIT 3")
def slowest_operations(s, d):
    return metrics.top(_stats(s, d), "max_ms", 3)


@query(_STATS + """SELECT name, 0 AS ord, 'graphloom_operation_count{operation="' || replace(replace(name, '.', '_'), '-', '_') || '"} ' AS label, n::DOUBLE AS value FROM stats
UNION ALL SELECT name, i, 'graphloom_operation_duration_ms{operation="' || replace(replace(name, '.', '_'), '-', '_') || '",quantile="0.' || q || '"} ', l[least(floor(len(l) * p / 100), len(l) - 1)::INTEGER + 1] FROM ring, (VALUES (1, '5', 50), (2, '95', 95), (3, '99', 99)) t(i, q, p)""")
def prometheus_lines(s, d):
    """All four lines of every metric, cut into label and value."""
    x = metrics.prometheus(_stats(s, d))
    return x.select("name", "ord", F.regexp_extract("line", r"^(.*\} )", 1).alias("label"), F.regexp_extract("line", r"\} (.*)$", 1).cast("double").alias("value"))


@query("SELECT error, count(*) AS n FROM calls WHERE error IS NOT NULL GROUP BY error")
def error_summary(s, d):
    return metrics.error_summary(g.calls(s, d))


@query(
    """AND ok AS (SELECT key, max(seq) FILTER (error IS NULL) AS ok, count(error) AS errors FROM calls GROUP BY key),
  con AS (SELECT c.key, count(*) AS n FROM calls c JOIN ok USING (key) WHERE error IS NOT NULL AND (ok IS NULL OR seq > ok) GROUP BY c.key),
  lst AS (SELECT key, count(*) AS k, date_diff('microsecond', min(ts), max(ts)) AS us FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM calls WHERE error IS NOT NULL) WHERE r <= 10 GROUP BY key)
  SELECT key, errors, coalesce(n, 0) AS consecutive, coalesce(n, 0) >= 3 AS warns, coalesce(k >= 10 AND us < 60000000, false) AS rapid,
    CASE WHEN coalesce(n, 0) >= 5 THEN 'high_consecutive' WHEN k >= 10 AND us < 60000000 THEN 'rapid' END AS pattern
  FROM ok LEFT JOIN con USING (key) LEFT JOIN lst USING (key)"""
)
def error_patterns(s, d):
    return metrics.error_patterns(g.calls(s, d))


def _sessions(s, d):
    e = g.read(s, d, "events")
    by = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ops = by.where("event_type <> 'view'").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("mcp_operations"))
    t = e.groupBy("user_id").agg(F.min("ts").alias("start_time"), F.count_if(F.col("event_type") == "view").alias("grep_operations"))
    return t.join(ops, "user_id", "left").select(
        F.col("user_id").cast("string").alias("session_id"), F.when(F.col("user_id") >= 20, F.floor(F.col("user_id") / 10).cast("string")).alias("parent_session"),
        F.when(F.col("user_id") % 2 == 0, "main").alias("session_type"), "start_time", "grep_operations", F.coalesce("mcp_operations", F.create_map().cast("map<string,bigint>")).alias("mcp_operations"),
    )


@query("SELECT count(DISTINCT user_id) AS total_sessions, count(*) FILTER (event_type <> 'view') AS total_mcp_operations, count(*) FILTER (event_type = 'view') AS total_grep_operations, round(count(*) FILTER (event_type <> 'view') / count(*), 6) AS adoption_rate FROM events", base=False)
def session_rollup(s, d):
    return metrics.session_rollup(_sessions(s, d)).withColumn("adoption_rate", F.round("adoption_rate", 6))


@query("SELECT strftime(t, '%H') AS bucket, count(*) AS n FROM (SELECT min(ts) AS t FROM events GROUP BY user_id) GROUP BY 1", base=False)
def session_hours(s, d):
    return metrics.session_histogram(_sessions(s, d), "hour")


@query("SELECT event_type AS tool, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY n DESC, tool LIMIT 10", base=False)
def top_tools(s, d):
    return metrics.tool_usage(_sessions(s, d))


@query("WITH u AS (SELECT DISTINCT user_id AS u FROM events) SELECT u::VARCHAR AS session_id, coalesce((SELECT string_agg(c.u::VARCHAR, ',' ORDER BY c.u::VARCHAR) FROM u c WHERE c.u >= 20 AND c.u // 10 = r.u), '') AS children FROM u r WHERE u < 20", base=False)
def session_tree(s, d):
    return metrics.session_tree(_sessions(s, d)).select("session_id", F.array_join("children", ",").alias("children"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    base=False,
)
def debounce_sessions(s, d):
    return changes.sessions(g.read(s, d, "events"), "6 hours", "user_id")


@query("SELECT event_type AS name, date_trunc('day', ts) AS \"start\", count(*) AS calls, count(*) FILTER (floor(value)::BIGINT % 3 = 0) AS errors, max(value) AS max_ms, round(sum(value::DECIMAL(18, 4)), 2)::DOUBLE AS total_ms FROM events GROUP BY 1, 2", base=False)
def live_metrics(s, d):
    return changes.live_metrics(g.calls(s, d), "1 day").withColumn("total_ms", F.round("total_ms", 2))


@query("SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY 1 ORDER BY ts DESC, key LIMIT 10", base=False)
def last_used(s, d):
    return metrics.last_used(g.read(s, d, "events").select(F.col("user_id").alias("key"), "ts"), 10)


# --- findings --------------------------------------------------------------------------------------------------------

_AXES = {"src0": "high", "src1": "med", "src2": "low"}
_PRIORS = {"src0": 0.9, "src1": 0.5, "src2": 0.25}


def _findings(s, d):
    x = g.read(s, d, "documents").join(g.read(s, d, "labels"), "doc_id")
    grade = F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "deterministic_single").otherwise("no_signal")
    handles = F.array(F.concat(F.lit("PARTS.P"), (F.col("doc_id") % 100).cast("string")), F.concat(F.lit("PARTS.P"), (F.col("doc_id") % 7).cast("string")))
    return x.select(F.col("doc_id").alias("id"), F.col("source").alias("axis"), grade.alias("grade"), handles.alias("handles"), F.concat(F.lit("  Size "), (F.col("n_chars") % 10).cast("string"), F.lit("  IN "), "lang").alias("claim"))


_FINDINGS = """AND f AS (SELECT doc_id AS id, source AS axis, CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'deterministic_single' ELSE 'no_signal' END AS grade,
  ['PARTS.P' || (doc_id % 100), 'PARTS.P' || (doc_id % 7)] AS handles, '  Size ' || (n_chars % 10) || '  IN ' || lang AS claim FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, list_sort(list_distinct(handles))::VARCHAR || '#' || grade || '#' || lower(trim(regexp_replace(claim, '\\s+', ' ', 'g'))) AS eq FROM f) """.replace("\\\\", "\\")


@query(
    _FINDINGS
    + """, b AS (SELECT id, max(p_retailprice) AS blast FROM (SELECT id, unnest(handles) AS h FROM f) JOIN part ON h = 'PARTS.P' || p_partkey GROUP BY id)
  SELECT id, CASE grade WHEN 'ambiguous' THEN 0 WHEN 'deterministic_single' THEN 1 ELSE 2 END AS tier, CASE axis WHEN 'src0' THEN 2 WHEN 'src1' THEN 1 ELSE 0 END AS bucket, coalesce(blast, 0) AS blast,
    CASE axis WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 0.5 ELSE 0.25 END::DOUBLE AS prior FROM f LEFT JOIN b USING (id)"""
)
def rank_findings(s, d):
    mag = g.read(s, d, "part").select(g.part_handle(F.col("p_partkey")).alias("handle"), F.col("p_retailprice").alias("value"))
    return review.rank(review.blast(_findings(s, d), mag), _AXES, _PRIORS).select("id", "tier", "bucket", "blast", "prior")


@query(
    _FINDINGS
    + """, b AS (SELECT id, max(p_retailprice) AS blast FROM (SELECT id, unnest(handles) AS h FROM f) JOIN part ON h = 'PARTS.P' || p_partkey GROUP BY id),
  o AS (SELECT id, CASE grade WHEN 'ambiguous' THEN 0 WHEN 'deterministic_single' THEN 1 ELSE 2 END AS tier, CASE axis WHEN 'src0' THEN 2 WHEN 'src1' THEN 1 ELSE 0 END AS bucket, coalesce(blast, 0) AS blast,
    CASE axis WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 0.5 ELSE 0.25 END AS prior FROM f LEFT JOIN b USING (id))
  SELECT id, row_number() OVER (ORDER BY tier, bucket DESC, blast DESC, prior DESC, id) AS place FROM o QUALIFY place <= 50"""
)
def top_findings(s, d):
    """The fifty that a person sees first, in their order."""
    mag = g.read(s, d, "part").select(g.part_handle(F.col("p_partkey")).alias("handle"), F.col("p_retailprice").alias("value"))
    rows = review.rank(review.blast(_findings(s, d), mag), _AXES, _PRIORS).select("id").limit(50).collect()
    return s.createDataFrame([(r[0], i + 1) for i, r in enumerate(rows)], "id long, place long")


@query(
    _FINDINGS
    + """SELECT id, 0 AS origin FROM k WHERE id % 2 = 0 UNION ALL SELECT min(id), 1 FROM k WHERE id % 2 = 1 AND eq NOT IN (SELECT eq FROM k WHERE id % 2 = 0) GROUP BY eq"""
)
def merge_findings(s, d):
    f = _findings(s, d)
    return review.merge(f.where("id % 2 = 0"), f.where("id % 2 = 1")).select("id", "origin")


@query(_FINDINGS + "SELECT id, CASE WHEN grade = 'deterministic_single' AND id % 3 = 0 THEN 'ambiguous' ELSE grade END AS grade FROM f")
def reproduction_gate(s, d):
    """Of three reruns one loses every third finding."""
    f = _findings(s, d)
    runs = f.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("run")).where("NOT (run = 1 AND id % 3 = 0)")
    return review.reproduction_gate(f, runs).select("id", "grade")


@query(_FINDINGS + "SELECT id, CASE WHEN grade = 'deterministic_single' AND id % 5 = 0 THEN 'ambiguous' ELSE grade END AS grade, CASE WHEN grade = 'deterministic_single' AND id % 5 = 0 THEN true END AS possible_extractor_bug FROM f")
def cross_derivation_guard(s, d):
    f = _findings(s, d)
    return review.cross_derivation_guard(f, f.where("id % 5 <> 0").select("id")).select("id", "grade", "possible_extractor_bug")


@query(_FINDINGS + "SELECT id, 'ni:' || sha256(array_to_string(list_sort(handles), '|') || chr(0) || claim) AS key FROM f")
def non_issue_keys(s, d):
    return review.non_issues(_findings(s, d)).select("id", "key")


@query("SELECT doc_id AS unit, sha256(text) <> sha256(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS is_stale FROM documents", base=False)
def stale_units(s, d):
    x = g.read(s, d, "documents")
    had = x.select(F.col("doc_id").alias("unit"), F.sha2("text", 256).alias("content_hash"))
    now = x.select(F.col("doc_id").alias("unit"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise("")), 256).alias("content_hash"))
    return review.stale(had, now)


# --- scalars and tables ----------------------------------------------------------------------------------------------


@query("SELECT c_name, c_custkey FROM customer", base=False)
def filter_fields(s, d):
    return tables.filter_fields(g.read(s, d, "customer"), ["c_name", "c_custkey"])


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2", base=False)
def first_seen(s, d):
    return tables.first_seen(g.read(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


@query("WITH x AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'a/b' || o_orderkey || '.py:' || o_custkey WHEN 1 THEN 'x/y' || o_orderkey WHEN 2 THEN 'pkg.C' || o_orderkey ELSE 'C' || o_orderkey END AS id FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'file_line' WHEN 1 THEN 'file' WHEN 2 THEN 'dotted' ELSE 'bare' END AS form FROM x", base=False)
def identifier_forms(s, d):
    k, o = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    ident = F.when(o == 0, F.concat(F.lit("a/b"), k, F.lit(".py:"), F.col("o_custkey").cast("string"))).when(o == 1, F.concat(F.lit("x/y"), k)).when(o == 2, F.concat(F.lit("pkg.C"), k)).otherwise(F.concat(F.lit("C"), k))
    return g.read(s, d, "orders").select("o_orderkey", scalar.identifier_form(ident).alias("form"))


@query(
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Model.__init__' WHEN 1 THEN 'a.__len__' WHEN 2 THEN 'a._x' WHEN 3 THEN 'Model.run' WHEN 4 THEN 'mod.run' ELSE 'a.b.c' END AS n FROM part)
  SELECT p_partkey, n, CASE p_partkey % 6 WHEN 0 THEN 'class_constructor' WHEN 1 THEN 'magic_method' WHEN 2 THEN 'private_member' WHEN 3 THEN 'class_member' WHEN 4 THEN 'module_function' ELSE 'qualified_member' END AS c FROM x""",
    base=False,
)
def symbol_classes(s, d):
    n = F.element_at(F.array(*map(F.lit, ("Model.__init__", "a.__len__", "a._x", "Model.run", "mod.run", "a.b.c"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return g.read(s, d, "part").select("p_partkey", n.alias("n")).withColumn("c", scalar.symbol_class(F.col("n")))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'a.b.x' WHEN 2 THEN 'a.x' WHEN 3 THEN 'x' END AS target FROM orders""", base=False
)
def relative_imports(s, d):
    """`x` from module a.b.c at levels 0 to 4: the last is above the top."""
    lv = F.col("o_orderkey") % 5
    return g.read(s, d, "orders").select("o_orderkey", scalar.relative_import(F.lit("a.b.c"), F.lit("x"), lv, F.lit(False)).alias("target"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'project' WHEN 4 THEN 'external' ELSE 'external' END AS scope FROM supplier""", base=False
)
def scope_classify(s, d):
    k = F.col("s_suppkey").cast("string")
    p = [F.concat(F.lit("/p/build/f"), k), F.concat(F.lit("/p/src/f"), k), F.concat(F.lit("/p/lib/site-packages/f"), k), F.concat(F.lit("/std/f"), k), F.concat(F.lit("/else/f"), k)]
    return g.read(s, d, "supplier").select("s_suppkey", scalar.path_scope(F.element_at(F.array(*p), (F.col("s_suppkey") % 5 + 1).cast("int")), "/p", stdlib=("/std",)).alias("scope"))


@query("AND p AS (SELECT handle FROM met), x AS (SELECT handle, unnest(range(1, len(string_split(handle, '.')) + 1)) AS k FROM p) SELECT handle, array_to_string(string_split(handle, '.')[1:k], '.') AS prefix FROM x")
def dotted_prefixes(s, d):
    return g.methods(s, d).select("handle", F.explode(scalar.prefixes(F.col("handle"))).alias("prefix"))


# --- rendered sources ------------------------------------------------------------------------------------------------


def _facts(s, d):
    from .plans.rendered import facts

    return facts(s, d)


@query("SELECT 'route_' || s_suppkey AS name, '/s/' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'GET,POST' ELSE 'GET' END AS methods FROM supplier", base=False)
def find_routes(s, d):
    from .operators import patterns

    return patterns.flask_routes(_facts(s, d)).select("name", "path", F.array_join("methods", ",").alias("methods"))


@query("SELECT 'Model' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b' ELSE 'a' END AS required, 'c' AS optional FROM supplier", base=False)
def find_models(s, d):
    from .operators import patterns

    return patterns.pydantic_models(_facts(s, d)).select("name", F.array_join("required", ",").alias("required"), F.array_join("optional", ",").alias("optional"))


@query("SELECT 'check_' || s_suppkey AS name, 'a' AS field, CASE WHEN s_suppkey % 4 = 0 THEN 'before' ELSE 'after' END AS mode FROM supplier", base=False)
def find_validators(s, d):
    from .operators import patterns

    return patterns.pydantic_validators(_facts(s, d)).select("name", F.array_join("fields", ",").alias("field"), "mode")


@query("SELECT 'src.s' || s_suppkey || '.route_' || s_suppkey AS src, 'src.s' || s_suppkey || '.helper' AS dst FROM supplier", base=False)
def rendered_callees(s, d):
    from .plans.rendered import source_tables

    return source_tables(s, d).edges_of("callees").select("src", "dst")


@query("SELECT 'src.s' || s_suppkey AS src, 'pydantic.BaseModel' AS target FROM supplier", base=False)
def rendered_unresolved_imports(s, d):
    from .plans.rendered import source_tables

    return source_tables(s, d).unresolved_of("imports").where("target LIKE 'pydantic.BaseModel'").select("src", "target")


# --- catalogue -------------------------------------------------------------------------------------------------------


@query("SELECT 's' || s_suppkey AS project, 1::BIGINT AS hits, 'src.s' || s_suppkey || '.helper' AS handle FROM supplier", base=False)
def search_projects(s, d):
    from .operators import catalog
    from .sources.code import of

    defs = of(_facts(s, d), "def").select(scalar.leaf(F.col("module")).alias("project"), "name", "full_name")
    return catalog.search_projects(defs, "helper").select("project", "hits", F.element_at("handles", 1).alias("handle"))


@query("SELECT 'src/s' || s_suppkey || '.py' AS file, 2 AS line, unnest(['from pydantic import BaseModel', 'from pydantic import field_validator']) AS statement FROM supplier", base=False)
def find_imports(s, d):
    from .operators import catalog
    from .sources.code import of

    return catalog.find_imports(of(_facts(s, d), "import"), "pydantic").select("file", "line", "statement")


@query("SELECT bases, resolved, resolved / bases AS ratio FROM (SELECT 4 * n + 3 * s AS bases, 4 * n + 2 * s AS resolved FROM (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS s))", base=False)
def base_resolution(s, d):
    """Of a parsed project: bases outside it are what tables alone don't resolve."""
    from .operators import catalog
    from .plans.rendered import project_tables

    return catalog.base_resolution(project_tables(s, d)["bases"])
