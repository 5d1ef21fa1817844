"""Registered queries over a project whose names need more than a look into one file (plans.rendered.twisted): rebinding,
stars of stars, imports in blocks, inherited members, variables, occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import resolve
from .plans import relational as g
from .plans.rendered import split, split_roots, split_tables, twisted_tables
from .sources import layout
from .queries import query

_T = "WITH s AS (SELECT s_suppkey AS k, 'tw.s' || s_suppkey AS pkg, '/q/tw/s' || s_suppkey || '/use.py' AS file, length(s_suppkey::VARCHAR) - 1 AS x FROM supplier) "
_CORE = "['Widget', 'Base', 'make', 'helper', 'A', 'B', 'C', 'matched']"


@query(_T + f""", n AS (SELECT pkg, unnest({_CORE}) || k AS name FROM s), v AS (SELECT unnest(['', '.api', '.dead', '.more']) AS via, unnest([3, 2, 3, 1]) AS hops)
SELECT pkg || via || '.' || name AS alias, pkg || '.core.' || name AS handle, hops FROM n, v WHERE NOT (via = '.dead' AND name LIKE 'Widget%')
UNION ALL SELECT pkg || '.' || unnest(['core', 'more', 'api', 'dead']) || '.extra', pkg || '.extra', unnest([1, 2, 3, 4]) FROM s
UNION ALL SELECT pkg || '.use.' || unnest(['Other', 'Thing', 'Widget' || k, 'make' || k]), pkg || '.' || unnest(['extra.Other', 'core.Base' || k, 'core.Widget' || k, 'core.make' || k]), unnest([1, 1, 4, 4]) FROM s""", base=False)
def star_names(s, d):
    """A star of a star that goes round before it leads on, and one that leads nowhere: the first way that reaches a
    definition counts. The submodule is imported in a block of a match; it passes through stars too, but for the package
    itself, whose own submodule it is. Of two imports of one name the last counts."""
    return twisted_tables(s, d)["canonical"].select("alias", "handle", "hops")


@query(_T + """SELECT pkg || '.use.Child' || k AS src, pkg || '.core.Base' || k AS dst FROM s UNION ALL SELECT pkg || '.use.Leaf' || k, unnest([pkg || '.use.Child' || k, pkg || '.core.Widget' || k]) FROM s""", base=False)
def rebound_superclasses(s, d):
    """The base is a name that two imports bind."""
    return twisted_tables(s, d).edges_of("superclasses").select("src", "dst")


@query(_T + """, m AS (SELECT pkg || '.use.' || unnest(['Child', 'Child', 'Leaf', 'Leaf', 'Leaf', 'Leaf', 'Leaf']) || k AS src, unnest(['own', 'widget', '__init__', 'go', 'grow', 'name', 'widget']) AS name,
  pkg || unnest(['.core.Base', '.core.Base', '.core.Widget', '.use.Child', '.core.Widget', '.core.Widget', '.core.Base']) || k AS defined_in FROM s) SELECT src, name, defined_in || '.' || name AS dst, defined_in FROM m""", base=False)
def inherited_members(s, d):
    """What classes have besides their own members, by their resolution order."""
    return twisted_tables(s, d)["inherited_members"]


@query(_T + """SELECT pkg || unnest(['.core.Base' || k, '.core.Widget' || k, '.extra.Other', '.use.Child' || k, '.use.Leaf' || k]) AS handle, unnest(['Base' || k || '()', 'Widget' || k || '(size: int)', 'Other()', 'Child' || k || '()', 'Leaf' || k || '(size: int)']) AS signature FROM s""", base=False)
def class_signatures(s, d):
    """Arguments of a constructor that the class may inherit."""
    return twisted_tables(s, d)["nodes"].where("kind = 'class'").select("handle", "signature")


@query(_T + """SELECT pkg || '.core.' || unnest(['Base' || k || '.widget', 'Widget' || k || '.name', 'make' || k, 'matched' || k, 'matched' || k]) AS src, pkg || '.core.' || unnest(['make' || k, 'helper' || k, 'Widget' || k, 'make' || k, 'Widget' || k || '.grow']) AS dst FROM s
UNION ALL SELECT pkg || '.use.Child' || k || '.go', pkg || unnest(['.core.Base' || k || '.own', '.core.Widget' || k, '.core.Widget' || k || '.grow', '.core.Widget' || k || '.name', '.core.make' || k, '.extra.Other', '.extra.Other.grow']) FROM s
UNION ALL SELECT pkg || '.use.Leaf' || k || '.own', pkg || '.core.Base' || k || '.own' FROM s
UNION ALL SELECT pkg || '.use.run' || k, pkg || unnest(['.core.Base' || k || '.own', '.use.Leaf' || k || '.own', '.core.Widget' || k || '.name', '.core.Widget' || k || '.grow', '.core.make' || k]) FROM s""", base=False)
def followed_callees(s, d):
    """Calls of inherited members, of super(), of variables and attributes by what they hold, of what a property gives."""
    return twisted_tables(s, d).edges_of("callees").select("src", "dst")


@query(_T + """SELECT pkg || unnest(['.extra.Other.grow', '.use.Child' || k || '.go', '.use.Leaf' || k || '.own', '.use.run' || k]) AS src, unnest([2, 1, 1, 4])::BIGINT AS sites FROM s""", base=False)
def unfollowed_calls(s, d):
    """What stays unknown is counted: builtins, elements of a list, what an unknown function gives, the outside."""
    return twisted_tables(s, d).unresolved_of("callees").groupBy("src").agg(F.count("*").alias("sites"))


@query(_T + """SELECT pkg || unnest(['.core.Base' || k || '.widget()', '.core.Widget' || k || '.grow()', '.core.make' || k || '()', '.core.matched' || k || '()', '.use.Child' || k || '.go()', '.use.Child' || k || '.go.w#1', '.use.Child' || k || '.go.w#2', '.use.Child' || k || '.held',
  '.use.run' || k || '.c#1', '.use.run' || k || '.d#1', '.use.run' || k || '.v#1']) AS name, 'I' AS state, pkg || unnest(['.core.Widget' || k, '.core.Widget' || k, '.core.Widget' || k, '.core.Widget' || k, '.core.Widget' || k, '.core.Widget' || k, '.extra.Other', '.core.Widget' || k,
  '.use.Child' || k, '.use.Leaf' || k, '.core.Widget' || k]) AS at FROM s""", base=False)
def carried_values(s, d):
    """What variables (each assignment of a local one apart), attributes and returns hold."""
    return twisted_tables(s, d)["values"]


@query(_T + """SELECT pkg || '.use' AS src, 'imports' AS kind, pkg || unnest(['.extra.Other', '.core.Base' || k, '.core.Widget' || k, '.core.make' || k]) AS dst FROM s
UNION ALL SELECT pkg || '.core', 'members', pkg || '.core.' || name || k FROM s, (SELECT unnest(""" + _CORE + """) AS name)
UNION ALL SELECT pkg || '.use', 'members', pkg || '.use.' || unnest(['Child', 'Leaf', 'run']) || k FROM s UNION ALL SELECT pkg || '.extra', 'members', pkg || '.extra.Other' FROM s""", base=False)
def block_imports_and_members(s, d):
    """An import in a block is no import of the module; definitions in blocks and in tuples are its members."""
    e = twisted_tables(s, d).edges_of("imports", "members")
    return e.where("src RLIKE '^tw[.]s[0-9]+[.](use|core|extra)$'").select("src", "kind", "dst")


@query(_T + """, i AS (SELECT pkg || unnest(['', '.api', '.api', '.dead', '.dead', '.more', '.core', '.use', '.use', '.use']) AS dst, pkg || unnest(['.api', '.dead', '.more', '.gone', '.api', '.core', '.extra', '.extra', '.core', '']) AS src FROM s)
SELECT DISTINCT src, dst FROM (SELECT src, dst FROM i WHERE src NOT LIKE '%.gone' UNION ALL SELECT unnest(['tw', regexp_extract(src, '^tw.s[0-9]+')]), dst FROM i) WHERE src <> dst""", base=False)
def block_imported_by(s, d):
    """Imports at any depth count here, and for the packages above what they name."""
    return twisted_tables(s, d).edges_of("imported_by").select("src", "dst")


_SPANS = """, o AS (SELECT file, pkg, k, x, unnest([{'l': 10, 'c': 8, 'm': 0, 'n': 'go', 'h': '.use.Child#.go'}, {'l': 10, 'c': 11, 'm': 0, 'n': 'self', 'h': '.use.Child#.go.self'}, {'l': 11, 'c': 8, 'm': 0, 'n': 'self', 'h': '.use.Child#.go.self'}, {'l': 11, 'c': 13, 'm': 0, 'n': 'own', 'h': '.core.Base#.own'},
  {'l': 12, 'c': 8, 'm': 0, 'n': 'super', 'h': 'builtins.super'}, {'l': 12, 'c': 16, 'm': 0, 'n': 'own', 'h': '.core.Base#.own'}, {'l': 13, 'c': 8, 'm': 0, 'n': 'w', 'h': '.use.Child#.go.w'}, {'l': 13, 'c': 12, 'm': 0, 'n': 'Widget#', 'h': '.core.Widget#'},
  {'l': 14, 'c': 8, 'm': 0, 'n': 'w', 'h': '.use.Child#.go.w'}, {'l': 14, 'c': 10, 'm': 0, 'n': 'grow', 'h': '.core.Widget#.grow'}, {'l': 14, 'c': 17, 'm': 0, 'n': 'name', 'h': '.core.Widget#.name'}, {'l': 15, 'c': 8, 'm': 0, 'n': 'self', 'h': '.use.Child#.go.self'},
  {'l': 15, 'c': 13, 'm': 0, 'n': 'held', 'h': '.use.Child#.held'}, {'l': 15, 'c': 20, 'm': 0, 'n': 'make#', 'h': '.core.make#'}, {'l': 16, 'c': 8, 'm': 0, 'n': 'w', 'h': '.use.Child#.go.w'}, {'l': 16, 'c': 12, 'm': 0, 'n': 'Other', 'h': '.extra.Other'},
  {'l': 17, 'c': 8, 'm': 0, 'n': 'w', 'h': '.use.Child#.go.w'}, {'l': 17, 'c': 10, 'm': 0, 'n': 'grow', 'h': '.extra.Other.grow'}, {'l': 18, 'c': 15, 'm': 0, 'n': 'self', 'h': '.use.Child#.go.self'}, {'l': 18, 'c': 20, 'm': 0, 'n': 'widget', 'h': '.core.Base#.widget'}, {'l': 18, 'c': 27, 'm': 0, 'n': 'grow', 'h': '.core.Widget#.grow'},
  {'l': 21, 'c': 6, 'm': 0, 'n': 'Leaf#', 'h': '.use.Leaf#'}, {'l': 21, 'c': 12, 'm': 1, 'n': 'Child#', 'h': '.use.Child#'}, {'l': 21, 'c': 20, 'm': 2, 'n': 'Widget#', 'h': '.core.Widget#'}, {'l': 26, 'c': 4, 'm': 0, 'n': 'run#', 'h': '.use.run#'}, {'l': 26, 'c': 9, 'm': 1, 'n': 'c', 'h': '.use.run#.c'}, {'l': 26, 'c': 12, 'm': 1, 'n': 'Child#', 'h': '.use.Child#'},
  {'l': 26, 'c': 20, 'm': 2, 'n': 'd', 'h': '.use.run#.d'}, {'l': 26, 'c': 47, 'm': 3, 'n': 'rest', 'h': '.use.run#.rest'}, {'l': 26, 'c': 53, 'm': 3, 'n': 'Leaf#', 'h': '.use.Leaf#'}, {'l': 30, 'c': 4, 'm': 0, 'n': 'd', 'h': '.use.run#.d'}, {'l': 30, 'c': 6, 'm': 0, 'n': 'name', 'h': '.core.Widget#.name'},
  {'l': 31, 'c': 4, 'm': 0, 'n': 'd', 'h': '.use.run#.d'}, {'l': 31, 'c': 6, 'm': 0, 'n': 'held', 'h': '.use.Child#.held'}, {'l': 31, 'c': 11, 'm': 0, 'n': 'grow', 'h': '.core.Widget#.grow'}, {'l': 33, 'c': 8, 'm': 0, 'n': 'r', 'h': '.use.run#.r'}, {'l': 38, 'c': 4, 'm': 0, 'n': 'os', 'h': 'os'},
  {'l': 39, 'c': 4, 'm': 0, 'n': 'LAST', 'h': '.use.LAST'}, {'l': 39, 'c': 23, 'm': 0, 'n': 'rest', 'h': '.use.run#.rest'}], recursive := true) FROM s),
w AS (SELECT file, l AS line, (c + m * x)::INTEGER AS col_start, replace(n, '#', k::VARCHAR) AS name, CASE WHEN h LIKE '.%' THEN pkg ELSE '' END || replace(h, '#', k::VARCHAR) AS handle FROM o) """


@query(_T + _SPANS + "SELECT file, line, col_start, col_start + length(name)::INTEGER AS col_end, name, handle FROM w", base=False)
def name_occurrences(s, d):
    """Where names stand in three functions, and what each stands for: elements of a list stand for nothing known."""
    o = twisted_tables(s, d)["occurrences"]
    return o.where("file LIKE '%/use.py' AND (line IN (10, 11, 12, 13, 14, 15, 16, 17, 18, 21, 26, 30, 31, 33, 38, 39))")


@query(_T + _SPANS + "SELECT file, line, col_start + 1 AS \"column\", handle FROM w WHERE length(name) > 1", base=False)
def definition_at(s, d):
    """Definitions at positions, by nothing but the sources: the second character of every longer name."""
    t = twisted_tables(s, d)
    k = F.length(F.col("s_suppkey").cast("string")) - 1
    rows = g.read(s, d, "supplier").select(F.concat(F.lit("/q/tw/s"), F.col("s_suppkey").cast("string"), F.lit("/use.py")).alias("file"), k.alias("x"))
    at = [(10, 8, 0), (10, 11, 0), (11, 8, 0), (11, 13, 0), (12, 8, 0), (12, 16, 0), (13, 12, 0), (14, 10, 0), (14, 17, 0), (15, 8, 0), (15, 13, 0), (15, 20, 0), (16, 12, 0), (17, 10, 0), (18, 15, 0), (18, 20, 0), (18, 27, 0), (21, 6, 0), (21, 12, 1), (21, 20, 2), (26, 4, 0), (26, 12, 1), (26, 47, 3), (26, 53, 3)]
    at += [(30, 6, 0), (31, 6, 0), (31, 11, 0), (38, 4, 0), (39, 4, 0), (39, 23, 0)]
    asked = rows.join(s.createDataFrame(at, "line int, c int, m int")).select("file", "line", (F.col("c") + F.col("m") * F.col("x") + 1).alias("column"))
    return resolve.resolve_at(asked, t["occurrences"])


_N = "WITH n AS (SELECT n_nationkey AS k, 'co.n' || n_nationkey AS pkg FROM nation) "


@query(_N + """SELECT unnest(['/w/p/tool' || k, '/w/p/src/app' || k, '/w/a/co/n' || k || '/shared', '/w/b/co/n' || k || '/shared', '/w/a/co/n' || k || '/both', '/w/a/co/n' || k || '/both/__init__', '/w/a/co/n' || k || '/late', '/w/b/co/n' || k || '/late/__init__', '/w/b/co/n' || k || '/deep/part']) || '.py' AS file,
  unnest(['/w/p', '/w/p/src', '/w/a', '/w/b/co', '/w/a', '/w/a', '/w/a', '/w/b/co', '/w/b/co']) AS root, unnest([1, 0, 2, 3, 2, 2, 2, 3, 3]) AS root_rank,
  unnest(['tool' || k, 'app' || k, pkg || '.shared', pkg || '.shared', pkg || '.both', pkg || '.both', pkg || '.late', pkg || '.late', pkg || '.deep.part']) AS module FROM n""", base=False)
def rooted_modules(s, d):
    """Names by roots: the longest of the first kind. A namespace root may hold the namespace's folder or be it.
    What lies in a folder whose name begins with a dot has no dotted name."""
    return layout.rooted(split(s, d), split_roots(s)).select("file", "root", "root_rank", "module")


@query(_N + """SELECT pkg AS src, pkg || '.' || unnest(['shared', 'both', 'late', 'deep']) AS dst FROM n UNION ALL SELECT 'co', pkg FROM n UNION ALL SELECT pkg || '.deep', pkg || '.deep.part' FROM n""", base=False)
def split_submodules(s, d):
    """All portions of a split namespace; folders whose names begin with a dot are none."""
    return split_tables(s, d).edges_of("submodules").select("src", "dst")


@query(_N + """SELECT pkg || unnest(['.shared', '.both', '.late', '.shared.where', '.both.B', '.late.A']) AS handle, unnest(['/w/a/co/n' || k || '/shared.py', '/w/a/co/n' || k || '/both/__init__.py', '/w/a/co/n' || k || '/late.py', '/w/a/co/n' || k || '/shared.py', '/w/a/co/n' || k || '/both/__init__.py', '/w/a/co/n' || k || '/late.py']) AS file FROM n""", base=False)
def shadowed_nodes(s, d):
    """Of one module in two roots the first counts, of two in one root the package; what the others define is no node."""
    return split_tables(s, d).plain.where("handle RLIKE '^co[.]n[0-9]+[.](shared|both|late)'").select("handle", "file")


@query(_N + "SELECT 'app' || k || '.main' AS src, pkg || '.shared.where' AS dst FROM n", base=False)
def split_callees(s, d):
    """Calls across roots."""
    return split_tables(s, d).edges_of("callees").select("src", "dst")
