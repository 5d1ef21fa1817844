"""Module dependencies: importers, statistics, what a change affects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import prefixes


def imported_by(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): module src is imported by module dst. imports(module, target, name): every import statement, nested ones
    too. `target` counts for all its dotted prefixes, and `from target import name` for target.name, so the prefix
    condition is an equi-join. A module doesn't import itself."""
    named = F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.array(F.concat_ws(".", "target", "name"))).otherwise(F.array().cast("array<string>"))
    reach = imports.select("module", F.explode(F.concat(prefixes(F.col("target")), named)).alias("_t"))
    return reach.join(modules.select(F.col("module").alias("_m")), F.col("_t") == F.col("_m")).where(F.col("module") != F.col("_m")).select(F.col("_m").alias("src"), F.col("module").alias("dst")).distinct()


def written_imports(imports: DataFrame) -> DataFrame:
    """(module, name): module names that a module's import statements spell, at any depth: what stands after `import`, or
    between `from` and `import` without its dots, or, where nothing stands there, the imported names. An independent
    second derivation: nothing is resolved. imports(module, target, name)."""
    return imports.select("module", F.coalesce("target", "name").alias("name")).where("name IS NOT NULL").distinct()


def dependency_graph(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(from, to): edges between modules of the project, each once."""
    known = modules.select(F.col("module").alias("to"))
    return imports.select(F.col("module").alias("from"), F.col("target").alias("to")).join(known, "to", "left_semi").where("`from` <> `to`").select("from", "to").distinct()


def dependency_stats(deps: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row: modules, edges, symbols, max_fan_out, max_fan_in (0 if there are none)."""
    mods = deps.select(F.col("from").alias("m")).union(deps.select(F.col("to").alias("m"))).agg(F.count_distinct("m").alias("modules"))
    out = deps.groupBy("from").agg(F.count_distinct("to").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_fan_out"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    into = deps.groupBy("to").agg(F.count_distinct("from").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_fan_in"))
    count = symbols.agg(F.count_distinct("symbol").alias("symbols")) if symbols is not None else deps.limit(0).agg(F.count("*").alias("symbols"))
    # each side is one row
    return mods.crossJoin(out).crossJoin(into).crossJoin(count).select("modules", "edges", "symbols", "max_fan_out", "max_fan_in")


def affected_modules(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(changed, module): each changed module (module) with itself and its direct dependents."""
    own = changed.select(F.col("module").alias("changed"), "module")
    return own.unionByName(own.select("changed").join(deps, F.col("to") == F.col("changed")).select("changed", F.col("from").alias("module"))).distinct()


def affected_symbols(changed: DataFrame, used: DataFrame) -> DataFrame:
    """(module, symbols): of the changed symbols (symbol) those that a module's uses (module, symbol) have; none: no row."""
    return used.join(changed.select("symbol").distinct(), "symbol", "left_semi").groupBy("module").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def module_profile(defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """One row a module of files(module, lines, has_tests): classes, functions (public, not async), exports, imported heads,
    all sorted. defs(module, name, kind, is_async), imports(module, target, level)."""
    cls = F.when(F.col("kind") == "class", F.col("name"))
    fun = F.when((F.col("kind") == "function") & ~F.col("is_async") & ~F.startswith("name", F.lit("_")), F.col("name"))
    d = defs.groupBy("module").agg(F.array_sort(F.collect_list(cls)).alias("classes"), F.array_sort(F.collect_list(fun)).alias("functions"))
    i = imports.where("level = 0").groupBy("module").agg(F.array_sort(F.collect_set(F.substring_index("target", ".", 1))).alias("imports_from"))
    none = F.array().cast("array<string>")
    out = files.join(d, "module", "left").join(i, "module", "left")
    c, f = F.coalesce("classes", none), F.coalesce("functions", none)
    return out.select("module", c.alias("classes"), f.alias("functions"), F.array_sort(F.concat(c, f)).alias("exports"), F.coalesce("imports_from", none).alias("imports_from"), "lines", "has_tests")


def package_profile(children: DataFrame) -> DataFrame:
    """(package, subpackages, modules) of children(package, child, is_package), sorted."""
    return children.groupBy("package").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_package"), F.col("child")))).alias("subpackages"),
        F.array_sort(F.collect_set(F.when(~F.col("is_package"), F.col("child")))).alias("modules"),
    )


def submodules(listing: DataFrame) -> DataFrame:
    """(package, child, kind, ord) of listing(package, child, root_rank, kind): in one directory a regular package beats a
    module, which beats a namespace package; across roots the first wins. Dot names and caches don't count."""
    rank = F.element_at(F.create_map(F.lit("package"), F.lit(0), F.lit("module"), F.lit(1), F.lit("namespace"), F.lit(2)), F.col("kind"))
    ok = listing.where(~F.startswith("child", F.lit(".")) & (F.col("child") != "__pycache__"))
    best = ok.groupBy("package", "child").agg(F.min(F.struct("root_rank", rank.alias("k"), "kind")).alias("b"))
    return best.select("package", "child", F.col("b.kind").alias("kind"))
