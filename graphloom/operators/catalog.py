"""Questions about imports, projects, namespaces and types that need one table or two."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scalar import relative_import


def about() -> str:
    """Constant metadata as JSON."""
    from ..plans.registry import IMPLEMENTED, REFUSED

    return json.dumps({"name": "graphloom", "engine": "spark", "edges": list(IMPLEMENTED), "refused_edges": list(REFUSED), "null": "not measured", "zero": "measured, none found"}, sort_keys=True)


def find_imports(imports: DataFrame, module: str) -> DataFrame:
    """(file, line, importer, statement) of every import of a module or of what is below it, absolute or relative, at any
    depth. imports(module, file, line, target, name, level, kind)."""
    whole = relative_import(F.col("module"), F.col("target"), F.coalesce("level", F.lit(0)), F.coalesce(F.col("kind") == "package", F.lit(False)))
    named = F.concat_ws(".", whole, "name")
    hit = (whole == module) | F.startswith(whole, F.lit(module + ".")) | (F.col("name").isNotNull() & (named == module))
    dots = F.concat(F.repeat(F.lit("."), F.coalesce("level", F.lit(0))), F.coalesce("target", F.lit("")))
    text = F.when(F.col("name").isNull(), F.concat(F.lit("import "), "target")).otherwise(F.concat(F.lit("from "), dots, F.lit(" import "), "name"))
    return imports.where(hit).select("file", "line", F.col("module").alias("importer"), text.alias("statement")).orderBy("file", "line", "statement")


def imported_modules(imports: DataFrame, modules: DataFrame, file: str) -> DataFrame:
    """(name, module): names in a file that stand for modules."""
    whole = relative_import(F.col("module"), F.col("target"), F.coalesce("level", F.lit(0)), F.coalesce(F.col("kind") == "package", F.lit(False)))
    mine = imports.where(F.col("file") == file).select(F.col("full_name").alias("name"), F.when(F.col("name").isNull(), whole).otherwise(F.concat_ws(".", whole, "name")).alias("module"))
    return mine.join(modules.select("module").distinct(), "module", "left_semi").select("name", "module").distinct()


def search_projects(defs: DataFrame, name: str) -> DataFrame:
    """(project, hits, handles) of an exact name in defs(project, name, full_name); projects without a hit have no row."""
    return defs.where(F.col("name") == name).groupBy("project").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("full_name")).alias("handles"))


def namespace_packages(files: DataFrame) -> DataFrame:
    """(namespace, roots) of files(root, root_rank, path relative to its root): first-level folders that hold Python files
    below and have no __init__.py in any root; roots in their order."""
    deep = files.where(F.instr("path", "/") > 0).withColumn("top", F.substring_index("path", "/", 1))
    regular = deep.where(F.col("path") == F.concat("top", F.lit("/__init__.py"))).select("top").distinct()
    spread = deep.where(F.endswith("path", F.lit(".py"))).join(regular, "top", "left_anti").groupBy("top").agg(F.array_sort(F.collect_set(F.struct("root_rank", "root"))).alias("r"))
    return spread.select(F.col("top").alias("namespace"), F.col("r.root").alias("roots"))


def namespace_import(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, root, path): where a dotted name (name) is found first: a package before a module in a root, roots in order."""
    as_path = F.replace("name", F.lit("."), F.lit("/"))
    asked = names.select("name", F.explode(F.array(F.concat(as_path, F.lit("/__init__.py")), F.concat(as_path, F.lit(".py")))).alias("path"))
    hit = asked.join(files.select("root", "root_rank", "path"), "path")
    order = Window.partitionBy("name").orderBy("root_rank", F.when(F.endswith("path", F.lit("/__init__.py")), 0).otherwise(1))
    return hit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("name", "root", "path")


def base_resolution(bases: DataFrame) -> DataFrame:
    """One row of bases(owner, dst): bases, resolved, ratio (0 if there are none): how many bases tables alone resolve."""
    n, k = F.count("*"), F.count("dst")
    return bases.agg(n.alias("bases"), k.alias("resolved"), F.when(n > 0, k / n).otherwise(F.lit(0.0)).alias("ratio"))


def split_top_level(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that no bracket encloses, trimmed; empty parts are dropped."""
    out, depth, part = [], 0, []
    for c in text:
        depth += (c in "[(") - (c in "])")
        if c == sep and depth == 0:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
    out.append("".join(part).strip())
    return [p for p in out if p]


def leaf_types(text: str) -> list[str]:
    """The types at the leaves of generics and unions, in order, repeats included."""
    out: list[str] = []
    for part in split_top_level(text, "|"):
        head, bracket, rest = part.partition("[")
        inner = split_top_level(rest[: rest.rfind("]")] if "]" in rest else rest) if bracket else []
        out += [x for p in inner for x in leaf_types(p)] if bracket else [part]
    return out


def leaf_types_of(text: Column) -> Column:
    """leaf_types of a column, in Arrow batches; null stays null."""

    @F.pandas_udf(ArrayType(StringType()))
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else leaf_types(x))

    return each(text)


def resolve_scope(scope: str | list[str] | None, method: str, defaults: dict[str, str], aliases: dict[str, str | list[str]], general: str | None = None) -> list[str]:
    """The scopes a call asks for: given ones, else the method's default, else the general one, else all; aliases become
    what they stand for."""
    asked = [scope] if isinstance(scope, str) else scope or [defaults.get(method) or general or "all"]
    return [s for a in asked for s in (aliases.get(a, a) if isinstance(aliases.get(a, a), list) else [aliases.get(a, a)])]


def older_than(lines: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """JSON lines (value) that a cleanup keeps: those whose end_time isn't older than `days`, and malformed ones."""
    end = F.try_to_timestamp(F.get_json_object("value", "$.end_time"))
    return lines.where(end.isNull() | (end >= (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days))))


def read_state(path: str) -> dict:
    """A review's state file; an empty first version if there is none."""
    p = Path(path)
    return json.loads(p.read_text("utf-8")) if p.is_file() else {"version": 1, "coverage": [], "findings": [], "confirmed_non_issues": []}


def write_state(path: str, state: dict) -> None:
    """Written beside and moved into place, so that a reader never sees half of it."""
    p = Path(path)
    part = p.with_suffix(p.suffix + ".part")
    part.write_text(json.dumps(state, indent=2, sort_keys=True), "utf-8")
    part.replace(p)


def update_document(path: str, change: Callable[[dict], None], empty: Callable[[], dict] = dict) -> dict:
    """Read a JSON document of the driver, change it and write it whole, under a lock beside it: of writers at once each
    sees what the one before wrote. A document that can't be read starts empty."""
    import fcntl

    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with open(p.with_suffix(p.suffix + ".lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        try:
            held = json.loads(p.read_text("utf-8"))
        except (OSError, ValueError):
            held = empty()
        change(held)
        write_state(path, held)
    return held


def state_tables(spark: SparkSession, state: dict) -> dict[str, DataFrame]:
    return {
        "coverage": spark.createDataFrame([(c["unit"], c["content_hash"]) for c in state["coverage"]], "unit string, content_hash string"),
        "confirmed_non_issues": spark.createDataFrame([(c["key"],) for c in state["confirmed_non_issues"]], "key string"),
    }
