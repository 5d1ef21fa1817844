"""Where a project keeps its packages: build settings, folder layouts, and the files that a scope names."""

from __future__ import annotations

import fnmatch
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_handle
from ..operators.catalog import resolve_scope
from .files import roots_for, roots_table, source_files


def _at(table: dict, *keys: str):
    for k in keys:
        table = table.get(k) if isinstance(table, dict) else None
    return table


def _texts(value) -> list[str]:
    return [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def declared_sources(tool: dict) -> list[str]:
    """Source folders that a project file's build tools declare, in the order setuptools, poetry, hatch, pdm."""
    packages = _at(tool, "poetry", "packages")
    return [
        *_texts(_at(tool, "setuptools", "packages", "find", "where")),
        *[p["from"] for p in (packages if isinstance(packages, list) else []) if isinstance(p, dict) and "from" in p],
        *_texts(_at(tool, "hatch", "build", "targets", "wheel", "sources")),
        *_texts(_at(tool, "pdm", "build", "package-dir")),
    ]


def checker_paths(tool: dict) -> list[str]:
    """Extra paths that the type checker's settings name: its own, then those of its environments, each once."""
    own = _texts(_at(tool, "pyright", "extraPaths"))
    more = _at(tool, "pyright", "executionEnvironments")
    for env in more if isinstance(more, list) else []:
        own += _texts(_at(env, "extraPaths"))
    return list(dict.fromkeys(own))


def detect_layout(project: str) -> list[str]:
    """Packages of a project as its pyproject.toml says: declared source folders that exist (as they are written), then
    the checker's extra paths that exist (resolved)."""
    root = Path(project)
    file = root / "pyproject.toml"
    if not file.is_file():
        return []
    try:
        tool = tomllib.loads(file.read_text("utf-8")).get("tool", {})
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return []
    found = [p for p in declared_sources(tool) if (root / p).is_dir()]
    extra = [(root / p).resolve() for p in checker_paths(tool)]
    return found + list(dict.fromkeys(p.as_posix() for p in extra if p.exists()))


def discover(project: str) -> list[str]:
    """Packages of a project that declares none: `src` if it holds a package, else sibling folders that hold Python files
    or a setup.py, and site-packages of a virtual environment inside the project."""
    root = Path(project)
    src = root / "src"
    if src.is_dir() and any((x / "__init__.py").exists() for x in src.iterdir() if x.is_dir()):
        return ["src"]
    found = []
    if root.parent != root:
        for x in sorted(root.parent.iterdir()):
            try:
                if x.is_dir() and x != root and (any(x.glob("*.py")) or (x / "setup.py").exists()):
                    found.append(str(x))
            except OSError:
                continue
    for name in ("venv", ".venv", "env"):
        lib = root / name / "lib"
        found += sorted(str(x) for x in lib.rglob("site-packages")) if lib.exists() else []
    return found


def project_packages(project: str, settings: dict) -> list[str]:
    """The packages of a project: those of its settings and of its layout; only if there are none are any discovered."""
    own = [*settings.get("packages", []), *detect_layout(project)]
    return list(dict.fromkeys(own)) or discover(project)


def project_files(
    spark: SparkSession, project: str, settings: dict, pattern: str = "*.py", scope: str | list[str] | None = None, method: str = "", defaults: dict[str, str] | None = None,
    aliases: dict[str, str | list[str]] | None = None, general: str | None = None, contents: bool = False,
) -> DataFrame:
    """(file, root, root_rank, module[, content]) of the files that a call of `method` sees: its scope, else the method's
    default, else the general one, else all; aliases become what they stand for; roots in their order, a file once."""
    roots = roots_table(spark, project, settings)
    asked = resolve_scope(scope, method, defaults or {}, aliases or {}, general)
    chosen = [r["root"] for r in roots_for(roots, asked).collect()]
    if not chosen:
        empty = spark.createDataFrame([], "file string, root string, root_rank int, module string, content string")
        return empty if contents else empty.drop("content")
    suffix = "." + pattern.rsplit(".", 1)[-1] if "." in pattern else ""
    found = source_files(spark, chosen, suffix)
    found = found.where(F.substring_index("file", "/", -1).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
    return found.select("file", "root", "root_rank", "module", *(["content"] if contents else []))


#: Roots that are tried first: packages and source folders, then the project itself, then namespaces.
_ROLES = {"package": 0, "src": 0, "main": 1, "namespace": 2}


def rooted(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files(file, ...) with root, root_rank and module: each at the root that names it. roots(root, role, namespace,
    precedence), role being package, src, main or namespace.

    A file's folders meet the roots by an equi-join; packages and source folders come before the project, which comes
    before namespaces, and of one kind the longest path. A module is named by its path below the root, after the name of
    a namespace unless its path begins with that, and after the project's own folder if that is a package itself. Files
    below no root, and those whose name would be no handle, are left out; root_rank is the root's precedence."""
    steps = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("_root"), "role", "namespace", F.col("precedence").cast("int").alias("_rank"))
    pairs = files.select("file").distinct().select("file", F.explode(above).alias("_root")).join(known, "_root")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), F.col("role"))
    best = pairs.groupBy("file").agg(F.min_by(F.struct(F.col("_root").alias("root"), "role", "namespace", F.col("_rank").alias("root_rank")), F.struct(kind, -F.length("_root"), "_rank")).alias("b")).select("file", "b.*")
    itself = files.select(F.regexp_replace("file", r"/__init__\.py$", "").alias("_pkg"), F.endswith("file", F.lit("/__init__.py")).alias("_is")).where("_is").select("_pkg").distinct()
    best = best.join(itself, (F.col("root") == F.col("_pkg")) & (F.col("role") == "main"), "left")
    inner = F.expr("substring(file, length(root) + 2)")
    path = F.when(F.col("_pkg").isNotNull(), F.concat(F.substring_index("root", "/", -1), F.lit("/"), inner)).otherwise(inner)
    dotted = F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    dotted = F.when(dotted == "", "__init__").otherwise(dotted)
    inside = (dotted == F.col("namespace")) | F.startswith(dotted, F.concat("namespace", F.lit(".")))
    name = F.when((F.col("role") == "namespace") & F.col("namespace").isNotNull() & ~inside, F.concat_ws(".", "namespace", dotted)).otherwise(dotted)
    return files.join(best.select("file", "root", "root_rank", name.alias("module")), "file").where(is_handle(F.col("module")))
