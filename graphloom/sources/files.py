"""Source trees, settings, JSON documents and metric exports: readers and writers."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EXCLUDED_DIRS, excluded_path, module_name

MOST_BYTES = 10 * 1024 * 1024


#: Folders that a task walks before it hands what is left back, to be dealt out anew.
FOLDERS = 2000
_LISTED = "uri string, file string, length long"


def listing(spark: SparkSession, root: str, recursive: bool = True, folders: int = FOLDERS) -> DataFrame:
    """(uri, file, length) of the files under a root. Spark's file sources hide names that begin with an underscore, so they
    would miss every package's __init__.py. The driver lists the root itself, executors what is below it: in rounds, each
    dealing the folders left over all tasks, so that one deep tree is walked by all. Small trees take one round. Names of
    folders that no scan enters are left out before they are walked."""
    from ..plans.checkpoints import cut

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files, below = [], []
    for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        at = f.getPath()
        if f.isFile():
            files.append((at.toString(), at.toUri().getPath(), f.getLen()))
        elif recursive and at.getName() not in EXCLUDED_DIRS:
            below.append((at.toString(), at.toUri().getPath()))
    out = spark.createDataFrame(files, _LISTED)
    left, n = spark.createDataFrame(below, "uri string, file string"), len(below)
    while n:
        tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
        found = cut(left.repartition(tasks).mapInArrow(_walk(max(1, folders // max(1, n // tasks))), _LISTED), "listing")
        out = out.unionByName(found.where("length IS NOT NULL"))
        left = found.where("length IS NULL").select("uri", "file")
        n = left.count()
    return out


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _walk(folders: int):
    """The files below each folder, by pyarrow's file systems, until so many folders are read; those left come without a
    length. A folder that can't be read has none."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for uri, path in zip(batch.column("uri").to_pylist(), batch.column("file").to_pylist()):
                todo, read = [""], 0
                system, base = _system(uri)
                while todo and read < folders:
                    step, read = todo.pop(), read + 1
                    try:
                        found = system.get_file_info(fs.FileSelector(base + step))
                    except OSError:
                        continue
                    todo += [f"{step}/{x.base_name}" for x in found if x.type == fs.FileType.Directory and x.base_name not in EXCLUDED_DIRS]
                    rows = [(f"{step}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File]
                    rows += [(t, None) for t in todo] if read == folders else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uri + r for r, _ in rows], pa.string()), pa.array([path + r for r, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["uri", "file", "length"]
                    )
                if todo and read == folders:
                    todo = []

    return run


def _contents(batches):
    """Contents by pyarrow's file systems on the executors; what can't be read or isn't UTF-8 has none, and says why."""
    import pyarrow as pa

    for batch in batches:
        texts, errors = [], []
        for uri in batch.column("uri").to_pylist():
            text = error = None
            try:
                system, path = _system(uri)
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError, pa.ArrowInvalid) as e:
                error = f"{type(e).__name__}: {e}"
            texts.append(text), errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("file", "root", "root_rank")] + [pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file", "root", "root_rank", "content", "error"])


def source_files(spark: SparkSession, roots: list[str], suffix: str = ".py", recursive: bool = True, contains: str | None = None, errors: bool = False) -> DataFrame:
    """(file, root, root_rank, module, content) of every file under the roots, a file once: at its first root. errors: files
    that can't be read are rows too, with null for content and an error; else they are skipped.

    Excluded directories, other suffixes and files over 10 MB are dropped before anything is read; `contains` is a
    pattern that a content must match, applied ahead of any parse."""
    out = None
    for rank, root in enumerate(roots):
        part = listing(spark, root, recursive).select("*", F.lit(root.rstrip("/")).alias("root"), F.lit(rank).alias("root_rank"))
        out = part if out is None else out.unionByName(part)
    ok = out.where(F.endswith("file", F.lit(suffix)) & (F.col("length") <= MOST_BYTES) & ~excluded_path(F.col("file")))
    first = ok.groupBy("file").agg(F.min_by(F.struct("uri", "root", "root_rank"), "root_rank").alias("b")).select("file", "b.*")
    files = first.mapInArrow(_contents, "file string, root string, root_rank int, content string, error string")
    files = files if errors else files.where("content IS NOT NULL").drop("error")
    if contains:
        files = files.where(text_matches(F.col("content"), contains))
    name = None
    for root in roots:
        here = F.when(F.col("root") == root.rstrip("/"), module_name(F.col("file"), root))
        name = here if name is None else F.coalesce(name, here)
    return files.withColumn("module", name)


def text_matches(content: Column, pattern: str) -> Column:
    """content holds the pattern; a pattern that doesn't compile is looked for as it is written."""
    try:
        re.compile(pattern)
    except re.error:
        return F.contains(content, F.lit(pattern))
    return content.rlike(pattern)


def read_settings(project: str, override: dict | None = None, home: str | None = None) -> dict:
    """Settings of a project: the global file, then the first project file there is, then the override, later keys first.
    JSON always; TOML from Python's own parser; YAML only if a parser is installed."""
    out: dict = {}
    for path in ([Path(home) / ".graphloom.json"] if home else []) + [Path(project) / n for n in ("graphloom.json", ".graphloom.json", "graphloom.toml", "graphloom.yaml", "pyproject.toml")]:
        if not path.is_file():
            continue
        text = path.read_text("utf-8")
        if path.suffix == ".json":
            found = json.loads(text)
        elif path.suffix == ".toml":
            import tomllib

            found = tomllib.loads(text)
            if path.name == "pyproject.toml":
                found = found.get("tool", {}).get("graphloom", {})
        else:
            try:
                import yaml
            except ImportError:
                continue
            found = yaml.safe_load(text) or {}
        if found:
            out |= found
            if path.parent == Path(project):
                break
    return out | (override or {})


def roots_table(spark: SparkSession, project: str, settings: dict) -> DataFrame:
    """(root, role, namespace, precedence): main, packages, namespaces and standalone roots, in order of precedence."""
    rows = [(project, "main", None)] + [(p, "package", None) for p in settings.get("packages", [])]
    rows += [(p, "namespace", n) for n, ps in sorted(settings.get("namespaces", {}).items()) for p in ps]
    rows += [(p, "standalone", None) for p in settings.get("standalone", {}).get("dirs", [])]
    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(seen.values())], "root string, role string, namespace string, precedence int")


def configure(settings: dict, packages: list[str] = (), namespaces: dict[str, list[str]] | None = None, standalone: list[str] = ()) -> dict:
    """Settings with packages appended, namespaces overwritten by name and standalone folders appended, each once."""
    out = dict(settings)
    out["packages"] = list(dict.fromkeys([*settings.get("packages", []), *packages]))
    out["namespaces"] = {**settings.get("namespaces", {}), **(namespaces or {})}
    out["standalone"] = {"dirs": list(dict.fromkeys([*settings.get("standalone", {}).get("dirs", []), *standalone]))}
    return out


def roots_for(roots: DataFrame, scope: str | list[str]) -> DataFrame:
    """The roots that a scope names: main, all, packages, namespaces (none: validates, but resolves to nothing),
    namespace:<name>, package:<path>, standalone; a list is the union."""
    c = F.lit(False)
    for s in [scope] if isinstance(scope, str) else scope:
        kind, _, name = s.partition(":")
        c = c | {
            "main": F.col("role") == "main", "all": F.lit(True), "packages": F.col("role") == "package", "namespaces": F.lit(False),
            "standalone": F.col("role") == "standalone", "namespace": (F.col("role") == "namespace") & (F.col("namespace") == name),
            "package": (F.col("role") == "package") & (F.col("root") == name),
        }.get(kind, F.lit(False))
    return roots.where(c).orderBy("precedence")


def scope_problem(scope: str, namespaces: list[str]) -> str | None:
    """Why a scope isn't valid, or None. `standalone` isn't, though it resolves."""
    kind, _, name = scope.partition(":")
    if kind == "namespace":
        return None if name in namespaces else f"unknown namespace {name!r}; known: {sorted(namespaces)}"
    return None if kind in ("main", "all", "packages", "namespaces", "package") else f"unknown scope {scope!r}"


def list_scopes(settings: dict, aliases: dict | None = None) -> dict[str, list[str]]:
    """The scopes that may be asked for, by what they are."""
    return {
        "predefined": ["main", "all", "packages", "namespaces"], "namespaces": [f"namespace:{n}" for n in settings.get("namespaces", {})],
        "packages": [f"package:{p}" for p in settings.get("packages", [])], "aliases": list(aliases or {}),
    }


def suggest_scopes(partial: str, settings: dict, aliases: dict | None = None) -> list[str]:
    """Scopes that begin with what is typed, whatever its case; packages aren't suggested."""
    known = list_scopes(settings, aliases)
    return [s for kind in ("predefined", "namespaces", "aliases") for s in known[kind] if s.lower().startswith(partial.lower())]


def explain_scope(roots: DataFrame, scope: str | list[str]) -> DataFrame:
    """(scope, root, role): what each of the asked scopes comes to; root is null for one that comes to nothing."""
    asked = roots.sparkSession.createDataFrame([(s,) for s in ([scope] if isinstance(scope, str) else scope)], "scope string")
    found = None
    for s in [scope] if isinstance(scope, str) else scope:
        rows = roots_for(roots, s).select(F.lit(s).alias("scope"), "root", "role")
        found = rows if found is None else found.unionByName(rows)
    return asked.join(found, "scope", "left")


def save_settings(project: str, settings: dict) -> None:
    """Settings as the project's JSON file, moved into place whole; readers see the old file or the new one."""
    path = Path(project) / ".graphloom.json"
    part = path.with_suffix(".json.part")
    part.write_text(json.dumps(settings, indent=2, sort_keys=True), "utf-8")
    part.replace(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines. Malformed ones are dropped, or with keep_bad kept in _corrupt_record."""
    if keep_bad:
        return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)
