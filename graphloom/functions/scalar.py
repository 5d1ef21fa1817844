"""Scalar functions over handles, symbols, claims and paths: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HANDLE = r"^[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)*$"
#: Directory names whose files no scan sees.
EXCLUDED_DIRS = (
    ".venv", "venv", ".env", "env", "__pycache__", ".git", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "node_modules", ".eggs", "build", "dist", ".hg",
)


#: Directory names whose changes no watch reports.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".venv", "venv", ".env", "env",
    ".tox", ".nox", ".eggs", "dist", "build", ".idea", ".vscode",
)


def is_handle(c: Column) -> Column:
    return c.isNotNull() & c.rlike(HANDLE)


def parts(c: Column) -> Column:
    return F.split(c, r"\.")


def leaf(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def parent(c: Column) -> Column:
    """The handle without its last component; null for a bare name."""
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", ""))


def depth(c: Column) -> Column:
    return F.size(parts(c))


def prefixes(c: Column) -> Column:
    """All dotted prefixes, shortest first, the name itself included: turns `= t or startswith t.` into an equi-join."""
    return F.transform(F.sequence(F.lit(1), depth(c)), lambda k: F.array_join(F.slice(parts(c), 1, k), "."))


def posix_path(c: Column) -> Column:
    """A path with forward slashes, single ones, and without `.` steps and a slash at its end."""
    plain = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<=/|^)\./", ""), r"/\.$", "")
    return F.when(F.length(plain) > 1, F.regexp_replace(plain, "/$", "")).otherwise(plain)


def path_key(c: Column, base: str | Column = "/") -> Column:
    """One text for a path however it is written: absolute (from base), forward slashes, `.` and `..` steps taken. Links
    are resolved where files are listed, not here."""
    base = F.lit(base) if isinstance(base, str) else base
    path = posix_path(c)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(walk, "/"))


def same_path(a: Column, b: Column, base: str | Column = "/") -> Column:
    return path_key(a, base) == path_key(b, base)


def is_identifier(c: Column) -> Column:
    """A bare name: letters, digits and underscores, not a digit first."""
    return c.isNotNull() & c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def sanitize_text(c: Column, most: int = 10_000) -> Column:
    """Without NUL, cut to `most` characters, then without control characters except tab, line feed and carriage return."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "\\x00", ""), 1, most), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def identifier_form(c: Column) -> Column:
    """What an identifier asks for: file_line, file, dotted or bare, in that order. A file has a separator or ends in .py."""
    stem = F.regexp_replace(c, r":\d+$", "")
    pathlike = F.contains(stem, F.lit("/")) | F.contains(stem, F.lit("\\")) | F.endswith(stem, F.lit(".py"))
    return F.when(c.rlike(r":\d+$") & pathlike, "file_line").when(pathlike, "file").when(F.instr(c, ".") > 0, "dotted").otherwise("bare")


def symbol_class(c: Column) -> Column:
    """A guess at what a dotted name is, from how it is written."""
    last, first, n = leaf(c), F.element_at(parts(c), 1), depth(c)
    upper = (F.upper(F.substring(first, 1, 1)) == F.substring(first, 1, 1)) & (F.lower(F.substring(first, 1, 1)) != F.substring(first, 1, 1))
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(last == "__init__", "class_constructor")
        .when(F.startswith(last, F.lit("__")) & F.endswith(last, F.lit("__")), "magic_method")
        .when(F.startswith(last, F.lit("_")), "private_member")
        .when(n == 2, F.when(upper, "class_member").otherwise("module_function"))
        .when(n > 2, "qualified_member")
        .otherwise("simple_member")
    )


def relative_import(module: Column, target: Column, level: Column, is_package: Column) -> Column:
    """The absolute name of a relative import; null above the top package. Level 0 leaves the target as it is."""
    own = F.when(F.coalesce(module, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts(module))
    anchor = F.when(is_package, own).otherwise(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
    kept = F.size(anchor) - (level - 1)
    tail = F.when(F.coalesce(target, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts(target))
    name = F.array_join(F.concat(F.slice(anchor, 1, F.greatest(kept, F.lit(0))), tail), ".")
    return F.when(level <= 0, target).when(kept < 0, F.lit(None)).when(name == "", F.lit(None)).otherwise(name)


def import_text(target: Column, level: Column) -> Column:
    """An import target as written: dots, then the name."""
    return F.concat(F.repeat(F.lit("."), level), F.coalesce(target, F.lit("")))


def normal_claim(c: Column) -> Column:
    """Trimmed, white space collapsed, case folded."""
    return casefold(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def casefold(c: Column) -> Column:
    """Lower case, and what folding does beyond it, such as sharp s to ss. The table of such characters is derived from the
    character data; texts without any of them are only lowered."""
    low = F.lower(c)
    single, longer = _folded()
    plain = F.translate(low, "".join(single), "".join(single.values()))
    out = plain
    for a, b in longer.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(low.rlike(f"[{''.join(longer)}]"), out).otherwise(plain)


@cache
def _folded() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that folding changes: to one character, and to several. Beyond the basic plane none does."""
    every = {x: x.casefold() for x in map(chr, range(0x10000)) if x.lower() == x and x.casefold() != x}
    return {a: b for a, b in every.items() if len(b) == 1}, {a: b for a, b in every.items() if len(b) > 1}


def handle_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def non_issue_key(handles: Column, fact: Column) -> Column:
    return F.concat(F.lit("ni:"), F.sha2(F.concat(F.array_join(F.array_sort(handles), "|"), F.char(F.lit(0)), fact), 256))


def in_tests(handle: Column) -> Column:
    return F.exists(parts(handle), lambda s: (s == "tests") | F.startswith(s, F.lit("test_")))


def stops(handle: Column, scope: Column, when: dict) -> Column:
    """Does a node match stop_when: exclude_external, module_pattern (a substring), exclude_tests."""
    out = F.lit(False)
    if when.get("exclude_external"):
        out = out | (scope == "external")
    if when.get("module_pattern"):
        out = out | F.contains(handle, F.lit(when["module_pattern"]))
    if when.get("exclude_tests"):
        out = out | in_tests(handle)
    return F.coalesce(out, F.lit(False))


def module_name(path: Column, root: str) -> Column:
    """a/b/c.py under root -> a.b.c, a/b/__init__.py -> a.b; null outside the root."""
    base = root.rstrip("/") + "/"
    inner = F.regexp_replace(F.substring(path, len(base) + 1, 1 << 20), r"(/__init__)?\.py$", "")
    inner = F.when(inner == "__init__", F.lit("")).otherwise(inner)
    return F.when(F.startswith(path, F.lit(base)) & F.endswith(path, F.lit(".py")), F.replace(inner, F.lit("/"), F.lit(".")))


def excluded_path(path: Column) -> Column:
    """Any part of the path is an excluded directory or ends in .egg-info."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*EXCLUDED_DIRS) | F.endswith(p, F.lit(".egg-info")))


def path_scope(path: Column, project: str, roots: tuple[str, ...] = (), stdlib: tuple[str, ...] = ()) -> Column:
    """project or external, by the first rule that holds: build output, installed packages, standard library, a source
    root, anything else."""
    under = lambda r: (path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    inner = F.split(path, "/")
    built = F.exists(inner, lambda p: p.isin("__pycache__", ".tox", ".nox", ".eggs") | F.endswith(p, F.lit(".egg-info"))) | under(f"{project}/build") | under(f"{project}/dist")
    std = F.lit(False)
    for r in stdlib:
        std = std | under(r)
    own = under(project)
    for r in roots:
        own = own | under(r)
    return F.when(built, "external").when(F.exists(inner, lambda p: p.isin("site-packages", "dist-packages")), "external").when(std, "external").when(own, "project").otherwise("external")


def valid_position(line: Column, column: Column) -> Column:
    return line.between(1, 1_000_000) & column.between(0, 10_000)


def reexport_statements(handle: Column) -> Column:
    """`from <package> import <leaf>` for every package above the handle, shortest first."""
    p = parts(handle)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda k: F.concat(F.lit("from "), F.array_join(F.slice(p, 1, k), "."), F.lit(" import "), leaf(handle)))


def scope_suggestions(prefix: Column, known: Column) -> Column:
    """Known scopes that begin with what was typed, without regard to case."""
    return F.array_sort(F.filter(known, lambda s: F.startswith(F.lower(s), F.lower(prefix))))
