"""Python sources to fact tables: one parse a file, all facts from it."""

from __future__ import annotations

import ast

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import Lexical, children

SCHEMA = (
    "module string, file string, fact string, ord int, name string, full_name string, parent string, kind string, line int,"
    " col int, end_line int, target string, level int, flag boolean, items array<string>, text string, col_end int, head string, steps array<string>, root_rank int"
)
_NAMES = [f.split()[0] for f in SCHEMA.replace("\n", "").split(", ")]
#: Stands between the fields of a parameter: no annotation holds it.
UNIT = "\x1f"
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def dotted(node) -> str | None:
    """`a.b.c` of names and attributes, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def written_out(node) -> str:
    """The text of an expression; "" for one nested too deeply to be written out."""
    try:
        return ast.unparse(node)
    except RecursionError:
        return ""


def signature(node) -> str:
    out = f"({written_out(node.args)})"
    return out + (f" -> {written_out(node.returns)}" if node.returns else "")


def literal(node) -> str:
    """The text of a default that is a plain literal, else ""."""
    if node is None:
        return ""
    text = written_out(node)
    try:
        ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return ""
    return text


def parameters(node) -> list[str]:
    """name, kind, annotation and default of each parameter, apart by UNIT; a default that isn't a plain literal is left out."""
    a = node.args
    rows = []
    plain = [(p, "positional") for p in a.posonlyargs] + [(p, "positional_or_keyword") for p in a.args]
    gap = len(plain) - len(a.defaults)
    text = lambda x: "" if x is None else written_out(x)
    for i, (p, kind) in enumerate(plain):
        rows.append((p.arg, kind, text(p.annotation), literal(a.defaults[i - gap]) if i >= gap else ""))
    if a.vararg:
        rows.append((a.vararg.arg, "var_positional", text(a.vararg.annotation), ""))
    rows += [(p.arg, "keyword_only", text(p.annotation), literal(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        rows.append((a.kwarg.arg, "var_keyword", text(a.kwarg.annotation), ""))
    return [UNIT.join(r) for r in rows]


def constructor(node) -> str | None:
    """The arguments a class takes by its own __init__; None if it has none."""
    own = next((n for n in reversed(node.body) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == "__init__"), None)
    if own is None:
        return None
    args = ast.parse(f"def f({written_out(own.args)}): 0").body[0].args
    if args.posonlyargs or args.args:
        (args.posonlyargs or args.args).pop(0)
    total = len(args.posonlyargs) + len(args.args)
    args.defaults = args.defaults[len(args.defaults) - min(len(args.defaults), total) :]
    return f"({written_out(args)})"


def type_refs(node, at: str = "0") -> list[tuple[str, str, str]]:
    """(path, raw, head) of an annotation and its arguments, depth first. Unions are flat; strings are parsed as forward
    references; heads that aren't classes to follow (Callable, Literal, Annotated and the like) keep raw alone."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            node = ast.parse(node.value, mode="eval").body
        except SyntaxError:
            return [(at, node.value, "")]
    raw = written_out(node)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        flat, todo = [], [node]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr):
                todo += [n.right, n.left]
            else:
                flat.append(n)
        return [(at, raw, "Union"), *(r for i, n in enumerate(flat) for r in type_refs(n, f"{at}.{i}"))]
    if isinstance(node, ast.Subscript):
        head = dotted(node.value) or ""
        if head.rpartition(".")[2] in ("Callable", "Literal", "Annotated", "ParamSpec", "Concatenate", "TypeGuard"):
            return [(at, raw, "")]
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        return [(at, raw, head), *(r for i, n in enumerate(inner) for r in type_refs(n, f"{at}.{i}"))]
    return [(at, raw, dotted(node) or "")]


def facts_of(module: str, file: str, content: str | None) -> list[dict]:
    """All facts of one file; a file that can't be parsed is one parse_error."""
    rows: list[dict] = []
    count: dict[str, int] = {}

    def add(fact: str, **x) -> None:
        count[fact] = count.get(fact, -1) + 1
        rows.append({"module": module, "file": file, "fact": fact, "ord": count[fact], **x})

    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        add("parse_error", text=str(e))
        return rows
    add("file", line=1, end_line=(content or "").count("\n") + 1, text=ast.get_docstring(tree))
    package = file.endswith("/__init__.py") or file == "__init__.py"
    try:
        lexical = Lexical(module, package, tree, content or "", add)
    except RecursionError:  # expressions nested too deeply: the file's other facts stand
        lexical = None
        rows[:] = [r for r in rows if r["fact"] == "file"]
        count.clear(), count.update(file=0)
    means = lambda at, x: dict(zip(("head", "steps"), (getattr(lexical, at).get(id(x)) or (None, None)) if lexical else (None, None)))

    def imports(node, top: bool, owner: str) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                add("import", target=a.name, level=0, name=None, full_name=a.asname or a.name.split(".")[0], flag=top, parent=owner, line=node.lineno)
        else:
            for a in node.names:
                add("import", target=node.module, level=node.level, name=a.name, full_name=a.asname or a.name, flag=top, parent=owner, line=node.lineno, kind="package" if package else "module")

    def calls(fn, owner: str) -> None:
        todo = list(reversed(fn.body))
        while todo:
            n = todo.pop()
            if isinstance(n, _SCOPES):
                continue
            if isinstance(n, ast.Call):
                add("call", parent=owner, target=dotted(n.func), line=n.lineno, col=n.col_offset, items=[written_out(x) for x in n.args], flag=True, **means("called", n))
            todo += reversed(children(n))

    def visit(body, owner: str, inside: str | None, top: bool, scope) -> None:
        """top: are these statements of the module itself, not of a block within it? scope: the definition around them."""
        for node in body:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                imports(node, top, owner)
            elif isinstance(node, ast.ClassDef):
                full = f"{owner}.{node.name}"
                add("def", name=node.name, full_name=full, parent=owner, kind="class", line=node.lineno, col=node.col_offset, end_line=node.end_lineno, flag=False, target=constructor(node), text=ast.get_docstring(node))
                for i, b in enumerate(node.bases):
                    add("base", full_name=full, name=(dotted(b) or written_out(b)).split("[")[0].rpartition(".")[2], target=dotted(b if not isinstance(b, ast.Subscript) else b.value), level=i, line=node.lineno, **means("bases", b))
                decorators(node, full)
                visit(node.body, full, "class", False, node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                full = f"{owner}.{node.name}"
                kind = "method" if inside == "class" else "function"
                add("def", name=node.name, full_name=full, parent=owner, kind=kind, line=node.lineno, col=node.col_offset, end_line=node.end_lineno, flag=isinstance(node, ast.AsyncFunctionDef), target=signature(node), items=parameters(node), text=ast.get_docstring(node))
                decorators(node, full)
                calls(node, full)
                if node.returns is not None:
                    refs(full, "return", node.returns, node)
                for p in [*node.args.posonlyargs, *node.args.args, *([node.args.vararg] if node.args.vararg else []), *node.args.kwonlyargs, *([node.args.kwarg] if node.args.kwarg else [])]:
                    if p.annotation is not None:
                        refs(full, p.arg, p.annotation, node)
                visit(node.body, full, "function", False, node)
            else:
                if isinstance(node, (ast.Assign, ast.AnnAssign)):
                    assigned(node, owner, inside, scope)
                if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return)) and isinstance(node.value, ast.Call) and inside is None:
                    c = node.value
                    add("call", parent=owner, target=dotted(c.func), line=c.lineno, col=c.col_offset, items=[written_out(x) for x in c.args], flag=False)
                if inside is None and isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name) and node.target.id == "__all__":
                    exported(node.value)
                for field in ("body", "orelse", "finalbody"):
                    if below := getattr(node, field, None):
                        visit(below, owner, inside, False, scope)
                for h in [*(getattr(node, "handlers", None) or []), *(getattr(node, "cases", None) or [])]:
                    visit(h.body, owner, inside, False, scope)

    def refs(owner: str, name: str, annotation, at) -> None:
        """at: the definition whose surroundings the annotation is read in."""
        for path, raw, head in type_refs(annotation):
            where = lexical.scopes.get(id(at), lexical.top) if lexical else None
            to = lexical.dotted(where, head) if where and head else (None, None)
            add("type_ref", parent=owner, name=name, full_name=path, text=raw, target=head or None, head=to[0], steps=to[1])

    def decorators(node, full: str) -> None:
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            f = call.func if call else d
            first = call.args[0].value if call and call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str) else None
            methods = next(([e.value for e in k.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] for k in (call.keywords if call else []) if k.arg == "methods" and isinstance(k.value, ast.List)), None)
            mode = next((k.value.value for k in (call.keywords if call else []) if k.arg == "mode" and isinstance(k.value, ast.Constant)), None)
            args = [a.value for a in (call.args if call else []) if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            add("decorator", parent=full, name=dotted(f).rpartition(".")[2] if dotted(f) else None, target=dotted(f), text=first, items=methods if methods is not None else args, kind=mode, flag=methods is not None, line=node.lineno, level=int(call is not None))

    def single(targets: list) -> list:
        """Targets, those inside tuples too."""
        flat, todo = [], list(reversed(targets))
        while todo:
            t = todo.pop()
            if isinstance(t, (ast.Tuple, ast.List)):
                todo += reversed(t.elts)
            else:
                flat.append(t.value if isinstance(t, ast.Starred) else t)
        return flat

    def exported(value) -> None:
        """The names of a list that __all__ is, or grows by."""
        for e in value.elts if isinstance(value, (ast.List, ast.Tuple)) else []:
            if isinstance(e, ast.Constant) and isinstance(e.value, str):
                add("export", name=e.value, line=e.lineno)

    def assigned(node, owner: str, inside: str | None, at) -> None:
        value = node.value
        made = dotted(value.func) if isinstance(value, ast.Call) else None
        if inside is None and any(isinstance(t, ast.Name) and t.id == "__all__" for t in (node.targets if isinstance(node, ast.Assign) else [node.target])):
            exported(value)
        for t in single(node.targets if isinstance(node, ast.Assign) else [node.target]):
            name = dotted(t) if not isinstance(t, ast.Subscript) else dotted(t.value)
            if name:
                note = written_out(node.annotation) if isinstance(node, ast.AnnAssign) else None
                first = value.args[0].value if isinstance(value, ast.Call) and value.args and isinstance(value.args[0], ast.Constant) else None
                add("assign", name=name, full_name=f"{owner}.{name}", parent=owner, kind=inside or "module", target=made, text=note, flag=isinstance(node, ast.AnnAssign) and value is None, line=node.lineno, items=[str(first)] if first is not None else None)
                if "." not in name and inside in (None, "class"):
                    add("def", name=name, full_name=f"{owner}.{name}", parent=owner, kind="variable" if inside is None else "attribute", line=node.lineno, col=t.col_offset, end_line=node.end_lineno, flag=False, target=note, items=[literal(value)] if literal(value) else None)
        if isinstance(node, ast.AnnAssign):
            refs(owner, dotted(node.target) or "?", node.annotation, at)

    visit(tree.body, module, None, True, None)
    return rows


#: What a task parses at most: so many files, or so many characters of them. Facts are many times that, and are sorted by
#: kind as they are written.
FILES, CHARACTERS = 5_000, 4_000_000


def dealt(files: DataFrame, most: int = FILES, characters: int = CHARACTERS) -> DataFrame:
    """files(file, content, ...) over as many tasks as their number and lengths ask for. What lists or renders files has a
    few narrow rows, which Spark reads as one task however much parsing they bring."""
    n, length = files.agg(F.count("*"), F.coalesce(F.sum(F.length("content")), F.lit(0))).first()
    tasks = max(1, -(-n // most), -(-length // characters), min(n // 200, files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(tasks, "file")


def facts(files: DataFrame) -> DataFrame:
    """Facts of files(module, file, content[, root_rank]): one Python pass, a file at a time, over dealt(files); the errors
    of a file stay its own. root_rank: the place of the root that the file lies below; of two files of one module the
    earlier root's counts."""
    kinds = {"ord": pa.int32(), "line": pa.int32(), "col": pa.int32(), "end_line": pa.int32(), "level": pa.int32(), "flag": pa.bool_(), "items": pa.list_(pa.string()), "col_end": pa.int32(), "steps": pa.list_(pa.string()), "root_rank": pa.int32()}

    def run(batches):
        rows: list[dict] = []

        def out():
            columns = {n: [None] * len(rows) for n in _NAMES}
            for i, r in enumerate(rows):  # a row has few of them
                for n, x in r.items():
                    columns[n][i] = x
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.string())) for n, x in columns.items()], names=_NAMES)

        for batch in batches:
            for m, f, c, rank in zip(*(batch.column(x).to_pylist() for x in ("module", "file", "content", "root_rank"))):
                try:
                    found = facts_of(m, f, c)
                except RecursionError as e:  # nested too deeply for any pass over it
                    found = [{"module": m, "file": f, "fact": "parse_error", "ord": 0, "text": str(e)}]
                for r in found:
                    r["root_rank"] = rank
                rows += found
                if len(rows) > 10_000:
                    yield out()
        yield out()

    rank = F.coalesce(F.col("root_rank").cast("int"), F.lit(0)) if "root_rank" in files.columns else F.lit(0)
    return dealt(files.select("module", "file", "content", rank.alias("root_rank"))).mapInArrow(run, SCHEMA)


def of(table: DataFrame, fact: str) -> DataFrame:
    return table.where(F.col("fact") == fact)


def tables(table: DataFrame) -> Tables:
    """The tables of facts, by name; each is derived when it is first asked for."""
    return Tables(table)


class Tables:
    """nodes, edges of all eight kinds, unresolved and what else facts give, as t["nodes"]. The facts are written once to
    the shared folder, by fact, so that files are parsed once however many of these tables are read; edges_of() derives
    some kinds of edges only.

    What is called, inherited from or named is followed by references (operators.flow): through imports and re-exports,
    stars of stars, members that classes inherit, and the values of variables as far as constructors, annotations and
    returns tell them. What isn't found that way is counted as unresolved, never guessed. A file that can't be parsed is
    no node. Directories that hold modules without an __init__.py of their own are package nodes with the directory as
    file. Names of a module: a definition comes before an import, of which the last counts, one at the module's own level
    before one in a block; then come star imports in their order."""

    def __init__(self, table: DataFrame):
        from ..plans.checkpoints import cut

        every = cut(table, "facts", ("fact",))
        #: The files of all roots; of two of one module the earlier root's counts, then a package before a plain file.
        self.files = of(every, "file").select("module", "file", "root_rank", F.col("file").rlike(r"(^|/)__init__\.py$").alias("is_package"))
        order = F.struct("root_rank", ~F.col("is_package"), "file")
        first = self.files.groupBy("module").agg(F.min_by("file", order).alias("file"))
        hidden = cut(self.files.join(first, ["module", "file"], "left_anti").select("module", "file"), "hidden")
        self.facts = every if hidden.isEmpty() else every.join(hidden, ["module", "file"], "left_anti")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def _modules(self) -> tuple[DataFrame, DataFrame]:
        """Nodes of modules, and of the directories above them that are none."""
        from ..functions.scalar import prefixes

        files = of(self.facts, "file")
        package = F.col("file").rlike(r"(^|/)__init__\.py$")
        modules = files.select(
            F.col("module").alias("handle"), F.lit("module").alias("kind"), "file", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"), _none("string").alias("signature"),
            F.col("text").alias("docstring"), package.alias("is_package"), _none("boolean").alias("is_async"), _none("boolean").alias("is_classmethod"), _none("boolean").alias("is_staticmethod"),
            _none("array<string>").alias("parameters"), _none("string").alias("type"), _none("string").alias("default"),
        )
        above = files.select(F.explode(prefixes(F.col("module"))).alias("handle"), "module", "file", "root_rank").where("handle <> module")
        depth = F.size(F.split("module", r"\.")) - F.size(F.split("handle", r"\.")) + package.cast("int")
        folder = F.regexp_replace("file", F.concat(F.lit("(/[^/]*){"), depth.cast("string"), F.lit("}$")), F.lit(""))
        spaces = above.groupBy("handle").agg(F.min(F.struct("root_rank", folder.alias("file"))).getField("file").alias("file")).join(modules.select("handle"), "handle", "left_anti")
        spaces = spaces.select("handle", *[{"kind": F.lit("module"), "file": F.col("file"), "is_package": F.lit(True), "line_start": F.lit(1), "line_end": F.lit(1)}.get(f.name, _none(f.dataType)).alias(f.name) for f in modules.schema.fields[1:]])
        return modules, spaces

    @cached_property
    def plain(self) -> DataFrame:
        """nodes before classes show the constructors they inherit."""
        from ..plans.checkpoints import cut, gathered

        modules, spaces = self._modules
        marked = of(self.facts, "decorator").where("level = 0 AND name IN ('classmethod', 'staticmethod')")
        marks = marked.groupBy(F.col("parent").alias("full_name"), F.col("line").alias("_at")).agg(F.max(F.col("name") == "classmethod").alias("_c"), F.max(F.col("name") == "staticmethod").alias("_s"))
        marks = marks.groupBy("full_name").agg(F.max_by(F.struct("_c", "_s"), "_at").alias("_m"))
        # a later definition of a name replaces an earlier one
        last = gathered(of(self.facts, "def"), "full_name").groupBy("full_name").agg(F.max_by(F.struct("kind", "file", "line", "end_line", "target", "name", "text", "flag", "items"), "ord").alias("b")).select("full_name", "b.*").join(marks, "full_name", "left")
        function = F.col("kind").isin("function", "method")
        named, held = function | (F.col("kind") == "class"), F.col("kind").isin("variable", "attribute")
        last = last.select(
            F.col("full_name").alias("handle"), "kind", "file", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"), F.when(named, F.concat("name", "target")).alias("signature"),
            F.col("text").alias("docstring"), _none("boolean").alias("is_package"), F.when(function, F.col("flag")).alias("is_async"),
            F.when(function, F.coalesce("_m._c", F.lit(False))).alias("is_classmethod"), F.when(function, F.coalesce("_m._s", F.lit(False))).alias("is_staticmethod"),
            F.when(function, F.col("items")).alias("parameters"), F.when(held, F.col("target")).alias("type"), F.when(held, F.element_at("items", 1)).alias("default"),
        )
        return cut(modules.unionByName(spaces).unionByName(last).withColumn("scope", F.lit("project")), "nodes")

    @cached_property
    def nodes(self) -> DataFrame:
        """Nodes; a class without an __init__ of its own shows the first one that it inherits, without any in its whole
        order no arguments, and nothing where a base is unknown before one is found."""
        from ..operators.flow import linear
        from ..plans.checkpoints import gathered

        own = self.plain.where("kind = 'class'").select("handle", F.regexp_replace("signature", r"^[^(]*", "").alias("args"))
        # of a hidden base nothing is known: it stands behind the class that names it
        unknown = self.bases.where("dst IS NULL AND NOT (name <=> 'object')").select(F.col("owner").alias("_o")).distinct()
        order = linear(own, self.orders).join(own.select(F.col("handle").alias("name"), "args"), "name").join(unknown, F.col("name") == F.col("_o"), "left")
        first = gathered(order, "handle").groupBy("handle").agg(F.min(F.when(F.col("args").isNotNull(), F.struct("ord", "args"))).alias("a"), F.min(F.when(F.col("_o").isNotNull(), F.col("ord"))).alias("u"))
        args = first.select("handle", F.when(F.col("a").isNotNull() & (F.col("u").isNull() | (F.col("a.ord") <= F.col("u"))), F.col("a.args")).when(F.col("a").isNull() & F.col("u").isNull(), "()").alias("_args"))
        out = self.plain.join(args, "handle", "left")
        leaf = F.substring_index("handle", ".", -1)
        return out.withColumn("signature", F.coalesce("signature", F.concat(leaf, "_args"))).drop("_args")

    @cached_property
    def imports(self) -> DataFrame:
        from ..functions.scalar import relative_import

        full = relative_import(F.col("module"), F.col("target"), F.coalesce("level", F.lit(0)), F.coalesce(F.col("kind") == "package", F.lit(False)))
        return of(self.facts, "import").withColumn("source", full)

    @cached_property
    def canonical(self) -> DataFrame:
        from ..operators.resolve import canonical
        from ..plans.checkpoints import cut

        own = F.col("parent") == F.col("module")
        named = self.imports.where(own & F.expr("name IS NOT NULL AND name <> '*' AND source IS NOT NULL"))
        # the last at the module's own level, else the last in a block
        bindings = named.select("module", F.col("full_name").alias("surface"), F.concat_ws(".", "source", "name").alias("target"), F.struct("flag", "ord").alias("ord"))
        stars = self.imports.where(own & F.expr("name = '*' AND source IS NOT NULL")).select("module", "ord", "source")
        bound = named.where("flag").select(F.concat_ws(".", "module", "full_name").alias("handle"))
        # a variable that an import binds as well is the import
        defined = self.plain.where("kind <> 'variable'").select("handle").unionByName(self.plain.where("kind = 'variable'").select("handle").join(bound, "handle", "left_anti"))
        exports = of(self.facts, "export").select("module", "name").distinct()
        return cut(canonical(bindings, defined, stars, exports=exports), "canonical")

    @cached_property
    def _names(self) -> DataFrame:
        """(alias, handle) of all names that modules import, modules too."""
        whole = self.imports.where((F.col("parent") == F.col("module")) & F.col("name").isNull()).select("module", F.col("full_name").alias("surface"), F.when(F.col("full_name") == F.substring_index("target", ".", 1), F.col("full_name")).otherwise(F.col("target")).alias("handle"), "ord")
        whole = whole.groupBy("module", "surface").agg(F.max_by("handle", "ord").alias("handle"))
        return self.canonical.select("alias", "handle").unionByName(whole.select(F.concat_ws(".", "module", "surface").alias("alias"), "handle"))

    @cached_property
    def _static(self) -> DataFrame:
        """(key, handle) of what bases and annotations name: modules and nested classes only."""
        from ..operators.flow import evaluate, offers, own_members

        nodes = self.plain.select("handle", "kind")
        classes = nodes.where("kind = 'class'").select(F.col("handle").alias("owner"))
        offered = offers(nodes, self._names, own_members(nodes).join(classes, "owner", "left_semi"))
        return evaluate(of(self.facts, "base").select("head", "steps").unionByName(of(self.facts, "type_ref").select("head", "steps")), offered, nodes)[0]

    def _known(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows(head, steps, ...) with dst, the node that the reference means."""
        from ..operators.flow import key_of

        there = found.join(self.plain.select("handle"), "handle", "left_semi").select(F.col("key").alias("_k"), F.col("handle").alias("dst"))
        # what has no reference meets nothing, spread over all tasks
        key = F.coalesce(key_of(F.col("head"), F.col("steps")), F.concat(F.lit("|"), F.xxhash64(*rows.columns).cast("string")))
        return rows.withColumn("_r", key).join(there, F.col("_r") == F.col("_k"), "left").drop("_r", "_k", "head", "steps")

    @cached_property
    def bases(self) -> DataFrame:
        rows = of(self.facts, "base").select("module", F.col("full_name").alias("owner"), "target", F.col("level").alias("ord"), "name", "head", "steps")
        return self._known(rows, self._static)

    @cached_property
    def type_refs(self) -> DataFrame:
        rows = of(self.facts, "type_ref").select("parent", "ord", "name", F.col("full_name").alias("path"), F.col("text").alias("raw"), "head", "steps")
        return self._known(rows, self._static).select(F.col("parent").alias("owner"), "name", "path", "raw", F.col("dst").alias("handle"), "ord")

    @cached_property
    def orders(self) -> DataFrame:
        """(handle, ord, name): the resolution order of every class with bases in the project."""
        from ..operators.hierarchy import resolution_orders
        from ..plans.checkpoints import cut

        return cut(resolution_orders(self.bases.where("dst IS NOT NULL").select(F.col("owner").alias("child"), "ord", F.col("dst").alias("parent"))), "orders")

    @cached_property
    def _scene(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, offers) with properties, attributes of instances and inherited members."""
        from ..operators.flow import inherited, offers, own_members
        from ..plans.checkpoints import cut

        marks = of(self.facts, "decorator").where("name IN ('property', 'cached_property', 'setter')").select(F.col("parent").alias("handle")).distinct().withColumn("_p", F.lit(True))
        nodes = self.plain.join(marks, "handle", "left").select("handle", F.when(F.col("_p"), "property").otherwise(F.col("kind")).alias("kind"))
        nodes = cut(nodes, "kinds")
        classes = nodes.where("kind = 'class'").select("handle")
        members = own_members(nodes, of(self.facts, "attribute")).join(classes.select(F.col("handle").alias("owner")), "owner", "left_semi")
        above = self.facts.where("fact IN ('call', 'flow', 'name') AND head LIKE 'u:%'").select(F.expr("substring(head, 3)").alias("handle")).distinct()
        return nodes, offers(nodes, self._names, inherited(classes, members, self.orders, above))

    @cached_property
    def _followed(self) -> tuple[DataFrame, DataFrame | None]:
        """What calls mean, and the values of variables, attributes and returns."""
        from ..operators.flow import evaluate, key_of
        from ..plans.checkpoints import gathered

        nodes, offered = self._scene
        flow = of(self.facts, "flow")
        flows = flow.select(F.col("full_name").alias("name"), key_of(F.col("head"), F.col("steps")).alias("key"))
        flows = gathered(flows, "name").groupBy("name").agg(F.min("key").alias("key"))  # one file defines a name
        asked = of(self.facts, "call").where("flag").select("head", "steps").unionByName(flow.select("head", "steps"))
        return evaluate(asked, offered, nodes, flows)

    @cached_property
    def calls(self) -> DataFrame:
        """(owner, target, ord, dst): the calls in functions."""
        return self._known(of(self.facts, "call").where("flag").select(F.col("parent").alias("owner"), "target", "ord", "head", "steps"), self._followed[0])

    @cached_property
    def values(self) -> DataFrame:
        """(name, state, at): what variables, attributes (a dotted handle), versions of local variables (with #) and returns
        (with parentheses) hold: an instance (I) of a class, a class (C), a module (M) or a function (F)."""
        known = self._followed[1]
        return known if known is not None else self.facts.sparkSession.createDataFrame([], "name string, state string, at string")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(file, line, col_start, col_end, name, handle): every name in every file that stands for something known: local
        variables and parameters by their function, definitions by their own handle, imports and what is reached through
        them by the definition, builtins by `builtins`."""
        from ..operators.flow import evaluate, key_of
        from .lexical import BUILTINS

        names = of(self.facts, "name")
        nodes, offered = self._scene
        far = names.where("full_name IS NULL")
        found, _ = evaluate(far.select("head", "steps"), offered, nodes, values=self.values)
        hit = far.withColumn("_r", key_of(F.col("head"), F.col("steps"))).join(found.withColumnRenamed("key", "_r"), "_r", "left")
        builtin = F.substring("head", 1, 2).eqNullSafe("m:") & (F.size("steps") == 1) & F.col("name").isin(*sorted(BUILTINS))
        hit = hit.withColumn("handle", F.coalesce("handle", F.when(builtin, F.concat(F.lit("builtins."), "name")))).where("handle IS NOT NULL")
        columns = ("file", "line", F.col("col").alias("col_start"), "col_end", "name", "handle")
        return names.where("full_name IS NOT NULL").withColumn("handle", F.col("full_name")).select(*columns).unionByName(hit.select(*columns)).distinct()

    @cached_property
    def members(self) -> DataFrame:
        """(src, dst, ord): direct members; names that a module imports at its own level are none of its."""
        bound = self.imports.where("flag AND (name IS NULL OR name <> '*')").select(F.col("parent").alias("src"), F.concat_ws(".", "parent", "full_name").alias("dst"))
        every = of(self.facts, "def").groupBy(F.col("parent").alias("src"), F.col("full_name").alias("dst")).agg(F.min("ord").alias("ord"))
        return every.join(bound, ["src", "dst"], "left_anti")

    @cached_property
    def inherited_members(self) -> DataFrame:
        """(src, name, dst, defined_in): what a class has besides its own members, by its resolution order."""
        from ..functions.scalar import parent
        from ..operators.flow import inherited, own_members

        nodes = self.plain.select("handle", "kind")
        classes = nodes.where("kind = 'class'").select("handle")
        own = own_members(nodes).join(classes.select(F.col("handle").alias("owner")), "owner", "left_semi")
        got = inherited(classes, own, self.orders)
        return got.select(F.col("owner").alias("src"), F.col("step").alias("name"), F.col("handle").alias("dst"), parent(F.col("handle")).alias("defined_in")).where("src <> defined_in")

    @cached_property
    def _imported(self) -> DataFrame:
        """Imports at a module's own level with dst, the node each leads to."""
        from ..plans.checkpoints import gathered

        known = self.plain.select(F.col("handle").alias("alias"), "handle").unionByName(self.canonical.select("alias", "handle"))
        known = gathered(known, "alias").groupBy("alias").agg(F.min(F.struct(F.col("alias") != F.col("handle"), "handle")).alias("b"))
        top = self.imports.where("flag AND (name IS NULL OR name <> '*')").withColumn("want", F.when(F.col("name").isNull(), F.col("source")).otherwise(F.concat_ws(".", "source", "name")))
        return top.join(known.select(F.col("alias").alias("want"), F.col("b.handle").alias("dst")), "want", "left")

    def edges_of(self, *kinds: str) -> DataFrame:
        """(src, kind, dst, ord) of these kinds of edges."""
        made = None
        for kind in kinds:
            rows = getattr(self, f"_{kind}")().select("src", F.lit(kind).alias("kind"), "dst", F.col("ord").cast("long").alias("ord"))
            made = rows if made is None else made.unionByName(rows)
        return made

    @cached_property
    def edges(self) -> DataFrame:
        from ..plans.registry import IMPLEMENTED

        return self.edges_of(*IMPLEMENTED)

    def _members(self) -> DataFrame:
        return self.members

    def _enclosing_scope(self) -> DataFrame:
        every = of(self.facts, "def").select(F.col("full_name").alias("src"), F.col("parent").alias("dst")).distinct()
        return every.withColumn("ord", F.lit(0))

    def _callees(self) -> DataFrame:
        return self.calls.where("dst IS NOT NULL").groupBy(F.col("owner").alias("src"), "dst").agg(F.min("ord").alias("ord"))

    def _superclasses(self) -> DataFrame:
        """These, as the three kinds below, come in the order of their handles."""
        return self.bases.where("dst IS NOT NULL").select(F.col("owner").alias("src"), "dst", F.lit(0).alias("ord")).distinct()

    def _subclasses(self) -> DataFrame:
        return self._superclasses().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord")

    def _imports(self) -> DataFrame:
        return self._imported.where("dst IS NOT NULL").select(F.col("module").alias("src"), "dst", F.lit(0).alias("ord")).distinct()

    def _imported_by(self) -> DataFrame:
        from ..operators import dependencies

        every = self.imports.where("source IS NOT NULL").select("module", F.col("source").alias("target"), "name")
        modules, spaces = self._modules
        holders = modules.select(F.col("handle").alias("module")).unionByName(spaces.select(F.col("handle").alias("module")))
        return dependencies.imported_by(every, holders).withColumn("ord", F.lit(0))

    def _submodules(self) -> DataFrame:
        """Of split namespaces all portions count; of one child the first root's, in it a package before a module."""
        from ..functions.scalar import parent, prefixes
        from ..operators import dependencies

        # what each root holds: its files, and the folders above them that it has no file for
        own = self.files.select("module", "root_rank", F.when(F.col("is_package"), "package").otherwise("module").alias("kind"))
        folders = own.select(F.explode(prefixes(parent(F.col("module")))).alias("module"), "root_rank").distinct().withColumn("kind", F.lit("namespace"))
        listing = own.unionByName(folders).where(F.instr("module", ".") > 0)
        listing = listing.select(parent(F.col("module")).alias("package"), F.substring_index("module", ".", -1).alias("child"), "root_rank", "kind")
        return dependencies.submodules(listing).select(F.col("package").alias("src"), F.concat_ws(".", "package", "child").alias("dst"), F.lit(0).alias("ord"))

    def unresolved_of(self, edge: str) -> DataFrame:
        """(src, edge, target): call sites that lead nowhere (without a target), or imports that do (with it)."""
        if edge == "callees":
            return self.calls.where("dst IS NULL").select(F.col("owner").alias("src"), F.lit("callees").alias("edge"), _none("string").alias("target"))
        return self._imported.where("dst IS NULL").select(F.col("module").alias("src"), F.lit("imports").alias("edge"), F.concat(F.repeat(F.lit("."), F.coalesce("level", F.lit(0))), F.concat_ws(".", "target", "name")).alias("target"))

    @cached_property
    def unresolved(self) -> DataFrame:
        return self.unresolved_of("callees").unionByName(self.unresolved_of("imports"))


def _none(kind):
    return F.lit(None).cast(kind)
