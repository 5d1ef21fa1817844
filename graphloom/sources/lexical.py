"""Lexical scopes of one file: what each name in it stands for, as far as the file alone can tell.

A use of a name becomes a *reference*: a head and steps. Heads: `a:x` the module x (an import), `d:x` a definition of this
file, `v:x` one version of a local variable (each assignment makes one, so order counts), `s:x` an instance of class x
(self), `c:x` class x itself (cls), `u:x` what stands above x in its order (super()), `m:x` a name that module x doesn't bind
(it may come from a star import, or be a builtin). Steps are attribute names, and `()` for a call. Tables follow references
from file to file (operators.flow). Rows:

name  an occurrence: name, line, col, col_end and full_name, if this file defines it, else head and steps
flow  what a variable (full_name), a version of one or what a function returns (full_name with `()`) has as its value
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Callable

BUILTINS = frozenset(dir(builtins))
CALL = "()"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Subscripted names that stand for their (first) argument, and those that stand for the class itself.
_TRANSPARENT, _CLASS_OF = ("Optional", "Annotated", "Final", "ClassVar", "Required", "NotRequired", "Awaitable", "Coroutine"), ("type", "Type")

Reference = tuple[str, list[str]]


#: Fields that hold no node with a name, call or statement in it; by class of node the others.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "asname", "level", "module", "kind", "type_comment", "conversion", "simple", "is_async"}
_BELOW: dict[type, tuple[str, ...]] = {}


def children(node) -> list:
    """The nodes directly below one, as ast.iter_child_nodes gives them but for contexts and operators, in a third of its time."""
    fields = _BELOW.get(node.__class__)
    if fields is None:
        fields = _BELOW[node.__class__] = tuple(f for f in node._fields if f not in _PLAIN)
    out = []
    for f in fields:
        x = getattr(node, f, None)
        if x.__class__ is list:
            out += [n for n in x if isinstance(n, ast.AST)]
        elif isinstance(x, ast.AST):
            out.append(x)
    return out


def absolute(module: str, package: bool, target: str | None, level: int) -> str | None:
    """The module that an import names; None above the top."""
    if not level:
        return target
    parts = module.split(".")
    drop = level - (1 if package else 0)
    if drop > len(parts) or (drop == len(parts) and not target):
        return None
    return ".".join([*parts[: len(parts) - drop], *([target] if target else [])])


class Scope:
    """Names that a module, class or function binds."""

    def __init__(self, kind: str, handle: str, parent: Scope | None, owner: str | None = None):
        self.kind, self.handle, self.parent, self.owner = kind, handle, parent, owner
        self.bound: set[str] = set()
        self.outer: dict[str, str] = {}  # declared global or nonlocal
        self.now: dict[str, Reference | None] = {}
        self.versions: dict[str, int] = {}
        self.later: list[Callable[[], None]] = []
        self.returns: Reference | None = None
        self.yields = False


def bound_names(body: list) -> tuple[set[str], dict[str, str]]:
    """Names that the statements of one scope bind, and those it declares to be of another."""
    names, outer, todo = set(), {}, list(body)
    while todo:
        n = todo.pop()
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            names.add(n.name)
            todo += [*n.decorator_list, *(n.bases if isinstance(n, ast.ClassDef) else [*n.args.defaults, *(d for d in n.args.kw_defaults if d)])]
            continue
        if isinstance(n, ast.Lambda):
            continue
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            names |= {a.asname or a.name.split(".")[0] for a in n.names if a.name != "*"}
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            outer |= dict.fromkeys(n.names, "global" if isinstance(n, ast.Global) else "nonlocal")
        elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            names.add(n.id)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            names.add(n.name)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            names.add(n.name)
        elif isinstance(n, ast.MatchMapping) and n.rest:
            names.add(n.rest)
        elif isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            todo += [x for x in ast.walk(n) if isinstance(x, ast.NamedExpr)]
            continue
        todo += children(n)
    return names - set(outer), outer


class Lexical:
    """One pass over a parsed file. `called` has the reference of each call's function, `scopes` the scope that a
    definition's bases and annotations are written in, `heads` the references of dotted bases at that place."""

    def __init__(self, module: str, package: bool, tree: ast.Module, content: str, add: Callable):
        self.module, self.package, self.add = module, package, add
        self.lines = content.splitlines() if not content.isascii() else []
        self.called: dict[int, Reference | None] = {}
        self.bases: dict[int, Reference | None] = {}
        self.scopes: dict[int, Scope] = {}
        self.flows: dict[str, tuple[int, Reference]] = {}
        self.top = Scope("module", module, None)
        self.top.bound, _ = bound_names(tree.body)
        self.body(self.top, tree.body)
        self.finish(self.top)
        for handle, (line, (head, steps)) in self.flows.items():
            add("flow", full_name=handle, line=line, head=head, steps=steps)

    # occurrences

    def column(self, line: int, offset: int) -> int:
        """Offsets of the parser count bytes."""
        if not self.lines or line > len(self.lines) or self.lines[line - 1].isascii():
            return offset
        return len(self.lines[line - 1].encode()[:offset].decode(errors="ignore"))

    def seen(self, name: str, line: int, offset: int, reference: Reference | None, handle: str | None = None) -> None:
        if handle is None and reference is None:
            return
        col = self.column(line, offset)
        head, steps = reference if handle is None else (None, None)
        self.add("name", name=name, line=line, col=col, col_end=col + len(name), full_name=handle, head=head, steps=steps)

    # names

    def find(self, scope: Scope, name: str) -> tuple[Reference | None, str | None]:
        """What name stands for in scope: its reference, and its handle if this file defines it."""
        s, own = scope, True
        while s.kind != "module":
            if s.outer.get(name) == "global":
                s = self.top
                break
            if name in s.bound and (own or s.kind == "function"):
                at = s.now.get(name)
                if at is not None and at[0][0] == "d":
                    return at, at[0][2:]
                if "<" in s.handle:
                    return None, None  # of a lambda or comprehension
                return at, None if at is not None and at[0][0] == "a" else f"{s.handle}.{name}"
            s, own = s.parent, False
        at = s.now.get(name)
        if at is not None:
            return at, at[0][2:] if at[0][0] == "d" else None
        if name in s.bound:
            return ("d:" + f"{self.module}.{name}", []), f"{self.module}.{name}"
        return ("m:" + self.module, [name]), None

    def refer(self, scope: Scope, node) -> Reference | None:
        """The reference of an expression; None where tables can't follow."""
        if isinstance(node, ast.Name):
            return self.find(scope, node.id)[0]
        if isinstance(node, ast.Attribute):
            up = self.refer(scope, node.value)
            return (up[0], [*up[1], node.attr]) if up else None
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "super" and "super" not in self.top.bound:
                s = scope
                while s is not None and s.owner is None:
                    s = s.parent
                return ("u:" + s.owner, []) if s else None
            up = self.refer(scope, node.func)
            return (up[0], [*up[1], CALL]) if up else None
        if isinstance(node, (ast.Await, ast.NamedExpr, ast.Starred)):
            return self.refer(scope, node.value)
        return None

    def noted(self, scope: Scope, node) -> Reference | None:
        """The reference of a value that an annotation describes."""
        if isinstance(node, ast.Constant):
            if not isinstance(node.value, str):
                return None
            try:
                return self.noted(scope, ast.parse(node.value.strip(), mode="eval").body)
            except (SyntaxError, ValueError):
                return None
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            return self.noted(scope, node.left) or self.noted(scope, node.right)
        if isinstance(node, ast.Subscript):
            leaf = node.value.attr if isinstance(node.value, ast.Attribute) else getattr(node.value, "id", "")
            first = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
            if leaf in _TRANSPARENT:
                return self.noted(scope, node.slice.elts[-1] if leaf == "Coroutine" and isinstance(node.slice, ast.Tuple) else first)
            if leaf in _CLASS_OF:
                return self.refer(scope, first)
            if leaf == "Union":
                return next((x for x in (self.noted(scope, e) for e in (node.slice.elts if isinstance(node.slice, ast.Tuple) else [first])) if x), None)
            return self.noted(scope, node.value)
        if isinstance(node, (ast.Name, ast.Attribute)):
            if (node.attr if isinstance(node, ast.Attribute) else node.id) == "Self":
                s = scope
                while s is not None and s.owner is None and s.kind != "class":
                    s = s.parent
                return ("s:" + (s.owner or s.handle), []) if s else None
            up = self.refer(scope, node)
            return (up[0], [*up[1], CALL]) if up else None
        return None

    # bindings

    def bind(self, scope: Scope, name: str, reference: Reference | None, line: int, noted: bool = False) -> str:
        """A variable gets a value; its handle."""
        s = scope
        while s.outer.get(name) == "nonlocal" and s.parent is not None and s.parent.kind != "module":
            s = s.parent
            while s.kind == "class" and s.parent is not None:
                s = s.parent
        if s.outer.get(name) == "global":
            s = self.top
        handle = f"{s.handle}.{name}"
        if s.kind == "function":
            k = s.versions[name] = s.versions.get(name, 0) + 1
            s.now[name] = (f"v:{handle}#{k}", [])
            if reference is not None:
                self.flows[f"{handle}#{k}"] = (line, reference)
        else:
            s.now[name] = ("d:" + handle, [])
            if reference is not None:
                self.flows[handle] = (line, reference)
            elif not noted:
                self.flows.pop(handle, None)  # the last value counts, and it isn't known
        return handle

    def assign(self, scope: Scope, target, value, reference: Reference | None, line: int, noted: bool = False) -> None:
        if isinstance(target, ast.Name):
            handle = self.bind(scope, target.id, reference, line, noted)
            self.seen(target.id, target.lineno, target.col_offset, None, handle)
        elif isinstance(target, (ast.Tuple, ast.List)):
            parts = value.elts if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) and not any(isinstance(e, ast.Starred) for e in [*value.elts, *target.elts]) else [None] * len(target.elts)
            values = [self.refer(scope, v) if v is not None else None for v in parts]  # all before any is bound
            for t, v, r in zip(target.elts, parts, values):
                self.assign(scope, t, v, r, line)
        elif isinstance(target, ast.Starred):
            self.assign(scope, target.value, None, None, line)
        else:
            self.expression(scope, target)
            up = self.refer(scope, target.value) if isinstance(target, ast.Attribute) else None
            if up is not None and up[0][:2] in ("s:", "c:") and not up[1]:
                handle = f"{up[0][2:]}.{target.attr}"
                self.add("attribute", name=target.attr, full_name=handle, parent=up[0][2:], line=line)
                if reference is not None and handle not in self.flows:  # the first value that is known
                    self.flows[handle] = (line, reference)

    # statements

    def body(self, scope: Scope, statements: list) -> None:
        for n in statements:
            self.statement(scope, n)

    def finish(self, scope: Scope) -> None:
        """Bodies of functions see what their surroundings end up with."""
        for run in scope.later:
            run()

    def statement(self, scope: Scope, n) -> None:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            self.imports(scope, n)
        elif isinstance(n, ast.ClassDef):
            self.class_(scope, n)
        elif isinstance(n, _FUNCTIONS):
            self.function(scope, n)
        elif isinstance(n, ast.Assign):
            self.expression(scope, n.value)
            reference = self.refer(scope, n.value)
            for t in n.targets:
                self.assign(scope, t, n.value, reference, n.lineno)
        elif isinstance(n, ast.AnnAssign):
            self.expression(scope, n.annotation)
            if n.value is not None:
                self.expression(scope, n.value)
            self.assign(scope, n.target, n.value, self.noted(scope, n.annotation) or (self.refer(scope, n.value) if n.value is not None else None), n.lineno, True)
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            self.expression(scope, n.iter)
            self.assign(scope, n.target, None, None, n.lineno)
            self.body(scope, n.body)
            self.body(scope, n.orelse)
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            for item in n.items:
                self.expression(scope, item.context_expr)
                if item.optional_vars is not None:
                    up = self.refer(scope, item.context_expr)
                    enter = "__enter__" if isinstance(n, ast.With) else "__aenter__"
                    self.assign(scope, item.optional_vars, None, (up[0], [*up[1], enter, CALL]) if up else None, n.lineno)
            self.body(scope, n.body)
        elif isinstance(n, (ast.Try, ast.TryStar)):
            self.body(scope, n.body)
            for h in n.handlers:
                if h.type is not None:
                    self.expression(scope, h.type)
                if h.name:
                    self.bind(scope, h.name, self.noted(scope, h.type) if isinstance(h.type, (ast.Name, ast.Attribute)) else None, h.lineno)
                self.body(scope, h.body)
            self.body(scope, n.orelse)
            self.body(scope, n.finalbody)
        elif isinstance(n, ast.Match):
            self.expression(scope, n.subject)
            for case in n.cases:
                for p in ast.walk(case.pattern):
                    name = p.rest if isinstance(p, ast.MatchMapping) else getattr(p, "name", None)
                    if name:
                        self.bind(scope, name, None, p.lineno)
                    elif isinstance(p, ast.MatchClass):
                        self.expression(scope, p.cls)
                if case.guard is not None:
                    self.expression(scope, case.guard)
                self.body(scope, case.body)
        elif isinstance(n, ast.Return):
            if n.value is not None:
                self.expression(scope, n.value)
                if scope.kind == "function" and scope.returns is None:
                    scope.returns = self.refer(scope, n.value)
        else:
            for child in children(n):
                if isinstance(child, ast.stmt):
                    self.statement(scope, child)
                elif isinstance(child, ast.expr):
                    self.expression(scope, child)

    def imports(self, scope: Scope, n) -> None:
        home = self.top if scope.kind == "module" else scope

        def put(name: str, reference: Reference) -> None:
            (self.top if scope.outer.get(name) == "global" else home).now[name] = reference

        if isinstance(n, ast.Import):
            for a in n.names:
                at, parts = a.col_offset, a.name.split(".")
                for k, part in enumerate(parts):
                    self.seen(part, a.lineno, at, ("a:" + ".".join(parts[: k + 1]), []))
                    at += len(part) + 1
                if a.asname:
                    put(a.asname, ("a:" + a.name, []))
                    self.seen(a.asname, a.end_lineno, a.end_col_offset - len(a.asname), ("a:" + a.name, []))
                else:
                    put(parts[0], ("a:" + parts[0], []))
            return
        source = absolute(self.module, self.package, n.module, n.level)
        if source is None:
            for a in n.names:
                put(a.asname or a.name, ("m:", [a.name]))  # nothing above the top
            return
        if n.module:
            at, parts, first = n.col_offset + len("from ") + n.level, n.module.split("."), len(source.split(".")) - len(n.module.split("."))
            for k, part in enumerate(parts):
                self.seen(part, n.lineno, at, ("a:" + ".".join(source.split(".")[: first + k + 1]), []))
                at += len(part) + 1
        for a in n.names:
            if a.name == "*":
                continue
            reference = ("a:" + source, [a.name])
            put(a.asname or a.name, reference)
            self.seen(a.name, a.lineno, a.col_offset, reference)
            if a.asname:
                self.seen(a.asname, a.end_lineno, a.end_col_offset - len(a.asname), reference)

    def class_(self, scope: Scope, n: ast.ClassDef) -> None:
        handle = f"{scope.handle}.{n.name}"
        for x in [*n.decorator_list, *n.bases, *(k.value for k in n.keywords)]:
            self.expression(scope, x)
        for b in n.bases:
            self.bases[id(b)] = self.refer(scope, b.value if isinstance(b, ast.Subscript) else b)
        self.scopes[id(n)] = scope
        self.seen(n.name, n.lineno, n.col_offset + len("class "), None, handle)
        inner = Scope("class", handle, scope)
        inner.bound, inner.outer = bound_names(n.body)
        self.body(inner, n.body)
        (self.top if scope.outer.get(n.name) == "global" else scope).now[n.name] = ("d:" + handle, [])
        scope.later.append(lambda: self.finish(inner))

    def function(self, scope: Scope, n) -> None:
        handle = f"{scope.handle}.{n.name}"
        for x in [*n.decorator_list, *n.args.defaults, *(d for d in n.args.kw_defaults if d is not None)]:
            self.expression(scope, x)
        self.scopes[id(n)] = scope
        self.seen(n.name, n.lineno, n.col_offset + len("async def " if isinstance(n, ast.AsyncFunctionDef) else "def "), None, handle)
        (self.top if scope.outer.get(n.name) == "global" else scope).now[n.name] = ("d:" + handle, [])
        marks = {d.id for d in n.decorator_list if isinstance(d, ast.Name)}
        cls = scope.handle if scope.kind == "class" else None

        def run() -> None:
            inner = Scope("function", handle, scope, cls)
            inner.bound, inner.outer = bound_names(n.body)
            a = n.args
            plain = [*a.posonlyargs, *a.args]
            defaults = dict(zip((p.arg for p in plain[len(plain) - len(a.defaults) :]), a.defaults)) | {p.arg: d for p, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None}
            for k, p in enumerate([*plain, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]):
                inner.bound.add(p.arg)
                if p.annotation is not None:
                    self.expression(scope, p.annotation)
                if k == 0 and plain and cls and "staticmethod" not in marks:
                    inner.now[p.arg] = (("c:" if "classmethod" in marks or n.name in ("__new__", "__init_subclass__", "__class_getitem__") else "s:") + cls, [])
                    self.seen(p.arg, p.lineno, p.col_offset, None, f"{handle}.{p.arg}")
                    continue
                starred = p is a.vararg or p is a.kwarg
                known = None if starred else self.noted(scope, p.annotation) if p.annotation is not None else self.refer(scope, defaults[p.arg]) if p.arg in defaults else None
                self.seen(p.arg, p.lineno, p.col_offset, None, self.bind(inner, p.arg, known, p.lineno))
            if n.returns is not None:
                self.expression(scope, n.returns)
            self.body(inner, n.body)
            given = self.noted(scope, n.returns) if n.returns is not None else None if inner.yields else inner.returns
            if given is not None:
                self.flows[handle + CALL] = (n.lineno, given)
            self.finish(inner)

        scope.later.append(run)

    # expressions

    def expression(self, scope: Scope, n) -> None:
        if isinstance(n, ast.Name):
            reference, handle = self.find(scope, n.id)
            self.seen(n.id, n.lineno, n.col_offset, reference, handle)
        elif isinstance(n, ast.Attribute):
            self.expression(scope, n.value)
            self.seen(n.attr, n.end_lineno, n.end_col_offset - len(n.attr), self.refer(scope, n))
        elif isinstance(n, ast.Call):
            self.expression(scope, n.func)
            self.called[id(n)] = self.refer(scope, n.func)
            for x in [*n.args, *(k.value for k in n.keywords)]:
                self.expression(scope, x)
        elif isinstance(n, ast.NamedExpr):
            self.expression(scope, n.value)
            home = scope
            while home.kind == "function" and home.handle.endswith(">") and home.parent is not None:
                home = home.parent  # out of comprehensions
            self.assign(home, n.target, n.value, self.refer(scope, n.value), n.lineno)
        elif isinstance(n, ast.Lambda):
            inner = Scope("function", f"{scope.handle}.<lambda>", scope)
            for x in [*n.args.defaults, *(d for d in n.args.kw_defaults if d is not None)]:
                self.expression(scope, x)
            for p in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *([n.args.vararg] if n.args.vararg else []), *([n.args.kwarg] if n.args.kwarg else [])]:
                inner.bound.add(p.arg)
            self.expression(inner, n.body)
        elif isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            inner = Scope("function", f"{scope.handle}.<comprehension>", scope)
            for k, g in enumerate(n.generators):
                self.expression(inner if k else scope, g.iter)
                names, _ = bound_names([g.target])
                inner.bound |= names
                for x in ast.walk(g.target):
                    if isinstance(x, ast.Attribute):
                        self.expression(inner, x)
                for x in g.ifs:
                    self.expression(inner, x)
            for x in [n.key, n.value] if isinstance(n, ast.DictComp) else [n.elt]:
                self.expression(inner, x)
        else:
            if isinstance(n, (ast.Yield, ast.YieldFrom)):
                scope.yields = True
            for child in children(n):
                if isinstance(child, ast.expr):
                    self.expression(scope, child)

    def dotted(self, scope: Scope, name: str) -> Reference:
        """The reference of a dotted name as it stands at the end of scope."""
        head, *rest = name.split(".")
        up = self.find(scope, head)[0]
        return (up[0], [*up[1], *rest]) if up else ("m:", [name])
