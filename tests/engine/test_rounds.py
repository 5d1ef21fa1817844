import ast

from graphloom.operators import flow, resolve
from graphloom.sources import lexical


def _watched(monkeypatch, module, seen):
    """Every table that module writes, by name."""
    plain = module.cut

    def cut(df, name="cut", *more):
        out = plain(df, name, *more)
        seen.append((name, df, out))
        return out

    monkeypatch.setattr(module, "cut", cut)


def test_children_are_those_of_ast():
    text = "@d(1)\nasync def f(a: int = 1, *b, c=2, **k) -> x[y]:\n    async with a as q, b:\n        return [i for i in a if i < 2 and not b]\n    del q\nmatch z:\n    case {'k': [1, *r], **m} | C(n=2) as v if v: x += {**y, 'a': f'{x!r:>3}'}\ntype T[U] = list[U]\n"
    for node in ast.walk(ast.parse(text)):
        assert lexical.children(node) == [n for n in ast.iter_child_nodes(node) if not isinstance(n, (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop))]


def test_ended_chains_take_no_further_rounds(spark, monkeypatch):
    seen = []
    _watched(monkeypatch, resolve, seen)
    bindings = spark.createDataFrame([("a", "x", "b.x"), ("b", "x", "c.x"), ("p", "x", "q.x"), ("q", "x", "p.x"), ("o", "x", "p.x"), ("n", "x", "no.x")], "module string, surface string, target string")
    got = resolve.canonical(bindings, spark.createDataFrame([("c.x",)], "handle string"))
    assert sorted(map(tuple, got.collect())) == [("a.x", "c.x", 2), ("b.x", "c.x", 1)]
    assert sum(name == "pointers" for name, *_ in seen) == 3  # not one for each doubling up to 20 hops: what points into a circle is dropped a round after it


def test_searches_enter_only_names_that_go_round(spark, monkeypatch):
    seen = []
    _watched(monkeypatch, resolve, seen)
    stars = spark.createDataFrame([("p", 0, "api"), ("api", 0, "dead"), ("api", 1, "more"), ("dead", 0, "api"), ("more", 0, "via"), ("via", 0, "core")], "module string, ord int, source string")
    got = resolve.canonical(spark.createDataFrame([], "module string, surface string, target string"), spark.createDataFrame([("core.X",)], "handle string"), stars)
    assert sorted(map(tuple, got.collect())) == [("api.X", "core.X", 3), ("dead.X", "core.X", 4), ("more.X", "core.X", 2), ("p.X", "core.X", 4), ("via.X", "core.X", 1)]
    entered = {r["at"] for name, _, out in seen if name == "reach" for r in out.select("at").collect()}
    assert entered == {"p.X", "api.X", "dead.X"}


def test_rows_that_ask_for_nothing_are_not_joined(spark, monkeypatch):
    """An outer join sends all rows without a key to one task."""
    seen = []
    _watched(monkeypatch, flow, seen)
    nodes = spark.createDataFrame([("m", "module"), ("m.C", "class"), ("m.C.f", "method"), ("m.v", "variable")], "handle string, kind string")
    offered = spark.createDataFrame([("m", "C", "m.C", "C"), ("m", "v", "m.v", "V"), ("m.C", "f", "m.C.f", "F")], "owner string, step string, handle string, state string")
    refs = spark.createDataFrame([("a:m", ["C"]), ("a:m", ["v", "f"]), ("a:m", ["C", "()", "f"]), ("a:m", ["C", "()"]), ("a:m", ["gone"])], "head string, steps array<string>")
    flows = spark.createDataFrame([("m.v", "a:m|C.()")], "name string, key string")
    found, values = flow.evaluate(refs, offered, nodes, flows)
    assert sorted(map(tuple, found.collect())) == [("a:m|C", "m.C"), ("a:m|C.().f", "m.C.f"), ("a:m|v.f", "m.C.f")]
    assert [tuple(r) for r in values.collect()] == [("m.v", "I", "m.C")]
    rounds = [df._jdf.queryExecution().optimizedPlan().toString() for name, df, _ in seen if name == "references"]
    assert rounds and all("Join Inner" in p for p in rounds) and "LeftOuter" not in rounds[0]


def test_rows_of_a_key_meet_before_they_are_sorted(spark):
    """A sort of what a task reads, ahead of the shuffle, would take memory that grows with the input."""
    nodes = spark.createDataFrame([("m", "module"), ("m.C", "class"), ("m.C.f", "method"), ("m.v", "variable")], "handle string, kind string")
    names = spark.createDataFrame([("m.D", "m.C"), ("m.v", "m.C")], "alias string, handle string")
    offered = flow.offers(nodes, names, flow.own_members(nodes).where("owner = 'm.C'"))
    assert sorted(map(tuple, offered.collect())) == [("m", "C", "m.C", "C"), ("m", "D", "m.C", "C"), ("m", "v", "m.v", "V"), ("m.C", "f", "m.C.f", "F")]
    orders = spark.createDataFrame([("m.E", 0, "m.E"), ("m.E", 1, "m.C")], "handle string, ord int, name string")
    classes = spark.createDataFrame([("m.C",), ("m.E",)], "handle string")
    got = flow.inherited(classes, flow.own_members(nodes).where("owner = 'm.C'"), orders)
    assert sorted(map(tuple, got.collect())) == [("m.C", "f", "m.C.f", "method"), ("m.E", "f", "m.C.f", "method")]
    for table in (offered, got):
        plan = table._jdf.queryExecution().sparkPlan().toString()
        last = plan[plan.rindex("partial_m") :]  # a plan is written from its result down
        assert plan.count("partial_m") == 1 and last.split("\n")[1].lstrip(" :+-").startswith("Exchange hashpartitioning")
