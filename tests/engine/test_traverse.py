"""Traversals against small sequential models on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.plans import relational
from graphloom.plans.registry import IMPLEMENTED, REFUSED, registry, status

SMALL = "/root/testdata/sf0.001"


def graph(spark, r, n, kinds=("members", "callees")):
    nodes = [(f"n.x{i}", r.choice(["class", "module", "function"]), r.choice(["project", "project", "external"])) for i in range(n)]
    edges, k = [], {}
    for i in range(n):
        for kind in kinds:
            for j in dict.fromkeys(r.randrange(n) for _ in range(r.randint(0, 3))):
                k[i, kind] = k.get((i, kind), -1) + 1
                edges.append((f"n.x{i}", kind, f"n.x{j}", k[i, kind]))
    return nodes, edges


def model(nodes, edges, start, follow, max_depth, max_nodes, stopped):
    adj = {}
    for s, k, d, o in sorted(edges, key=lambda e: e[3]):
        adj.setdefault((s, k), []).append(d)
    depth, out, why, todo = {}, [], set(), deque()
    for h in start:
        if h in nodes and h not in depth:
            depth[h] = 0
            todo.append(h)
    while todo:
        h = todo.popleft()
        for k in follow:
            for d in adj.get((h, k), []):
                if d in depth:
                    out.append((h, d, k))
                elif d in stopped:
                    continue
                elif depth[h] >= max_depth:
                    why.add("max_depth")
                elif len(depth) >= max_nodes:
                    why.add("max_nodes")
                else:
                    depth[d] = depth[h] + 1
                    out.append((h, d, k))
                    todo.append(d)
    return depth, set(out), sorted(why)


@pytest.mark.parametrize("seed", range(4))
def test_trace_equals_the_sequential_walk(spark, seed):
    r = random.Random(seed)
    nodes, edges = graph(spark, r, 12)
    n = spark.createDataFrame(nodes, "handle string, kind string, scope string")
    e = spark.createDataFrame(edges, "src string, kind string, dst string, ord long")
    none = spark.createDataFrame([("n.x0", "callees", None), ("n.x0", "callees", None)], "src string, edge string, target string")
    depth, cap = r.randint(1, 4), r.randint(2, 12)
    ext = {h for h, _, s in nodes if s == "external"}
    want = model({h for h, _, _ in nodes}, edges, ["n.x0", "n.x1"], ["members", "callees"], depth, cap, ext)
    got = traverse.trace(n, e, none, ["n.x0", "n.x1", "n.gone"], ["members", "callees", "callers", "nonsense"], depth, cap, {"exclude_external": True})
    assert {x.handle: x.depth for x in got.nodes.collect()} == want[0]
    assert {tuple(x) for x in got.edges.collect()} == want[1]
    assert got.meta["truncation_reasons"] == want[2] and got.meta["unresolved_roots"] == ["n.gone"] and got.meta["unsupported_edges"] == ["callers", "nonsense"]
    assert [tuple(x) for x in got.unresolved_call_sites.collect()] == [("n.x0", 2)] and got.unresolved_imports is None


def outline_model(kinds, children, root, max_depth, max_nodes):
    count, rows, todo = 1, {0: None}, deque([(0, root, 0)])
    out, k = [], 1
    while todo:
        at, h, d = todo.popleft()
        kids = children.get(h, [])
        why, n = None, None
        if kinds[h][0] not in ("class", "module", "package"):
            pass
        elif kinds[h][1] == "external" and d >= 1:
            why = "external"
        elif d >= max_depth:
            why = "max_depth" if kids else None
        elif kids and count + len(kids) > max_nodes:
            why, n = "max_nodes", len(kids)
        elif kids:
            count += len(kids)
            for c in kids:
                todo.append((k, c, d + 1))
                k += 1
        out.append((at, h, d, why, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_outline_equals_the_sequential_fold(spark, seed):
    r = random.Random(seed)
    size = 25
    kinds = {f"n.x{i}": (r.choice(["class", "module", "method"]) if i else "module", r.choice(["project", "project", "external"]) if i else "project") for i in range(size)}
    children, edges = {}, []
    for i in range(1, size):
        p = f"n.x{r.randrange(i)}"
        edges.append((p, "members", f"n.x{i}", len(children.get(p, []))))
        children.setdefault(p, []).append(f"n.x{i}")
    n = spark.createDataFrame([(h, *k) for h, k in kinds.items()], "handle string, kind string, scope string")
    e = spark.createDataFrame(edges, "src string, kind string, dst string, ord long")
    depth, cap = r.randint(1, 4), r.randint(3, 20)
    got = traverse.outline(n, e, "n.x0", depth, cap).collect()
    assert sorted((x.ord, x.handle, x.depth, x.truncation_reason, x.member_count) for x in got) == outline_model(kinds, children, "n.x0", depth, cap)
    assert all((x.truncated is None) == (x.truncation_reason is None) for x in got)
    assert traverse.outline(n, e, "n.none").count() == 0


def test_outline_and_bases_broadcast_no_table(spark, monkeypatch):
    """Spark's estimate of one column of a large table lies below its broadcast limit."""
    plans, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df, *name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *name))[1])
    b = relational.bases(spark, SMALL)
    plans.append(b._jdf.queryExecution().executedPlan().toString())
    n = relational.read(spark, SMALL, "part").select(relational.part_handle(F.col("p_partkey")).alias("handle"), F.lit("class").alias("kind"), F.lit("project").alias("scope"))
    found = traverse.outline(n, relational.inheritance(spark, SMALL), "PARTS.P1", max_depth=5, max_nodes=20, kind="subclasses")
    assert [r.handle for r in found.orderBy("ord").collect()] == [f"PARTS.P{k}" for k in range(1, 20)]
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_expand_measured_empty_refused_and_unknown(spark):
    n = spark.createDataFrame([("a", "module", "project"), ("a.C", "class", "project"), ("a.C.f", "method", "project")], "handle string, kind string, scope string")
    e = spark.createDataFrame([("a", "members", "a.C", 0), ("a.C", "members", "a.C.f", 0)], "src string, kind string, dst string, ord long")
    u = spark.createDataFrame([("a.C.f", "callees", None), ("a.C.f", "callees", None), ("a", "imports", "x.y"), ("a", "imports", "x.y")], "src string, edge string, target string")
    ask = lambda h, k: traverse.expand(n, e, u, h, k)
    assert [r.handle for r in ask("a", "members").stubs.collect()] == ["a.C"]
    assert ask("a", "members").unresolved_call_sites is None and ask("a", "members").unresolved_imports is None
    assert ask("a.C.f", "callees").unresolved_call_sites.first()[0] == 2 and ask("a.C.f", "callees").stubs.count() == 0
    assert ask("a", "callees").unresolved_call_sites.first()[0] == 0
    assert [r.target for r in ask("a", "imports").unresolved_imports.collect()] == ["x.y"]
    assert ask("a.C", "imports").unsupported == "wrong_kind" and ask("gone", "members").stubs.count() == 0
    assert ask("gone", "callers").unsupported == "deferred_reference_backend" and ask("a", "x").unsupported == "unknown_edge"
    assert registry(spark).count() == len(IMPLEMENTED) + len(REFUSED) and status("members") == "implemented"


def test_plan_pushes_the_source_filter(spark, tmp_path):
    e = spark.createDataFrame([("a", "members", "b", 0)], "src string, kind string, dst string, ord long")
    e.write.parquet(f"{tmp_path}/e")
    n = spark.createDataFrame([("b", "class", "project")], "handle string, kind string, scope string")
    out = traverse.expand(n, spark.read.parquet(f"{tmp_path}/e"), spark.createDataFrame([], "src string, edge string, target string"), "a", "members")
    plan = out.stubs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src,a)" in plan and "EqualTo(kind,members)" in plan
    assert out.stubs.select(F.col("handle")).first()[0] == "b"
