"""expand, trace and outline over (nodes, edges, unresolved).

nodes(handle, kind, scope, ...), edges(src, kind, dst, ord), unresolved(src, edge, target)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stops
from ..plans.checkpoints import cut
from ..plans.registry import MODULE_ONLY, status


@dataclass
class Expanded:
    """supported: stubs, with the diagnostics that the edge has (else None). Not supported: why."""

    stubs: DataFrame | None
    unsupported: str | None = None
    unresolved_call_sites: DataFrame | None = None
    unresolved_imports: DataFrame | None = None
    transitive_hint: str | None = None


#: What expand says beside the direct subclasses of a class.
TRANSITIVE_HINT = "these are direct subclasses; trace from the class along subclasses for all of them"


def neighbours(nodes: DataFrame, edges: DataFrame, kind: str, sources: DataFrame | None = None) -> DataFrame:
    """(src, ord, handle, kind, scope, ...): one hop along one edge kind, for all sources or those of a table (src)."""
    e = edges.where(F.col("kind") == kind).select("src", "dst", "ord")
    if sources is not None:
        e = e.join(sources.select("src"), "src", "left_semi")
    return e.join(nodes.withColumnRenamed("handle", "dst"), "dst").withColumnRenamed("dst", "handle")


def expand(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, handle: str, edge: str) -> Expanded:
    """One hop. The status of the edge is judged before the handle is looked up; an unknown handle gives no stubs, 0
    unresolved call sites and, as its imports weren't measured, no list of unresolved ones; a handle of a kind that doesn't have the edge is refused for module edges and gives no stubs for the others."""
    if status(edge) != "implemented":
        return Expanded(None, status(edge))
    known = nodes.where(F.col("handle") == handle).select("kind").limit(1).collect()
    kind = known[0][0] if known else None
    if edge in MODULE_ONLY and kind not in (None, "module"):
        return Expanded(None, "wrong_kind")
    e = edges.where((F.col("src") == handle) & (F.col("kind") == edge)).select("dst", "ord")
    out = Expanded(e.join(nodes, e["dst"] == nodes["handle"]).drop("dst").orderBy("ord", "handle"))
    if edge == "subclasses" and kind == "class":
        out.transitive_hint = TRANSITIVE_HINT
    mine = unresolved.where((F.col("src") == handle) & (F.col("edge") == edge))
    if edge == "callees":
        out.unresolved_call_sites = mine.agg(F.count("*").alias("unresolved_call_sites"))
    elif edge == "imports" and kind:  # not measured for what isn't a parsed module
        out.unresolved_imports = mine.select("target").distinct().orderBy("target")
    return out


@dataclass
class Traced:
    nodes: DataFrame
    edges: DataFrame
    meta: dict
    unresolved_call_sites: DataFrame | None
    unresolved_imports: DataFrame | None


def trace(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, start: list[str], follow: list[str], max_depth: int = 3, max_nodes: int = 50, stop_when: dict | None = None) -> Traced:
    """Bounded breadth-first traversal, a join a level.

    Level d + 1 is what the edges of level d newly reach and stop_when lets pass, in the order of (rank of the parent,
    place of the edge in follow, ord), cut to what max_nodes leaves. Roots are neither stopped nor counted out. An edge
    is reported if both its ends are nodes. max_depth is a reason for truncation if a dropped node hangs on the deepest
    level, max_nodes if one hangs on a shallower one. Levels are bounded by max_nodes, so a frontier is small; the
    edges are only ever joined to it.
    """
    follow = list(dict.fromkeys(follow))
    supported = [e for e in follow if status(e) == "implemented"]
    spark = nodes.sparkSession
    place = {e: i for i, e in enumerate(supported)}
    order = F.element_at(F.create_map(*[F.lit(x) for e, i in place.items() for x in (e, i)]), F.col("kind")) if place else F.lit(0)
    roots = spark.createDataFrame([(h, i) for i, h in enumerate(dict.fromkeys(start))], "handle string, rank long")
    found = cut(roots.join(nodes.select("handle", "scope"), "handle").select("handle", F.lit(0).alias("depth"), "rank"))
    known = {r[0] for r in found.select("handle").collect()}  # as many as roots were given
    reach = edges.where(F.col("kind").isin(supported or [""])).withColumn("_f", order)
    target = nodes.select(F.col("handle").alias("dst"), stops(F.col("handle"), F.col("scope"), stop_when or {}).alias("_stop"))
    level, new_ones = found, len(known)
    count = new_ones
    for d in range(max_depth):
        if not new_ones or count >= max_nodes:
            break
        step = level.select(F.col("handle").alias("src"), "rank").join(reach, "src").join(target, "dst").where(~F.col("_stop"))
        step = step.join(found.select(F.col("handle").alias("dst")), "dst", "left_anti")
        new = step.groupBy("dst").agg(F.min(F.struct("rank", "_f", "ord", "dst")).alias("_at")).orderBy("_at").limit(max_nodes - count)
        # at most max_nodes rows are ranked together
        ranked = new.select(F.col("dst").alias("handle"), F.lit(d + 1).alias("depth"), (F.row_number().over(Window.orderBy("_at")) + F.lit(count)).cast("long").alias("rank"))
        level = cut(ranked)
        new_ones = level.count()
        count += new_ones
        found = found.unionByName(level)  # a union of checkpoints: no lineage grows
    ends = found.select(F.col("handle").alias("_h"), F.col("depth").alias("_d"), F.col("rank").alias("_r"))
    out = reach.join(ends, F.col("src") == F.col("_h")).join(target, "dst")
    inner = out.join(found.select(F.col("handle").alias("dst")), "dst", "left_semi")
    dropped = out.where(~F.col("_stop")).join(found.select(F.col("handle").alias("dst")), "dst", "left_anti")
    why = dropped.agg(F.max(F.col("_d") >= max_depth), F.max(F.col("_d") < max_depth)).first()
    reasons = [r for r, on in (("max_depth", why[0]), ("max_nodes", why[1])) if on]
    mine = unresolved.join(found.select(F.col("handle").alias("src")), "src", "left_semi")
    calls = mine.where("edge = 'callees'").groupBy("src").agg(F.count("*").alias("unresolved_call_sites")) if "callees" in supported else None
    imports = mine.where("edge = 'imports'").groupBy("src").agg(F.array_sort(F.collect_set("target")).alias("targets")) if "imports" in supported else None
    meta = {
        "truncated": bool(reasons), "truncation_reasons": reasons, "unresolved_roots": [h for h in dict.fromkeys(start) if h not in known],
        "unsupported_edges": [e for e in follow if e not in supported],
    }
    return Traced(
        found.join(nodes, "handle").orderBy("rank"),
        inner.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "_r", "_f", "ord").orderBy("_r", "_f", "ord").select("from", "to", "kind"),
        meta, calls, imports,
    )


def outline(nodes: DataFrame, edges: DataFrame, root: str, max_depth: int | None = None, max_nodes: int = 200, kind: str | None = None) -> DataFrame:
    """Budgeted tree walk, flat: (ord, parent, depth, handle, node_kind, scope, truncated, truncation_reason, member_count,
    leaf, place).

    A package root is surveyed: the walk follows submodules, plain modules are leaves, and without a depth one level is
    shown. Any other root is walked by members, to the end. `kind` asks for one of the two. A level is fetched by one
    join, with the number of members of each of its nodes, and folded in resolver order (ord): a node whose members
    don't fit the budget is cut whole and uses nothing up, so a later one may still fit; that fold is sequential. place
    is a node's place among its siblings as they are shown, by first line and handle. A tree walk doesn't drop handles
    that it met before. The walk holds at most max_nodes nodes; only members of nodes that are let in are fetched.
    """
    spark = nodes.sparkSession
    about = [c if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in (("is_package", "boolean"), ("line_start", "int"))]
    known = nodes.select("handle", F.col("kind").alias("node_kind"), "scope", *about)
    first = known.where(F.col("handle") == root).first()
    if first is None:
        return spark.createDataFrame([], _OUTLINE)
    if kind is None:
        survey = first["is_package"] or (first["is_package"] is None and first["node_kind"] == "module" and not edges.where((F.col("kind") == "submodules") & (F.col("src") == root)).isEmpty())
        kind = "submodules" if survey else "members"
        max_depth = 1 if survey and max_depth is None else max_depth
    # written once: each level reads it beside at most max_nodes handles. merge: Spark takes nodes for smaller than they are
    e = edges.where(F.col("kind") == kind).select("src", "dst", "ord")
    e = cut(e.join(known.select(F.col("handle").alias("dst")).hint("merge"), "dst", "left_semi"), "tree")

    def with_sizes(level: DataFrame) -> list[dict]:
        found = [r.asDict() for r in level.orderBy("_at", "_ord", "handle").collect()]
        asked = F.broadcast(spark.createDataFrame([(h,) for h in {r["handle"] for r in found}], "src string"))
        sizes = {r["src"]: r["n"] for r in e.join(asked, "src", "left_semi").groupBy("src").agg(F.count("*").alias("n")).collect()} if found else {}
        return [r | {"n": sizes.get(r["handle"])} for r in found]

    level = with_sizes(known.where(F.col("handle") == root).limit(1).withColumn("_at", F.lit(None).cast("long")).withColumn("_ord", F.lit(0).cast("long")))
    rows: list[dict] = []
    depth = 0
    while level:
        begin = len(rows)
        for r in level:
            rows.append({"ord": len(rows), "parent": r["_at"], "depth": depth, "handle": r["handle"], "node_kind": r["node_kind"], "scope": r["scope"], "line": r["line_start"] or 0, "place": 0})
        admitted, total = [], len(rows)
        for r, row in zip(level, rows[begin:]):
            k, why = r["n"] or 0, None
            if row["node_kind"] in ("class", "module", "package") and (kind == "members" or r["is_package"] is not False):
                if total >= max_nodes:
                    why = "max_nodes" if k else None
                elif row["scope"] == "external" and depth >= 1:
                    why = "external"
                elif max_depth is not None and depth >= max_depth:
                    why = "max_depth" if k else None
                elif k and total + k > max_nodes:
                    why = "max_nodes"
                elif k:
                    total += k
                    admitted.append(row)
            let = bool(admitted) and admitted[-1] is row
            row |= {"truncated": True if why else None, "truncation_reason": why, "member_count": k if why == "max_nodes" else None, "leaf": not why and not let}
        if not admitted:
            break
        frontier = spark.createDataFrame([(r["ord"], r["handle"]) for r in admitted], "_at long, src string")
        step = e.join(F.broadcast(frontier), "src").select("_at", F.col("ord").alias("_ord"), F.col("dst").alias("handle"))
        level = with_sizes(known.join(F.broadcast(step), "handle"))
        depth += 1
    seen: dict = {}
    for r in sorted(rows, key=lambda r: (r["line"], r["handle"])):
        r["place"] = seen[r["parent"]] = seen.get(r["parent"], -1) + 1
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in _OUTLINE.split(", ")) for r in rows], _OUTLINE)


_OUTLINE = "ord long, parent long, depth int, handle string, node_kind string, scope string, truncated boolean, truncation_reason string, member_count long, leaf boolean, place int"
