"""Inheritance: direct and indirect subclasses, chains of base names, method resolution order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def closure(pairs: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(root, handle, depth): everything that child -> parent pairs (child, parent) reach from each root, with the least
    depth, however deep. start(root) narrows the roots.

    From all roots the depth doubles with each round: what lies exactly 2^k below a root reaches the rest of what lies up to
    2^(k+1) below by what is known already, so a chain of 5,000 takes 13 joins. From given roots two levels a round: a
    round joins only what the round before found to the pairs, which are written once. What an earlier round found is
    dropped; circles end that way."""
    up = cut(pairs.select(F.col("parent").alias("_p"), F.col("child").alias("_c")).where("_p <> _c").distinct(), "pairs")
    level = up.select(F.col("_p").alias("root"), F.col("_c").alias("handle"))
    if start is None:
        found, span = level.withColumn("depth", F.lit(1)), 1
        edge = found
        while True:
            right = found.select(F.col("root").alias("_r"), F.col("handle").alias("_h"), F.col("depth").alias("_d"))
            new = edge.join(right, F.col("handle") == F.col("_r")).select("root", F.col("_h").alias("handle"), (F.col("depth") + F.col("_d")).alias("depth")).where("root <> handle")
            new = cut(new.groupBy("root", "handle").agg(F.min("depth").alias("depth")).join(found.select("root", "handle"), ["root", "handle"], "left_anti"), "levels")
            found = found.unionByName(new)  # a union of written tables
            span *= 2
            edge = new.where(F.col("depth") == span)
            if edge.isEmpty():
                return found
    level = level.join(start.select("root").distinct(), "root", "left_semi")
    below = lambda df, d: df.join(up, F.col("handle") == F.col("_p")).select("root", F.col("_c").alias("handle"), F.lit(d).alias("depth")).where("root <> handle")
    found, d = None, 1
    level = level.withColumn("depth", F.lit(d))
    while True:
        two = level.unionByName(below(level.where(F.col("depth") == d), d + 1)).groupBy("root", "handle").agg(F.min("depth").alias("depth"))
        if found is not None:
            two = two.join(found.select("root", "handle"), ["root", "handle"], "left_anti")
        level = cut(two, "levels")
        found = level if found is None else found.unionByName(level)
        d += 2
        edge = level.where(F.col("depth") == d - 1)
        if edge.isEmpty():
            return found
        level = below(edge, d)


def subclasses(bases: DataFrame, base: str, indirect: bool = True) -> DataFrame:
    """(handle, is_direct, depth) of the classes below base, by handle. bases(child, parent) holds canonical handles."""
    if not indirect:
        return bases.where(F.col("parent") == base).select(F.col("child").alias("handle"), F.lit(True).alias("is_direct"), F.lit(1).alias("depth")).distinct().orderBy("handle")
    start = bases.sparkSession.createDataFrame([(base,)], "root string")
    return closure(bases, start).select("handle", (F.col("depth") == 1).alias("is_direct"), "depth").orderBy("handle")


def find_subclasses(name: str, classes: DataFrame, bases: DataFrame, names: DataFrame | None = None, indirect: bool = True, hierarchy: bool = False) -> tuple[list[str] | None, DataFrame | None]:
    """(candidates, subclasses): a simple name that several classes(name, handle) have gives their handles and no rows; a
    dotted name, or one that one class has, the rows of subclasses(), with `hierarchy` also chain: the least path of
    handles from the class up to the asked one. names(alias, handle) tells what re-exported dotted names mean."""
    known = classes.where(F.col("handle" if "." in name else "name") == name).select("handle").distinct()
    if "." in name and names is not None:
        known = known.unionByName(names.where(F.col("alias") == name).select("handle")).distinct()
    found = [r[0] for r in known.orderBy("handle").collect()]  # every class of this name
    if "." not in name and len(found) > 1:
        return found, None
    base = found[0] if found else name
    rows = subclasses(bases, base, indirect)
    if not hierarchy:
        return None, rows
    # the parent one level up, level by level: as many joins as there are levels
    tree = rows.unionByName(rows.sparkSession.createDataFrame([(base, False, 0)], rows.schema)).select("handle", "depth")
    chain = tree.where("depth = 0").select("handle", F.array("handle").alias("chain"))
    out, depth = [], rows.agg(F.max("depth")).first()[0] or 0
    for d in range(1, depth + 1):
        level = tree.where(F.col("depth") == d).join(bases.select(F.col("child").alias("handle"), "parent"), "handle").join(chain.select(F.col("handle").alias("parent"), F.col("chain").alias("_c")), "parent")
        chain = cut(level.groupBy("handle").agg(F.min(F.concat(F.array("handle"), "_c")).alias("chain")), "chain")
        out.append(chain)
    if not out:
        return None, rows.withColumn("chain", F.array("handle"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return None, rows.join(whole, "handle")


def superclasses(bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): direct bases that are nodes; of nodes with one handle those of kind class come first."""
    best = nodes.groupBy("handle").agg(F.min(F.struct(F.when(F.col("kind") == "class", 0).otherwise(1).alias("k"), "kind")).alias("b"))
    return bases.join(best, F.col("parent") == F.col("handle")).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()


def inheritance_chain(bases: DataFrame, base_names: DataFrame, child: str) -> DataFrame:
    """(ord, name): base names level by level, each simple name once, `object` last. base_names(child, ord, name, parent)."""
    spark = bases.sparkSession
    seen: list[str] = []
    level = spark.createDataFrame([(child, 0)], "src string, r long")
    while True:
        rows = level.join(base_names, F.col("src") == F.col("child")).orderBy("r", "ord").select("name", "parent").collect()
        new = [r for r in rows if r["name"] not in seen and r["name"] != "object"]
        seen += list(dict.fromkeys(r["name"] for r in new))
        follow = [r["parent"] for r in new if r["parent"]]
        if not follow:
            break
        level = spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(follow))], "src string, r long")
    return spark.createDataFrame([(i, n) for i, n in enumerate([*seen, "object"])], "ord int, name string")


def linearize(handle: str, bases: dict[str, list[str]]) -> list[str]:
    """C3: the class, then the merge of its bases' orders and its bases; what can't be merged follows as it stands."""
    held: dict[str, list[str]] = {}

    def order(name: str, path: frozenset[str]) -> list[str]:
        if name in held:
            return held[name]
        own = [b for b in bases.get(name, []) if b not in path]
        queues = [q for q in [*(order(b, path | {b}) for b in own), own[:]] if q]
        out = [name]
        while queues:
            head = next((q[0] for q in queues if not any(q[0] in x[1:] for x in queues)), None)
            if head is None:
                out += [n for q in queues for n in q if n not in out]
                break
            out.append(head)
            queues = [r for r in ([n for n in q if n != head] for q in queues) if r]
        out = list(dict.fromkeys(out))
        if len(own) == len(bases.get(name, [])):  # not cut short by a circle on the way here
            held[name] = out
        return out

    return order(handle, frozenset({handle}))


def merged_orders(name: str, bases: list[str], orders: list[list[str]]) -> list[str]:
    """C3 of a class whose bases' orders are finished: as linearize, in time linear in their lengths."""
    queues = [list(q) for q in (*orders, bases) if q]
    at, later = [0] * len(queues), {}
    for q in queues:
        for n in q[1:]:
            later[n] = later.get(n, 0) + 1
    out, left = [name], sum(map(len, queues))
    while left:
        head = next((q[i] for q, i in zip(queues, at) if i < len(q) and not later.get(q[i])), None)
        if head is None:
            rest = [n for q, i in zip(queues, at) for n in q[i:]]
            return list(dict.fromkeys([*out, *rest]))
        out.append(head)
        for k, q in enumerate(queues):
            if at[k] < len(q) and q[at[k]] == head:
                at[k] += 1
                left -= 1
                if at[k] < len(q):
                    later[q[at[k]]] -= 1
    return list(dict.fromkeys(out))


def resolution_orders(base_names: DataFrame) -> DataFrame:
    """(handle, ord, name): the method resolution order of every class with bases. base_names(child, ord, parent).

    Level by level: a class is merged once the orders of its bases are, by one join a level. Classes with one base need no
    merge, their order is their own name before their base's; whole chains of them are contracted by pointer doubling, so
    that only classes of several bases make levels. Classes on a circle, or below one, are merged one by one."""
    b = cut(base_names.groupBy("child", "parent").agg(F.min("ord").alias("ord")), "bases")
    number = b.groupBy("child").agg(F.count("*").alias("n"))
    several = cut(b.join(number.where("n > 1").select("child"), "child", "left_semi"), "several")
    # chains: (child, path, top), path from the child to the class before top, the first that isn't the child of one base
    chain = cut(b.join(number.where("n = 1").select("child"), "child", "left_semi").select("child", F.array("child").alias("path"), F.col("parent").alias("top"), F.lit(False).alias("ended")), "chains")
    rounds = max(1, chain.count()).bit_length() + 1
    while rounds:
        rounds -= 1
        up = chain.select(F.col("child").alias("_c"), F.col("path").alias("_p"), F.col("top").alias("_t"), F.col("ended").alias("_e"))
        nxt = chain.where("NOT ended").join(up, F.col("top") == F.col("_c"), "left")
        nxt = nxt.select("child", F.when(F.col("_c").isNull(), F.col("path")).otherwise(F.concat("path", "_p")).alias("path"), F.coalesce("_t", "top").alias("top"), (F.col("_c").isNull() | F.col("_e")).alias("ended"))
        chain = cut(nxt.unionByName(chain.where("ended")), "chains")
        if chain.where("NOT ended").isEmpty():
            break
    chain = chain.where("ended")  # the others run in a circle
    anchor = chain.select(F.col("child").alias("_c"), F.col("path").alias("_p"), F.col("top").alias("_t"))
    need = several.join(anchor, F.col("parent") == F.col("_c"), "left").select("child", "ord", "parent", F.coalesce("_p", F.array().cast("array<string>")).alias("path"), F.coalesce("_t", "parent").alias("anchor"))
    need = cut(need, "needs")
    roots = b.select(F.col("parent").alias("handle")).distinct().join(b.select(F.col("child").alias("handle")), "handle", "left_anti")
    done = cut(roots.select("handle", F.array("handle").alias("order")), "orders")
    merge = lambda batches: (_merge(x) for x in batches)
    while not need.isEmpty():
        have = done.select(F.col("handle").alias("anchor"), F.col("order").alias("_o"))
        met = need.join(have, "anchor", "left").groupBy("child").agg(
            F.array_sort(F.collect_list(F.struct("ord", "parent", F.concat("path", F.coalesce("_o", F.array().cast("array<string>"))).alias("order")))).alias("up"), F.count_if(F.col("_o").isNull()).alias("missing"),
        )
        new = cut(met.where("missing = 0").select("child", "up").mapInArrow(merge, "handle string, order array<string>"), "orders")
        if new.isEmpty():
            break  # circles
        done = done.unionByName(new)
        need = cut(need.join(new.select(F.col("handle").alias("child")), "child", "left_anti"), "needs")
    single = chain.join(done.select(F.col("handle").alias("top"), "order"), "top").select(F.col("child").alias("handle"), F.concat("path", "order").alias("order"))
    orders = done.join(several.select(F.col("child").alias("handle")).distinct(), "handle", "left_semi").unionByName(single)
    out = orders.select("handle", F.posexplode("order").alias("ord", "name"))
    odd = cut(b.select("child").distinct().join(orders.select(F.col("handle").alias("child")), "child", "left_anti"), "circular")
    return out if odd.isEmpty() else out.unionByName(_one_by_one(b, odd))


def _merge(batch):
    import pyarrow as pa

    names, orders = [], []
    for child, up in zip(batch.column("child").to_pylist(), batch.column("up").to_pylist()):
        names.append(child)
        orders.append(merged_orders(child, [x["parent"] for x in up], [x["order"] for x in up]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(orders, pa.list_(pa.string()))], names=["handle", "order"])


def _one_by_one(base_names: DataFrame, classes: DataFrame) -> DataFrame:
    """(handle, ord, name) of classes(child): each meets the bases of all its ancestors, and is one group."""
    pairs = base_names.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    ancestors = closure(pairs, classes.select(F.col("child").alias("root"))).select(F.col("root").alias("handle"), F.col("handle").alias("c"))
    own = classes.select(F.col("child").alias("handle"), F.col("child").alias("c"))
    facts = ancestors.unionByName(own).distinct().join(base_names.select(F.col("child").alias("c"), "ord", "parent"), "c")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[str, list[str]] = {}
        for c, _, p in sorted(zip(pdf["c"], pdf["ord"], pdf["parent"])):
            table.setdefault(c, []).append(p)
        handle = pdf["handle"].iloc[0]
        names = linearize(handle, table)
        return pd.DataFrame({"handle": handle, "ord": range(len(names)), "name": names})

    return facts.groupBy("handle").applyInPandas(one, "handle string, ord int, name string")
