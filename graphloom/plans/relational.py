"""Code-graph tables over a relational hierarchy: regions hold nations, nations customers and suppliers, customers orders;
orders call parts; parts form a tree; nations import from nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sanitize_name
from .checkpoints import cut

#: Only such parts can be resolved: the declared rule that makes unresolved call sites.
RESOLVABLE = "p_size > 25"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, region, module) of every nation."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    region = sanitize_name(F.col("r_name"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", region.alias("region"), F.concat_ws(".", region, sanitize_name(F.col("n_name"))).alias("module"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, handle, ord, custkey): customers, then suppliers, of each nation; custkey is null for suppliers."""
    m = modules(spark, sf_dir)
    c = read(spark, sf_dir, "customer").join(m, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("module", F.concat(F.col("module"), F.lit(".C"), F.col("c_custkey").cast("string")).alias("handle"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("custkey"))
    s = read(spark, sf_dir, "supplier").join(m, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("module", F.concat(F.col("module"), F.lit(".S"), F.col("s_suppkey").cast("string")).alias("handle"), (F.col("s_suppkey") + F.lit(1 << 40)).alias("ord"), F.lit(None).cast("long").alias("custkey"))
    return c.unionByName(s)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, handle, orderkey)."""
    c = classes(spark, sf_dir).where("custkey IS NOT NULL").select(F.col("handle").alias("class"), "custkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("custkey")).select("class", F.concat(F.col("class"), F.lit(".O"), F.col("o_orderkey").cast("string")).alias("handle"), F.col("o_orderkey").alias("orderkey"))


def part_handle(c) -> F.Column:
    return F.concat(F.lit("PARTS.P"), c.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(handle, kind, scope)."""
    m = modules(spark, sf_dir)
    out = m.select(F.col("region").alias("handle"), F.lit("module").alias("kind"), F.lit("project").alias("scope")).distinct()
    out = out.unionByName(m.select(F.col("module").alias("handle"), F.lit("module").alias("kind"), F.lit("project").alias("scope")))
    out = out.unionByName(classes(spark, sf_dir).select("handle", F.lit("class").alias("kind"), F.lit("project").alias("scope")))
    out = out.unionByName(methods(spark, sf_dir).select("handle", F.lit("method").alias("kind"), F.lit("project").alias("scope")))
    return out.unionByName(read(spark, sf_dir, "part").select(part_handle(F.col("p_partkey")).alias("handle"), F.lit("class").alias("kind"), F.lit("external").alias("scope")))


def _edge(df: DataFrame, kind: str) -> DataFrame:
    return df.select("src", F.lit(kind).alias("kind"), "dst", F.col("ord").cast("long").alias("ord"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(spark, sf_dir).select(F.col("module").alias("src"), F.col("handle").alias("dst"), "ord")
    m = methods(spark, sf_dir).select(F.col("class").alias("src"), F.col("handle").alias("dst"), F.col("orderkey").alias("ord"))
    return _edge(c.unionByName(m), "members")


def submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(modules(spark, sf_dir).select(F.col("region").alias("src"), F.col("module").alias("dst"), F.col("n_nationkey").alias("ord")), "submodules")


def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(members(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("ord")), "enclosing_scope")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, l_linenumber, l_partkey, resolvable): the call sites of every order."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.expr(RESOLVABLE).alias("resolvable"))
    m = methods(spark, sf_dir).select(F.col("handle").alias("src"), "orderkey")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(m, F.col("l_orderkey") == F.col("orderkey")).select("src", "l_linenumber", "l_partkey", "resolvable")


def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each callee once, at its first site."""
    s = sites(spark, sf_dir).where("resolvable").groupBy("src", "l_partkey").agg(F.min(F.col("l_linenumber").cast("long") * (1 << 32) + F.col("l_partkey")).alias("ord"))
    return _edge(s.select("src", part_handle(F.col("l_partkey")).alias("dst"), "ord"), "callees")


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, edge, target): a row for each call site that can't be resolved, not one for each name."""
    return sites(spark, sf_dir).where("NOT resolvable").select("src", F.lit("callees").alias("edge"), F.lit(None).cast("string").alias("target"))


def nation_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, target): the customer's nation imports from the supplier's."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey").distinct()
    m = modules(spark, sf_dir)
    a, b = m.select(F.col("n_nationkey").alias("_a"), "module"), m.select(F.col("n_nationkey").alias("_b"), F.col("module").alias("target"))
    return pairs.join(a, F.col("c_nationkey") == F.col("_a")).join(b, F.col("s_nationkey") == F.col("_b")).select("module", "target")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(nation_imports(spark, sf_dir).select(F.col("module").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("ord")), "imports")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): part k is derived from part k div 2."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    up = F.floor(F.col("p_partkey") / 2).cast("long")
    there = p.select(F.col("p_partkey").alias("_p")).hint("merge")  # never broadcast: one column of a large table looks small
    return p.join(there, up == F.col("_p"), "left_semi").where(F.col("p_partkey") > 1).select(part_handle(F.col("p_partkey")).alias("child"), part_handle(up).alias("parent"), F.col("p_partkey").alias("ord"))


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bases(spark, sf_dir)
    return _edge(b.select(F.col("parent").alias("src"), F.col("child").alias("dst"), "ord"), "subclasses").unionByName(_edge(b.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(0).alias("ord")), "superclasses"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = members(spark, sf_dir)
    for more in (submodules, enclosing, callees, imports, inheritance):
        out = out.unionByName(more(spark, sf_dir))
    return out


def graph(spark: SparkSession, sf_dir: str, *kinds) -> tuple[DataFrame, DataFrame]:
    """nodes, and edges of the given kinds (functions of this module), each derived once and written, as a traversal reads
    them level by level."""
    e = None
    for kind in kinds:
        e = kind(spark, sf_dir) if e is None else e.unionByName(kind(spark, sf_dir))
    return cut(nodes(spark, sf_dir), "nodes"), cut(e, "edges", ("kind",))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metric calls: (name, key, seq, ts, duration_ms, error); a type 'error' or 'view' of odd value fails."""
    e = read(spark, sf_dir, "events")
    failed = F.floor("value").cast("long") % 3 == 0
    return e.select(F.col("event_type").alias("name"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("duration_ms"), F.when(failed, F.concat(F.lit("E_"), F.col("event_type"))).alias("error"))
