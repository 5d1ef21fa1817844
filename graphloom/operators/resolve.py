"""Names to nodes: resolve, resolve_at, canonical names, re-exports, inspect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import parent, reexport_statements
from ..plans.checkpoints import cut, gathered

HOPS = 20


def canonical(bindings: DataFrame, defined: DataFrame, stars: DataFrame | None = None, hops: int = HOPS, exports: DataFrame | None = None) -> DataFrame:
    """(alias, handle, hops) for every name that a chain of at most `hops` re-exports leads to a definition.

    bindings(module, surface, target[, ord]), defined(handle), stars(module, ord, source). A definition beats an explicit
    import, of which the last (ord) counts; a name with neither comes from the first star import that leads to a
    definition, through stars of stars; a star gives what exports(module, name), the source's __all__, lists, without one
    all names but those with an underscore in front. Chains are followed by pointer doubling: each round composes the table with
    itself, so 20 hops take five joins; a chain that runs in a circle ends nowhere and is dropped.
    """
    own = defined.select(F.col("handle").alias("alias")).distinct()
    last = F.max_by("target", "ord") if "ord" in bindings.columns else F.min("target")
    named = bindings.withColumn("alias", F.concat_ws(".", "module", "surface"))
    explicit = gathered(named, "alias").groupBy("alias").agg(last.alias("next")).join(own, "alias", "left_anti")
    if stars is None or stars.isEmpty():
        ends = own.select(F.col("alias").alias("next"), F.lit(True).alias("_e"))
        return _followed(explicit.join(ends, "next", "left").select("alias", "next", F.col("_e").isNotNull().alias("end")), hops)
    own, explicit, stars = cut(own, "defined"), cut(explicit, "explicit"), cut(stars.select("module", F.col("ord").cast("long").alias("ord"), "source").distinct(), "stars")
    every = _alternatives(explicit, own, stars, exports)
    first = cut(gathered(every, "alias").groupBy("alias").agg(F.min_by(F.struct("next", "end"), "ord").alias("b")).select("alias", "b.*"), "first")
    straight = cut(_followed(first, hops), "names")
    # What the first alternatives lead round in a circle: the search of each such name, in order and without return.
    lost = cut(first.join(straight.select("alias"), "alias", "left_anti").select("alias"), "lost")
    if lost.isEmpty():
        return straight
    return straight.unionByName(_searched(lost, every, straight).where(F.col("hops") <= hops))


def _followed(step: DataFrame, hops: int) -> DataFrame:
    """(alias, handle, hops) of single steps(alias, next, end) that lead to a definition; end: next is one. A round takes
    on what has not ended yet, and drops what goes nowhere or comes back to itself."""
    pointer = cut(step.where("alias <> next").select("alias", "next", F.lit(1).alias("n"), "end"), "pointers")
    found, active, span = pointer.where("end"), pointer.where("NOT end"), 1
    while span < hops and not active.isEmpty():
        on = found.unionByName(active).select(F.col("alias").alias("_a"), F.col("next").alias("_n"), F.col("n").alias("_k"), F.col("end").alias("_e"))
        now = active.join(on, F.col("next") == F.col("_a")).select("alias", F.col("_n").alias("next"), (F.col("n") + F.col("_k")).alias("n"), F.col("_e").alias("end"))
        now = cut(now.where("alias <> next"), "pointers")
        found, active = found.unionByName(now.where("end")), now.where("NOT end")
        span *= 2
    return found.where(F.col("n") <= hops).select("alias", F.col("next").alias("handle"), F.col("n").alias("hops"))


def _alternatives(explicit: DataFrame, own: DataFrame, stars: DataFrame, exports: DataFrame | None) -> DataFrame:
    """(alias, ord, next, end): the steps that lead to a definition, of every name that reaches one; end: next is one. A
    semi-naive fixpoint: a round takes only the names that the round before found through the explicit imports of them and
    the stars of their modules."""
    listed = cut(exports.select(F.col("module").alias("_m"), F.col("name").alias("_leaf")), "exports") if exports is not None else None
    if listed is not None and listed.isEmpty():
        listed = None
    taken = own.unionByName(explicit.select("alias"))
    via = stars.select("module", "ord", F.col("source").alias("_m"))

    def starred(names: DataFrame) -> DataFrame:
        leaf = F.substring_index("alias", ".", -1)
        inner = names.where(F.instr("alias", ".") > 0).select(parent(F.col("alias")).alias("_m"), leaf.alias("_leaf"), F.col("alias").alias("next"))
        public = ~F.startswith("_leaf", F.lit("_"))
        if listed is None:
            inner = inner.where(public)
        else:
            marks = listed.select("_m").distinct().withColumn("_all", F.lit(True)), listed.withColumn("_in", F.lit(True))
            inner = inner.join(marks[0], "_m", "left").join(marks[1], ["_m", "_leaf"], "left").where(F.col("_in") | (F.col("_all").isNull() & public)).drop("_all", "_in")
        return inner.join(via, "_m").select(F.concat_ws(".", "module", "_leaf").alias("alias"), "ord", "next").join(taken, "alias", "left_anti")

    every, later, new = None, None, own
    while True:
        direct = explicit.join(new.select(F.col("alias").alias("next")), "next", "left_semi").select("alias", F.lit(-1).cast("long").alias("ord"), "next")
        steps = cut(direct.unionByName(starred(new)).withColumn("end", F.lit(every is None)), "alternatives")
        every = steps if every is None else every.unionByName(steps)
        new = steps.select("alias").distinct()  # none is a definition
        new = cut(new if later is None else new.join(later, "alias", "left_anti"), "reached")
        if new.isEmpty():
            return every
        later = new if later is None else later.unionByName(new)


def _searched(lost: DataFrame, every: DataFrame, straight: DataFrame) -> DataFrame:
    """(alias, handle, hops) of names whose first alternatives go round: depth first over what each reaches, alternatives in
    their order, no name entered twice. A name of straight(alias, handle, hops) ends a search as a definition does: none of
    its first steps was entered before. A group is the lost names that one reaches through a circle of star imports."""
    known = straight.select(F.col("alias").alias("next"), F.lit(True).alias("_s"))
    ways = every.join(lost, "alias", "left_semi").join(known, "next", "left")
    ways = cut(ways.select(F.col("alias").alias("at"), "ord", "next", (F.col("end") | F.col("_s").isNotNull()).alias("end")), "ways")
    step = ways.where("NOT end").select(F.col("at").alias("_a"), "next")
    reach, new = None, lost.select("alias", F.col("alias").alias("at"))
    while True:
        new = new if reach is None else new.join(reach, ["alias", "at"], "left_anti")
        new = cut(new, "reach")
        if new.isEmpty():
            break
        reach = new if reach is None else reach.unionByName(new)
        new = new.join(step, F.col("at") == F.col("_a")).select("alias", F.col("next").alias("at")).distinct()
    edges = reach.join(ways, "at").select("alias", "at", "ord", "next", "end")
    # groups are many and small: they stream past in order, one is held
    found = edges.repartition("alias").sortWithinPartitions("alias", "at", "ord", "next").mapInArrow(_first_ways, "alias string, handle string, hops int")
    rest = straight.select(F.col("alias").alias("handle"), F.col("handle").alias("_h"), F.col("hops").alias("_k"))
    return found.join(rest, "handle", "left").select("alias", F.coalesce("_h", "handle").alias("handle"), (F.col("hops") + F.coalesce("_k", F.lit(0))).alias("hops"))


def _first_ways(batches):
    """(alias, handle, hops) of edges(alias, at, next, end) that come by alias, and within it in the order of their steps."""
    import pyarrow as pa

    def made(rows: list[tuple[str, str, int]]):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))], names=["alias", "handle", "hops"])

    start, ways, ends = None, {}, set()
    for batch in batches:
        found = []
        for alias, at, to, end in zip(*(batch.column(x).to_pylist() for x in ("alias", "at", "next", "end"))):
            if alias != start:
                found += _first_way(start, ways, ends)
                start, ways, ends = alias, {}, set()
            ways.setdefault(at, []).append(to)
            if end:
                ends.add(to)
        yield made(found)
    yield made(_first_way(start, ways, ends))


def _first_way(start: str | None, ways: dict[str, list[str]], ends: set[str]) -> list[tuple[str, str, int]]:
    """The definition that start leads to, depth first; none if it leads to none."""
    seen, path = {start}, [iter(ways.get(start, ()))]
    while path:
        to = next(path[-1], None)
        if to is None:
            path.pop()
        elif to in ends:
            return [(start, to, len(path))]
        elif to not in seen:
            seen.add(to)
            path.append(iter(ways.get(to, ())))
    return []


def re_exports(canonical_names: DataFrame) -> DataFrame:
    """(handle, re_exports): every alias within the handle's top package, sorted."""
    top = F.substring_index("handle", ".", 1)
    mine = canonical_names.where((F.substring_index("alias", ".", 1) == top) & (F.col("alias") != F.col("handle")))
    return mine.groupBy("handle").agg(F.array_sort(F.collect_set("alias")).alias("re_exports"))


def with_import_paths(nodes: DataFrame, canonical_names: DataFrame) -> DataFrame:
    """nodes with the statements that import each: from those of its own packages that do offer it, shortest first, from
    its module, then from every other re-export by name."""
    name = F.substring_index("alias", ".", -1)
    said = F.concat(F.lit("from "), parent(F.col("alias")), F.lit(" import "), name)
    above = F.startswith("handle", F.concat(parent(F.col("alias")), F.lit("."))) & (name == F.substring_index("handle", ".", -1))
    extra = canonical_names.where(F.instr("alias", ".") > 0).groupBy("handle").agg(
        F.array_sort(F.collect_set(F.when(above, F.struct(F.length("alias").alias("n"), said.alias("s"))))).alias("_own"), F.array_sort(F.collect_set(F.when(~above, said))).alias("_x"),
    )
    none = F.array().cast("array<string>")
    direct = F.slice(reexport_statements(F.col("handle")), -1, 1)
    paths = F.concat(F.coalesce(F.transform("_own", lambda x: x["s"]), none), F.when(F.instr("handle", ".") > 0, direct).otherwise(none), F.coalesce("_x", none))
    return nodes.join(extra, "handle", "left").withColumn("import_paths", F.array_distinct(paths)).drop("_own", "_x")


def bare_names(names: DataFrame, defs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every asked name (name): name, found, ambiguous, handle, n, reason.

    One match is the answer. Of several, a dotless top package is promoted if the candidates that are one share exactly
    one handle and one file. None: not found."""
    hit = names.join(defs.select("name", F.col("full_name").alias("handle")), "name", "left").join(nodes.select("handle", "file"), "handle", "left")
    top = F.instr("handle", ".") == 0
    g = hit.groupBy("name").agg(
        F.count("handle").alias("n"), F.max("handle").alias("_one"),
        F.count_distinct(F.when(top, F.col("handle"))).alias("_tops"), F.count_distinct(F.when(top, F.col("file"))).alias("_files"), F.max(F.when(top, F.col("handle"))).alias("_top"),
    )
    promoted = (F.col("_tops") == 1) & (F.col("_files") == 1)
    single = (F.col("n") == 1) | promoted
    return g.select(
        "name", single.alias("found"), ((F.col("n") > 1) & ~promoted).alias("ambiguous"),
        F.when(F.col("n") == 1, F.col("_one")).when(promoted, F.col("_top")).alias("handle"), "n",
        F.when(F.col("n") == 0, "unresolved").alias("reason"),
    )


def candidates(name: str, defs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What an ambiguous name may mean: project before external, then by file and line."""
    hit = defs.where(F.col("name") == name).select(F.col("full_name").alias("handle"))
    return hit.join(nodes, "handle").orderBy(F.when(F.col("scope") == "project", 0).otherwise(1), "file", "line_start", "handle")


def resolve_at(positions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """positions(file, line, column) with the handle of the occurrence(file, line, col_start, col_end, handle) that
    covers them; null if there is none. Lines are equi-join keys, columns a range within a line."""
    o = occurrences.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "col_start", "col_end", "handle")
    on = (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")) & (F.col("column") >= F.col("col_start")) & (F.col("column") < F.col("col_end"))
    inner = positions.join(o, on, "left")
    tight = inner.groupBy("file", "line", "column").agg(F.min(F.struct((F.col("col_end") - F.col("col_start")).alias("w"), "handle")).alias("b"))
    return tight.select("file", "line", "column", F.col("b.handle").alias("handle"))


def namespace_anchor(names: DataFrame, spaces: DataFrame) -> DataFrame:
    """(name, handle, file) of names (name) that are top-level namespace packages of spaces(namespace, roots): anchored at
    the first root's directory of that name. Only names of which no match has a file may ask."""
    here = F.concat_ws("/", F.element_at("roots", 1), "namespace")
    return names.join(spaces.select(F.col("namespace").alias("name"), here.alias("file")), "name").select("name", F.col("name").alias("handle"), "file")


def external_names(names: DataFrame, stubs: DataFrame) -> DataFrame:
    """(name, handle, kind) of dotted names (name) that a stub table of installed packages knows: stubs(module, leaf, target,
    kind) says what `leaf` means in `module`, target being its own definition, or null if it is defined there."""
    asked = names.where(F.instr("name", ".") > 0).select("name", parent(F.col("name")).alias("module"), F.substring_index("name", ".", -1).alias("leaf"))
    hit = asked.join(stubs, ["module", "leaf"])
    best = hit.groupBy("name").agg(F.min(F.struct(F.coalesce("target", "name").alias("handle"), "kind")).alias("b"))
    return best.select("name", "b.handle", "b.kind")


def resolve(
    identifier: str, nodes: DataFrame, defs: DataFrame, canonical_names: DataFrame, occurrences: DataFrame | None = None, spaces: DataFrame | None = None, stubs: DataFrame | None = None
) -> DataFrame:
    """One row: found, ambiguous, handle, candidates, reason. Forms by priority: path:line, path, dotted name, bare name.

    A line is asked at the column of the name it defines, if it defines one, else at its first occurrence, else at what
    stands at column 0. A dotted name that the project doesn't define is looked up in the stub table, a bare name of
    which no match has a file among the namespace packages."""
    spark = nodes.sparkSession
    schema = "found boolean, ambiguous boolean, handle string, candidates array<string>, reason string"
    m = re.fullmatch(r"(.+):(\d+)", identifier)
    path = m[1] if m else identifier
    if "/" in path or "\\" in path or path.endswith(".py"):
        module = nodes.where((F.col("file") == path) & (F.col("kind") == "module")).select("handle").limit(1).collect()
        if not nodes.where(F.col("file") == path).limit(1).count():
            return spark.createDataFrame([(False, False, None, None, "file_not_found")], schema)
        if m:
            here = nodes.where((F.col("file") == path) & (F.col("line_start") == int(m[2])) & (F.col("kind") != "module")).orderBy("handle").select("handle").limit(1).collect()
            if not here and occurrences is not None:
                here = occurrences.where((F.col("file") == path) & (F.col("line") == int(m[2]))).orderBy("col_start", "handle").select("handle").limit(1).collect()
            if not here and occurrences is not None:
                at = spark.createDataFrame([(path, int(m[2]), 0)], "file string, line int, column int")
                here = resolve_at(at, occurrences).where("handle IS NOT NULL").select("handle").collect()
            return spark.createDataFrame([(bool(here), False, here[0][0] if here else None, None, None if here else "unresolved")], schema)
        return spark.createDataFrame([(bool(module), False, module[0][0] if module else None, None, None if module else "unresolved")], schema)
    if "." in identifier:
        hit = nodes.where(F.col("handle") == identifier).select("handle").union(canonical_names.where(F.col("alias") == identifier).select("handle")).limit(1).collect()
        if not hit and stubs is not None:
            hit = external_names(spark.createDataFrame([(identifier,)], "name string"), stubs).select("handle").collect()
        return spark.createDataFrame([(bool(hit), False, hit[0][0] if hit else None, None, None if hit else "unresolved")], schema)
    if spaces is not None:
        ask = spark.createDataFrame([(identifier,)], "name string")
        filed = defs.where(F.col("name") == identifier).select(F.col("full_name").alias("handle")).join(nodes.where("file IS NOT NULL AND file <> ''"), "handle", "left_semi")
        anchored = namespace_anchor(ask, spaces).select("handle").limit(1).collect()
        if anchored and filed.isEmpty():
            return spark.createDataFrame([(True, False, anchored[0][0], None, None)], schema)
    row = bare_names(spark.createDataFrame([(identifier,)], "name string"), defs, nodes).first()
    names = [r["handle"] for r in candidates(identifier, defs, nodes).collect()] if row["ambiguous"] else None
    return spark.createDataFrame([(row["found"], row["ambiguous"], row["handle"], names, row["reason"])], schema)


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(handle, kind, members, submodules, superclasses, callees): counts where the kind has the edge, 0 if it was
    measured and empty, null if it isn't measured for that kind. Subclasses, callers and references are never counted."""
    n = edges.groupBy(F.col("src").alias("handle")).agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("members", "submodules", "superclasses", "callees")])
    out = nodes.join(n, "handle", "left")
    gate = {"members": ("class", "module"), "submodules": ("package",), "superclasses": ("class",), "callees": ("function", "method")}
    is_package = F.col("_submodules") > 0 if "is_package" not in nodes.columns else F.coalesce("is_package", F.col("_submodules") > 0)
    cols = []
    for k, kinds in gate.items():
        has = F.coalesce(is_package, F.lit(False)) if k == "submodules" else F.col("kind").isin(*kinds)
        cols.append(F.when(has, F.coalesce(F.col(f"_{k}"), F.lit(0))).cast("long").alias(k))
    return out.select("handle", "kind", *cols)


#: What a node of a kind has beside what every node has; other kinds have null there.
KIND_FIELDS = {
    "superclasses": ("class",), "signature": ("class", "function", "method"), "parameters": ("function", "method"), "return_type": ("function", "method"),
    "is_async": ("function", "method"), "is_classmethod": ("function", "method"), "is_staticmethod": ("function", "method"), "is_package": ("module",), "package": ("module",),
    "type": ("attribute", "property", "variable"), "default": ("attribute", "variable"),
}


def details(nodes: DataFrame, bases: DataFrame, type_refs: DataFrame) -> DataFrame:
    """nodes with the fields of their kind (KIND_FIELDS). bases(owner, dst, target, ord): a class's declared bases, those
    that don't resolve as they are written; type_refs(owner, name, path, raw, handle) of annotations.

    parameters is an array of (name, kind, type, default), type the annotation's text; return_type and an attribute's
    type are arrays of (path, raw, handle), the annotation first and its arguments below it."""
    unit = "\x1f"
    field = lambda p, i: F.nullif(F.element_at(F.split(p, unit), i), F.lit(""))
    parameter = lambda p: F.struct(field(p, 1).alias("name"), field(p, 2).alias("kind"), field(p, 3).alias("type"), field(p, 4).alias("default"))
    up = bases.groupBy(F.col("owner").alias("_o")).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("dst", "target", "name").alias("h")))).alias("_b"))
    tree = F.array_sort(F.collect_list(F.struct("path", "raw", "handle")))
    back = type_refs.where("name = 'return'").groupBy(F.col("owner").alias("_r")).agg(tree.alias("_return"))
    own = type_refs.where("name <> 'return'").groupBy(F.concat_ws(".", "owner", "name").alias("_t")).agg(tree.alias("_type"))
    out = nodes.withColumnRenamed("type", "_text") if "type" in nodes.columns else nodes
    out = out.join(up, F.col("handle") == F.col("_o"), "left").join(back, F.col("handle") == F.col("_r"), "left").join(own, F.col("handle") == F.col("_t"), "left")
    made = {
        "superclasses": F.coalesce(F.transform("_b", lambda x: x["h"]), F.array().cast("array<string>")), "parameters": F.coalesce(F.transform("parameters", parameter), F.array().cast("array<struct<name:string,kind:string,type:string,default:string>>")),
        "return_type": F.col("_return"), "type": F.col("_type"), "package": parent(F.col("handle")),
    }
    for name, kinds in KIND_FIELDS.items():
        out = out.withColumn(name, F.when(F.col("kind").isin(*kinds), made.get(name, F.col(name) if name in out.columns else F.lit(None))))
    return out.drop("_o", "_b", "_r", "_return", "_t", "_type", "_text")


def inspect(nodes: DataFrame, edges: DataFrame, exports: DataFrame, handle: str, bases: DataFrame | None = None, type_refs: DataFrame | None = None) -> DataFrame:
    """One row for any handle: the node with its counts and re-exports (null for modules, an empty array if there are
    none), and with bases and type_refs the fields of its kind; an unknown handle gives a minimal external variable."""
    spark = nodes.sparkSession
    ask = spark.createDataFrame([(handle,)], "handle string")
    node = nodes.where(F.col("handle") == handle)
    counts = edge_counts(node, edges.where(F.col("src") == handle)).drop("kind")
    if bases is not None and type_refs is not None:
        mine = (F.col("owner") == handle) | (F.concat_ws(".", "owner", "name") == handle)
        node = details(node, bases.where(F.col("owner") == handle), type_refs.where(mine))
    found = ask.join(node, "handle", "left").join(counts, "handle", "left").join(exports.where(F.col("handle") == handle), "handle", "left")
    known = F.col("kind").isNotNull()
    none = F.array().cast("array<string>")
    return found.withColumn("re_exports", F.when(known & (F.col("kind") != "module"), F.coalesce("re_exports", none))).withColumn("kind", F.coalesce("kind", F.lit("variable"))).withColumn("scope", F.coalesce("scope", F.lit("external")))


def type_info(positions: DataFrame, occurrences: DataFrame, nodes: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """What stands at positions(file, line, column): the definition's handle, name, kind, module and docstring, and for a
    class its base_classes, mro (ending in builtins.object), methods and attributes, by name. Null where nothing is.

    bases(owner, dst, target, name, ord), members(src, dst, ord). Names mean what they are bound to: types that only
    inference would tell aren't given."""
    from .hierarchy import resolution_orders

    at = resolve_at(positions, occurrences)
    about = nodes.select("handle", F.substring_index("handle", ".", -1).alias("name"), "kind", "docstring", parent(F.col("handle")).alias("module_name"))
    named = bases.select(F.col("owner").alias("child"), "ord", F.coalesce("dst", "target", "name").alias("parent"))
    up = named.groupBy(F.col("child").alias("handle")).agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("_b")).select("handle", F.transform("_b", lambda x: x["parent"]).alias("_bases"))
    order = resolution_orders(named).groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("_o")).select("handle", F.transform("_o", lambda x: x["name"]).alias("_mro"))
    kinds = members.where("kind = 'members'").select(F.col("src").alias("handle"), F.col("dst").alias("_d")).join(nodes.select(F.col("handle").alias("_d"), F.col("kind").alias("_k")), "_d")
    leaf = F.substring_index("_d", ".", -1)
    own = kinds.groupBy("handle").agg(F.array_sort(F.collect_set(F.when(F.col("_k") == "method", leaf))).alias("_m"), F.array_sort(F.collect_set(F.when(F.col("_k").isin("attribute", "property"), leaf))).alias("_a"))
    out = at.join(about, "handle", "left").join(up, "handle", "left").join(order, "handle", "left").join(own, "handle", "left")
    cls, none = F.col("kind") == "class", F.array().cast("array<string>")
    mro = F.concat(F.array_remove(F.coalesce("_mro", F.array("handle")), "object"), F.array(F.lit("builtins.object")))
    return out.select(
        "file", "line", "column", "handle", "name", "kind", "module_name", "docstring", F.when(cls, F.coalesce("_bases", none)).alias("base_classes"), F.when(cls, F.array_distinct(mro)).alias("mro"),
        F.when(cls, F.coalesce("_m", none)).alias("methods"), F.when(cls, F.coalesce("_a", none)).alias("attributes"),
    )


def find_symbol(defs: DataFrame, name: str, fuzzy: bool = False, roots: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Definitions by exact name, or by a case-sensitive substring; `A.b` asks for member b of a parent named A (fuzzy: both
    by substring). One row for each (full name, file, line). roots(root) narrows to files below one of them; names
    (alias, handle) adds import_paths, every statement that imports the symbol, its own module's first."""
    if roots is not None:
        # a file is below a root if one of its own folders is that root: an equi-join, not a comparison with every root
        steps = F.split("file", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
        inside = defs.select("file").distinct().select("file", F.explode(above).alias("_up")).join(roots.select(F.col("root").alias("_up")), "_up", "left_semi")
        defs = defs.join(inside.select("file").distinct(), "file", "left_semi")
    if names is not None:
        found = find_symbol(defs, name, fuzzy).withColumnRenamed("full_name", "handle")
        return with_import_paths(found, names).withColumnRenamed("handle", "full_name")
    if "." in name:
        head, last = name.rsplit(".", 1)
        if fuzzy:
            hit = defs.where(F.contains("name", F.lit(last)) & F.contains("parent", F.lit(head)))
        else:
            hit = defs.where((F.col("name") == last) & (F.col("parent").isNotNull()) & ((F.col("parent") == head) | F.endswith("parent", F.lit("." + head))))
    else:
        hit = defs.where(F.contains("name", F.lit(name)) if fuzzy else F.col("name") == name)
    first = Window.partitionBy("full_name", "file", "line").orderBy("column")
    return hit.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
