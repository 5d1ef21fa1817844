"""References followed through tables: from a name, by attributes and calls, to the definition it means.

A reference (sources.lexical) is evaluated step by step. Its state is where it stands: a module, a class, an instance of a
class, a function, or a variable whose value must be known first. An attribute is one join with what the place offers; a
variable, property or call is one join with the values found so far. Values come from references themselves (what is
assigned, annotated or returned), so all are evaluated together until a round finds no new value and moves nothing: the
least fixpoint. A reference that no table can follow stays without a definition and is counted by those who ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parent
from ..plans.checkpoints import cut, gathered

#: Kinds of nodes as states.
_STATE = {"module": "M", "class": "C", "function": "F", "method": "F", "property": "P", "variable": "V", "attribute": "V"}
#: Owner of what lies above a class in its resolution order, for super().
ABOVE = "^"
_CALL = "()"


def state_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in _STATE.items() for x in pair]), kind)


def linear(classes: DataFrame, orders: DataFrame) -> DataFrame:
    """(handle, ord, name): every class of classes(handle) and its ancestors in resolution order, itself first."""
    alone = classes.select("handle").distinct().join(orders.select("handle").distinct(), "handle", "left_anti")
    return orders.select("handle", "ord", "name").unionByName(alone.select("handle", F.lit(0).alias("ord"), F.col("handle").alias("name")))


def inherited(classes: DataFrame, members: DataFrame, orders: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(owner, step, handle, kind): the members that each class has by its resolution order, the first definer's of each
    name. members(owner, step, handle, kind) are the classes' own. above(handle): classes for which what lies above them
    is given as well, under the handle with `^`."""
    order = linear(classes, orders)
    if above is not None:
        order = order.unionByName(order.join(above, "handle", "left_semi").where("handle <> name").select(F.concat("handle", F.lit(ABOVE)).alias("handle"), "ord", "name"))
    own = members.select(F.col("owner").alias("_o"), "step", F.col("handle").alias("_d"), "kind")
    met = order.join(own, F.col("name") == F.col("_o"))
    best = gathered(met, "handle", "step").groupBy(F.col("handle").alias("owner"), "step").agg(F.min_by(F.struct(F.col("_d").alias("handle"), "kind"), "ord").alias("b"))
    return best.select("owner", "step", "b.*")


def own_members(nodes: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(owner, step, handle, kind) of nodes(handle, kind) below other nodes, and of attributes that instances are given."""
    inner = nodes.where(F.instr("handle", ".") > 0).select(parent(F.col("handle")).alias("owner"), F.substring_index("handle", ".", -1).alias("step"), "handle", "kind")
    if attributes is None:
        return inner
    more = attributes.select(F.col("parent").alias("owner"), F.col("name").alias("step"), F.col("full_name").alias("handle")).distinct().withColumn("kind", F.lit("attribute"))
    return inner.unionByName(more.join(nodes.select("handle"), "handle", "left_anti").select("owner", "step", "handle", "kind"))


def offers(nodes: DataFrame, names: DataFrame, of_classes: DataFrame) -> DataFrame:
    """(owner, step, handle, state): what an attribute of a place means. Modules offer their definitions and submodules,
    and the names they import, names(alias, handle); classes what of_classes(owner, step, handle, kind) says."""
    modules = nodes.where("kind = 'module'").select(F.col("handle").alias("owner"))
    inner = own_members(nodes).join(modules, "owner", "left_semi")
    alias = names.select(parent(F.col("alias")).alias("owner"), F.substring_index("alias", ".", -1).alias("step"), "handle").join(nodes.select("handle", "kind"), "handle")
    alias = alias.join(inner.select("owner", "step"), ["owner", "step"], "left_anti").select("owner", "step", "handle", "kind")
    every = inner.unionByName(alias).unionByName(of_classes.select("owner", "step", "handle", "kind"))
    return gathered(every, "owner", "step").groupBy("owner", "step").agg(F.min(F.struct("handle", state_of(F.col("kind")).alias("state"))).alias("b")).select("owner", "step", "b.*")


def key_of(head: Column, steps: Column) -> Column:
    """One string for a reference; null for none."""
    return F.concat(head, F.lit("|"), F.array_join(steps, "."))


def evaluate(references: DataFrame, offered: DataFrame, nodes: DataFrame, flows: DataFrame | None = None, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(found, values): found(key, handle) of the references(head, steps) that lead to a definition, and values(name,
    state, at) of variables and returns. flows(name, key) says which reference's value a name has; a name whose reference
    isn't among `references` has none. values given from an earlier call are used as they are."""
    tag, at = F.substring("head", 1, 1), F.expr("substring(head, 3)")
    # A round's plan would grow with the rounds, so each is written.
    start = references.where("head IS NOT NULL").select(key_of(F.col("head"), F.col("steps")).alias("key"), "head", "steps").distinct()
    kinds = nodes.select(F.concat(F.lit("d:"), F.col("handle")).alias("head"), state_of(F.col("kind")).alias("_k"))
    start = start.join(kinds, "head", "left")
    state = F.when(tag.isin("a", "m"), "M").when(tag.isin("s", "u"), "I").when(tag == "c", "C").when(tag == "v", "V").otherwise(F.coalesce("_k", F.lit("V")))
    place = F.when(tag == "u", F.concat(at, F.lit(ABOVE))).otherwise(at)
    start = start.select("key", state.alias("state"), place.alias("at"), F.when(tag.isin("a", "c", "d"), at).alias("handle"), F.col("steps").alias("rest"))
    wanted = flows.select("key").distinct().withColumn("_flow", F.lit(True)) if flows is not None else None
    start = start.join(wanted, "key", "left") if wanted is not None else start.withColumn("_flow", F.lit(None).cast("boolean"))
    offered = cut(offered, "offers")
    side = offered.select(F.col("owner").alias("_o"), F.col("step").alias("_s"), F.col("handle").alias("_h"), F.col("state").alias("_t"))
    first, tail = F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit("")), F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))
    by_name = F.col("state").isin("M", "C", "I") & ~first.isin("", _CALL)
    by_value = F.col("state").isin("V", "P") | ((F.col("state") == "F") & (first == _CALL))
    ask = F.when(F.col("state") == "V", F.col("at")).otherwise(F.concat("at", F.lit(_CALL)))

    def made(rows: DataFrame) -> DataFrame:
        """A class that is called is an instance; past a call a definition is no longer what the reference names."""
        called = (F.col("state") == "C") & (first == _CALL)
        return rows.select(
            "key", F.when(called, "I").otherwise(F.col("state")).alias("state"), "at", F.when(~called, F.col("handle")).alias("handle"), F.when(called, tail).otherwise(F.col("rest")).alias("rest"), "_flow", "_moved",
        )

    def named(rows: DataFrame) -> DataFrame:
        """One attribute on; what the place doesn't offer is dropped."""
        x = rows.where(by_name).withColumn("_step", first).join(side, (F.col("at") == F.col("_o")) & (F.col("_step") == F.col("_s")))
        return x.select("key", F.col("_t").alias("state"), F.col("_h").alias("at"), F.col("_h").alias("handle"), tail.alias("rest"), "_flow", F.lit(True).alias("_moved"))

    def valued(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        """Variables, properties and calls by the values known so far; the others as they are. Only who asks is joined."""
        rows = rows.where(~by_name).withColumn("_moved", F.lit(False))
        if known is None:
            return rows
        v = known.select(F.col("name").alias("_n"), F.col("state").alias("_vs"), F.col("at").alias("_va"))
        met, called = F.col("_vs").isNotNull(), F.col("state") == "F"
        x = rows.where(by_value).withColumn("_ask", ask).join(v, F.col("_ask") == F.col("_n"), "left")
        x = x.select(
            "key", F.coalesce("_vs", "state").alias("state"), F.coalesce("_va", "at").alias("at"), F.when(~(met & called), F.col("handle")).alias("handle"),
            F.when(met & called, tail).otherwise(F.col("rest")).alias("rest"), "_flow", met.alias("_moved"),
        )
        return rows.where(~by_value).unionByName(x)

    done, pending = [], made(start.withColumn("_moved", F.lit(False))).drop("_moved")
    while True:
        pending = cut(pending, "pending") if not done else pending
        now = cut(made(named(pending).unionByName(valued(pending, values))), "references")
        settled = (F.size("rest") == 0) & (F.col("_flow").isNull() | F.col("state").isin("M", "C", "I", "F"))
        done.append(now.where(settled))
        moved = now.agg(F.count_if(F.col("_moved") & ~settled), F.count_if(settled & F.col("_flow").isNotNull())).first()
        if flows is not None and moved[1]:
            new = cut(flows.join(now.where(settled).select("key", "state", "at"), "key").select("name", "state", "at"), "values")
            values = new if values is None else values.unionByName(new)
        pending = now.where(~settled).drop("_moved")
        if not moved[0] and not (flows is not None and moved[1]):
            done.append(pending.where(F.size("rest") == 0))  # a variable of unknown value is a definition all the same
            break
    found = None
    for part in done:
        part = part.where("handle IS NOT NULL").select("key", "handle")
        found = part if found is None else found.unionByName(part)
    return found, values
