"""The edge kinds and what may be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMPLEMENTED = ("members", "callees", "imports", "imported_by", "subclasses", "superclasses", "enclosing_scope", "submodules")
#: Reverse references are refused: what can't be measured completely isn't approximated.
REFUSED = ("callers", "references", "read_by", "written_by", "passed_by", "overrides", "overridden_by", "decorated_by", "decorates")
#: Edges that a node of another kind doesn't have at all, so that asking is refused; the others give nothing.
MODULE_ONLY = ("imports", "imported_by")


def status(edge: str) -> str:
    return "implemented" if edge in IMPLEMENTED else "deferred_reference_backend" if edge in REFUSED else "unknown_edge"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, status(e)) for e in IMPLEMENTED + REFUSED], "edge string, status string")
