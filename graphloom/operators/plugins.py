"""Plugins: named sets of pattern queries over facts, switched on by what a project imports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.code import of
from . import patterns


@dataclass
class Plugin:
    """name; markers: top-level packages whose import switches it on, files whose presence does; tools: query by name, each
    a function of facts; augment: adds columns to symbol results (name, full_name, ...), given the facts."""

    name: str
    markers: tuple[str, ...]
    files: tuple[str, ...] = ()
    tools: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    augment: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def detect(self, facts: DataFrame) -> bool:
        """Does the project import one of the markers, or have one of the files?"""
        return bool(activate(facts, (self,)))

    def find_patterns(self, pattern: str, facts: DataFrame) -> DataFrame | None:
        """The rows of one of its tools, by its name; None if it has no such tool."""
        tool = self.tools.get(pattern)
        return tool(facts) if tool else None

    def components(self, facts: DataFrame) -> DataFrame:
        """(component, file): the files in which each tool finds something."""
        out = None
        for name, tool in self.tools.items():
            part = tool(facts).select(F.lit(name).alias("component"), "file").distinct()
            out = part if out is None else out.unionByName(part)
        return out


def _mark_models(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """is_model: the symbol is a class with a model base."""
    models = of(facts, "base").where(F.col("name").isin(*patterns.PYDANTIC_BASES)).select(F.col("full_name").alias("_m")).distinct()
    return symbols.join(models, F.col("full_name") == F.col("_m"), "left").withColumn("is_model", F.col("_m").isNotNull()).drop("_m")


BUILT_IN = (
    Plugin("flask", ("flask",), (), {"find_flask_routes": patterns.flask_routes, "find_flask_blueprints": patterns.flask_blueprints, "find_flask_views": patterns.flask_views, "find_flask_extensions": patterns.flask_extensions, "find_flask_config": patterns.flask_config}),
    Plugin("django", ("django",), ("manage.py",), {"find_django_models": patterns.django_models, "find_django_views": patterns.django_views}),
    Plugin("pydantic", ("pydantic",), (), {"find_models": patterns.pydantic_models, "find_validators": patterns.pydantic_validators}, _mark_models),
)


def activate(facts: DataFrame, plugins: tuple[Plugin, ...] = BUILT_IN) -> list[Plugin]:
    """The plugins that a project switches on, in their order: one pass over the facts for all of them."""
    package = F.when((F.col("fact") == "import") & (F.coalesce("level", F.lit(0)) == 0), F.substring_index("target", ".", 1))
    file = F.substring_index("file", "/", -1)
    on = [F.bool_or(F.coalesce(package.isin(*p.markers), F.lit(False)) | F.coalesce(file.isin(*p.files), F.lit(False))) for p in plugins]
    found = facts.agg(*[c.alias(f"_{k}") for k, c in enumerate(on)]).first() if on else ()
    return [p for p, x in zip(plugins, found) if x]


def registered_tools(active: list[Plugin]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every tool of the active plugins; of one name the later plugin's."""
    return {name: tool for p in active for name, tool in p.tools.items()}


def augmented(symbols: DataFrame, facts: DataFrame, active: list[Plugin]) -> DataFrame:
    """symbols with what each active plugin adds, in turn."""
    for p in active:
        if p.augment:
            symbols = p.augment(symbols, facts)
    return symbols
