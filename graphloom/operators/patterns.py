"""Framework patterns: filters over facts, with columns name, file, line and what the pattern adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.code import UNIT, of

#: Extension packages that the web pattern knows.
FLASK_EXTENSIONS = (
    "flask_sqlalchemy", "flask_migrate", "flask_login", "flask_wtf", "flask_cors", "flask_mail", "flask_restful", "flask_marshmallow",
    "flask_jwt_extended", "flask_socketio", "flask_admin", "flask_limiter",
)
PYDANTIC_BASES = ("BaseModel", "BaseSettings", "RootModel")
VALIDATORS = ("validator", "field_validator", "root_validator", "model_validator")


def _defs(facts: DataFrame, *kinds: str) -> DataFrame:
    return of(facts, "def").where(F.col("kind").isin(*kinds)).select("name", "full_name", "file", "line", "kind", F.col("flag").alias("is_async"), "items", "text")


def _decorated(facts: DataFrame) -> DataFrame:
    d = of(facts, "decorator").select(F.col("parent").alias("full_name"), F.col("name").alias("decorator"), F.col("target").alias("decorator_path"), F.col("text").alias("first"), F.col("items").alias("args"), F.col("flag").alias("has_methods"), F.col("kind").alias("mode"), F.col("level").alias("called"), F.col("ord").alias("d_ord"))
    return _defs(facts, "function", "method", "class").join(d, "full_name")


def flask_routes(facts: DataFrame) -> DataFrame:
    """Routes of plain functions; methods default to GET; a decorator without a constant path is no route."""
    d = _decorated(facts).where((F.col("decorator") == "route") & F.contains("decorator_path", F.lit(".")) & (F.col("called") == 1) & ~F.col("is_async") & (F.col("kind") != "class") & (F.col("first") != ""))
    return d.select("name", "file", "line", F.col("first").alias("path"), F.when(F.col("has_methods"), F.col("args")).otherwise(F.array(F.lit("GET"))).alias("methods"))


def flask_blueprints(facts: DataFrame) -> DataFrame:
    a = of(facts, "assign").where(F.substring_index("target", ".", -1) == "Blueprint")
    return a.select("name", "file", "line", F.element_at("items", 1).alias("blueprint"))


def _with_base(facts: DataFrame, cond) -> DataFrame:
    b = of(facts, "base").select("full_name", F.col("name").alias("base"), F.col("level").alias("base_ord")).where(cond)
    return _defs(facts, "class").join(b, "full_name")


def flask_views(facts: DataFrame) -> DataFrame:
    return _with_base(facts, F.col("base") == "MethodView").select("name", "file", "line")


def flask_extensions(facts: DataFrame) -> DataFrame:
    """Imported extension packages, each (extension, file) once."""
    head = F.substring_index("target", ".", 1)
    return of(facts, "import").where(head.isin(*FLASK_EXTENSIONS)).groupBy(head.alias("name"), "file").agg(F.min("line").alias("line"))


def flask_config(facts: DataFrame) -> DataFrame:
    a = of(facts, "assign").where(F.col("name").rlike(r"(^|\.)config(\.|$)")).select("name", "file", "line")
    c = of(facts, "call").where(F.col("target").rlike(r"\.config\.")).select(F.col("target").alias("name"), "file", "line")
    return a.unionByName(c)


def flask_error_handlers(facts: DataFrame) -> DataFrame:
    return _decorated(facts).where(F.col("decorator").isin("errorhandler", "app_errorhandler")).select("name", "file", "line")


def flask_cli(facts: DataFrame) -> DataFrame:
    return _decorated(facts).where((F.col("decorator") == "command") & F.col("decorator_path").rlike(r"cli\.command$")).select("name", "file", "line", F.coalesce("first", "name").alias("command"))


def template_calls(facts: DataFrame) -> DataFrame:
    c = of(facts, "call").where(F.substring_index("target", ".", -1) == "render_template")
    return c.select(F.regexp_replace(F.element_at("items", 1), "^['\"]|['\"]$", "").alias("name"), "file", "line")


def django_models(facts: DataFrame) -> DataFrame:
    """Classes of models.py with a base named Model: a row a matching base."""
    return _with_base(facts, F.col("base") == "Model").where(F.col("file").rlike(r"(^|/)models\.py$")).select("name", "file", "line", "base_ord")


def django_views(facts: DataFrame) -> DataFrame:
    """In views.py: functions whose first parameter is request, classes with a base whose name holds View."""
    here = F.col("file").rlike(r"(^|/)views\.py$")
    f = _defs(facts, "function").where(here & F.startswith(F.element_at("items", 1), F.lit("request" + UNIT))).select("name", "file", "line", F.lit("function").alias("view"))
    c = _with_base(facts, F.contains("base", F.lit("View"))).where(here).select("name", "file", "line", F.lit("class").alias("view")).distinct()
    return f.unionByName(c)


def named_files(files: DataFrame, kind: str) -> DataFrame:
    """File listings by name: urls, migrations or templates."""
    pattern = {"urls": r"(^|/)urls\.py$", "migrations": r"/migrations/(?!__init__\.py$)[^/]+\.py$", "templates": r"/templates/.+\.(html|txt|xml)$"}[kind]
    return files.where(F.col("file").rlike(pattern)).select(F.substring_index("file", "/", -1).alias("name"), "file")


def pydantic_models(facts: DataFrame) -> DataFrame:
    """Models with their annotated fields, split into required and optional, in source order."""
    m = _with_base(facts, F.col("base").isin(*PYDANTIC_BASES)).select("full_name", "name", "file", "line").distinct()
    f = of(facts, "assign").where("text IS NOT NULL AND kind = 'class'").select(F.col("parent").alias("full_name"), F.struct("ord", F.col("name").alias("field"), F.col("text").alias("type"), F.col("flag").alias("required")).alias("f"))
    g = m.join(f, "full_name", "left").groupBy("full_name", "name", "file", "line").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    pick = lambda need: F.transform(F.filter("fields", lambda x: x["required"] == F.lit(need)), lambda x: x["field"])
    return g.select("name", "full_name", "file", "line", F.transform("fields", lambda x: F.concat(x["field"], F.lit(": "), x["type"])).alias("fields"), pick(True).alias("required"), pick(False).alias("optional"))


def pydantic_validators(facts: DataFrame) -> DataFrame:
    v = _decorated(facts).where(F.col("decorator").isin(*VALIDATORS))
    return v.select("name", "file", "line", "decorator", F.col("args").alias("fields"), F.coalesce("mode", F.lit("after")).alias("mode"))


def model_schema(facts: DataFrame, model: str) -> DataFrame:
    """The schema of the models of one simple name: fields, required and optional ones, validators (method names by source
    order), computed fields and the style of its settings; no row if there is no such model."""
    m = pydantic_models(facts).where(F.col("name") == model).select(F.col("full_name").alias("_m"), F.col("name").alias("model"), "file", "fields", "required", "optional")
    inside = _decorated(facts).withColumn("_m", F.regexp_replace("full_name", r"\.[^.]*$", ""))
    pick = lambda *names: F.array_sort(F.collect_set(F.when(F.col("decorator").isin(*names), F.struct("line", "name"))))
    d = inside.groupBy("_m").agg(pick(*VALIDATORS).alias("_v"), pick("computed_field", "property").alias("_c"))
    c = pydantic_config(facts).groupBy(F.col("model").alias("_m")).agg(F.max("style").alias("config"))
    out = m.join(d, "_m", "left").join(c, "_m", "left")
    none = F.array().cast("array<string>")
    named = lambda x: F.coalesce(F.transform(x, lambda y: y["name"]), none)
    return out.select("model", "file", "fields", "required", "optional", named("_v").alias("validators"), named("_c").alias("computed_fields"), "config")


def flask_templates(facts: DataFrame, files: DataFrame) -> DataFrame:
    """One row: templates, (name, file) of the template files of files(file) below a templates folder, and render_calls,
    (template, file, line) of render_template with a constant name, both by file. It wraps two lists into one result, so
    it is as large as they are: ask the two parts by themselves for large projects."""
    name = F.regexp_extract("file", r"(?:^|/)templates/(.+\.(?:html|jinja2))$", 1)
    here = files.select(F.struct("file", name.alias("name")).alias("t")).where("t.name <> ''").agg(F.array_sort(F.collect_list("t")).alias("templates"))
    calls = template_calls(facts).select(F.struct("file", "line", F.col("name").alias("template")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("render_calls"))
    return here.crossJoin(calls)  # each side is one row


def pydantic_field_validators(facts: DataFrame) -> DataFrame:
    return pydantic_validators(facts).where(F.col("decorator").isin("validator", "field_validator"))


def pydantic_config(facts: DataFrame) -> DataFrame:
    inner = _defs(facts, "class").where("name = 'Config'").select(F.regexp_replace("full_name", r"\.[^.]*$", "").alias("model"), "file", "line", F.lit("class").alias("style"))
    value = of(facts, "assign").where("name = 'model_config'").select(F.col("parent").alias("model"), "file", "line", F.lit("model_config").alias("style"))
    return inner.unionByName(value)


def pydantic_computed(facts: DataFrame) -> DataFrame:
    """Computed fields; a property counts as one."""
    return _decorated(facts).where(F.col("decorator").isin("computed_field", "property")).select("name", "file", "line", "decorator").distinct()


def pydantic_inheritance(facts: DataFrame, model: str) -> DataFrame:
    """(relation, name) of a model by simple names alone: its bases as parents, classes that name it as base as children."""
    b = of(facts, "base").select(F.substring_index("full_name", ".", -1).alias("child"), F.col("name").alias("base"))
    up = b.where(F.col("child") == model).select(F.lit("parent").alias("relation"), F.col("base").alias("name"))
    return up.unionByName(b.where(F.col("base") == model).select(F.lit("child").alias("relation"), F.col("child").alias("name"))).distinct()
