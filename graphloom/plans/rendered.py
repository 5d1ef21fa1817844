"""Python sources rendered from supplier rows: what is in them is a function of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.code import facts as parse
from .checkpoints import cut
from .relational import read

_SOURCE = '''from flask import Flask
from pydantic import BaseModel, field_validator

app = Flask(__name__)


def helper():
    return 1


class Model%1$s(BaseModel):
    a: int
%2$s    c: int = 3

    @field_validator("a"%3$s)
    def check_%1$s(cls, v):
        return v


@app.route("/s/%1$s"%4$s)
def route_%1$s():
    helper()
    return helper()
'''


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, file, content): a module a supplier."""
    k = F.col("s_suppkey")
    text = F.format_string(
        _SOURCE, k.cast("string"), F.when(k % 3 == 0, "    b: str\n").otherwise(""), F.when(k % 4 == 0, ', mode="before"').otherwise(""), F.when(k % 2 == 0, ', methods=["GET", "POST"]').otherwise("")
    )
    name = F.concat(F.lit("s"), k.cast("string"))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("src."), name).alias("module"), F.concat(F.lit("src/"), name, F.lit(".py")).alias("file"), text.alias("content"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of sources, written once by kind: who reads several kinds of them doesn't parse again."""
    return cut(parse(sources(spark, sf_dir)), "facts", ("fact",))


def source_tables(spark: SparkSession, sf_dir: str):
    from ..sources.code import tables

    return tables(parse(sources(spark, sf_dir)))


_BASE = '''class Root%1$s:
    """Root of nation %1$s."""

    count: int = %1$s

    def run(self, a, /, b: int = 1, *args, c: "list[Root%1$s] | None" = None, **kw) -> "Root%1$s":
        return self.stop()

    @staticmethod
    def stop():
        return make%1$s()


class Left%1$s(Root%1$s):
    pass


class Right%1$s(Root%1$s):
    async def run(self):
        self.stop()


class Base%1$s(Left%1$s, Right%1$s):
    def __init__(self, size: int, name="x"):
        self.size = size


def make%1$s():
    return Base%1$s(1)
'''
_ITEM = '''import os
import missing_%3$s
from . import base
from .base import Base%2$s as Own, make%2$s
from shop.n%4$s import Base%4$s


class Item%1$s(Own, Base%4$s):
    limit = %1$s


class Problem%1$s(Exception):
    @classmethod
    def of(cls, item: Item%1$s, others: dict[str, Item%1$s] = {}) -> Own:
        make%2$s()
        base.make%2$s()
        os.getcwd()
        return cls.of(item)


def use%1$s(x: int = len("a")):
    return Item%1$s(x)
'''


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, file, content) of a project with packages, namespace packages, re-exports, diamonds and relative imports:
    a package a nation, with a module of base classes and a module a supplier."""
    n, k = F.col("n_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    nation = read(spark, sf_dir, "nation").select("n_nationkey")
    rows = lambda df, module, file, text: df.select(module.alias("module"), file.alias("file"), text.alias("content"))
    here = F.concat(F.lit("/p/shop/n"), n)
    out = rows(nation, F.concat(F.lit("shop.n"), n), F.concat(here, F.lit("/__init__.py")), F.format_string("from .base import Base%1$s\n", n))
    out = out.unionByName(rows(nation, F.concat(F.lit("shop.n"), n, F.lit(".base")), F.concat(here, F.lit("/base.py")), F.format_string(_BASE, n)))
    out = out.unionByName(rows(nation, F.concat(F.lit("space.n"), n, F.lit(".part")), F.concat(F.lit("/p/space/n"), n, F.lit("/part.py")), F.lit("VALUE = 1\n")))
    out = out.unionByName(rows(nation.limit(1), F.lit("shop"), F.lit("/p/shop/__init__.py"), F.lit('"""Shop."""\n')))
    out = out.unionByName(rows(nation.limit(1), F.lit("broken"), F.lit("/p/broken.py"), F.lit("import shop\ndef (:\n")))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    text = F.format_string(_ITEM, k, n, (F.col("s_suppkey") % 3).cast("string"), ((F.col("n_nationkey") + 1) % 25).cast("string"))
    return out.unionByName(rows(s, F.concat(F.lit("shop.n"), n, F.lit(".s"), k), F.concat(here, F.lit("/s"), k, F.lit(".py")), text))


#: Files of one package a supplier (%1$s), named and bound in ways that need more than a look into one file.
_TWISTED = {
    "__init__": "from .api import *\n",
    "api": "from .dead import *\nfrom .more import *\n",
    "dead": "from .gone import Widget%1$s\nfrom .api import *\n",
    "more": "from .core import *\n",
    "core": '''class Widget%1$s:
    def __init__(self, size: int):
        self.size = size

    def grow(self) -> "Widget%1$s":
        return self

    def name(self):
        return helper%1$s()


class Base%1$s:
    def own(self):
        return 1

    @property
    def widget(self) -> Widget%1$s:
        return make%1$s()


def make%1$s():
    return Widget%1$s(2)


def helper%1$s(*parts: Base%1$s, **more: Widget%1$s):
    return parts


A%1$s, (B%1$s, *C%1$s) = 1, (2, 3)
match A%1$s:
    case 1:
        from . import extra

        def matched%1$s():
            return make%1$s().grow()
''',
    "extra": "class Other:\n    def grow(self):\n        return len(str(self))\n",
    "use": '''import os
from .extra import Other as Thing
from .core import Base%1$s as Thing
from tw.s%1$s import Widget%1$s, make%1$s
if os:
    from .extra import Other


class Child%1$s(Thing):
    def go(self):
        self.own()
        super().own()
        w = Widget%1$s(3)
        w.grow().name()
        self.held = make%1$s()
        w = Other()
        w.grow()
        return self.widget.grow()


class Leaf%1$s(Child%1$s, Widget%1$s):
    def own(self):
        return super().own()


def run%1$s(c: Child%1$s, d: "Leaf%1$s | None" = None, *rest: Leaf%1$s):
    global LAST
    c.own()
    d.own()
    d.name()
    d.held.grow()
    for r in rest:
        r.go()
    v = make%1$s()
    v.grow()
    v = unknown()
    v.grow()
    os.getcwd()
    LAST = [x for x in rest if x]
''',
}


def twisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, file, content) of a package a supplier, with rebound names, imports in blocks, stars of stars that go round
    or lead nowhere, tuple targets, match blocks, inherited members, and calls of variables."""
    k = F.col("s_suppkey").cast("string")
    out = None
    for name, text in _TWISTED.items():
        own = F.lit("") if name == "__init__" else F.lit(f".{name}")
        rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("tw.s"), k, own).alias("module"), F.concat(F.lit("/q/tw/s"), k, F.lit(f"/{name}.py")).alias("file"), F.format_string(text, k).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def twisted_tables(spark: SparkSession, sf_dir: str):
    from ..sources.code import tables

    return tables(parse(twisted(spark, sf_dir)))


#: (path, text) of the files of a nation (%1$s) in four roots: the project, its source folder and two portions of a namespace.
_SPLIT = [
    ("/w/p/tool%1$s.py", "from app%1$s import main\n"), ("/w/p/src/app%1$s.py", "from co.n%1$s.shared import where\n\n\ndef main():\n    return where()\n"),
    ("/w/a/co/n%1$s/shared.py", "def where():\n    return 'a'\n"), ("/w/b/co/n%1$s/shared.py", "def where():\n    return 'b'\n\n\ndef hidden():\n    return where()\n"),
    ("/w/a/co/n%1$s/both.py", "A = 1\n"), ("/w/a/co/n%1$s/both/__init__.py", "B = 1\n"), ("/w/a/co/n%1$s/late.py", "A = 1\n"), ("/w/b/co/n%1$s/late/__init__.py", "B = 1\n"),
    ("/w/b/co/n%1$s/deep/part.py", "from . import none\n"), ("/w/b/co/n%1$s/deep/.cache/x.py", "C = 1\n"), ("/w/elsewhere/n%1$s.py", "D = 1\n"),
]


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content) of a project with a source folder and a namespace package in two portions."""
    k = F.col("n_nationkey").cast("string")
    out = None
    for path, text in _SPLIT:
        rows = read(spark, sf_dir, "nation").select(F.format_string(path, k).alias("file"), F.format_string(text, k).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def split_tables(spark: SparkSession, sf_dir: str):
    from ..sources.code import tables
    from ..sources.layout import rooted

    return tables(parse(rooted(split(spark, sf_dir), split_roots(spark))))


def split_roots(spark: SparkSession) -> DataFrame:
    rows = [("/w/p/src", "src", None, 0), ("/w/p", "main", None, 1), ("/w/a", "namespace", "co", 2), ("/w/b/co", "namespace", "co", 3)]
    return spark.createDataFrame(rows, "root string, role string, namespace string, precedence int")


def project_tables(spark: SparkSession, sf_dir: str):
    from ..sources.code import tables

    return tables(parse(project(spark, sf_dir)))
