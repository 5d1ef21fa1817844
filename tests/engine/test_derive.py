"""After each batch of changed files the kept tables equal those of a full rebuild; other files are not parsed again."""

from graphloom.sources import code
from graphloom.streaming import derive

CHANGED = "module string, file string, content string"
FIRST = {
    "p": "from .star import *\n", "p.star": "from .core import *\n", "p.core": "class A:\n    def go(self):\n        return make()\n\ndef make():\n    return A()\n",
    "q.use": "from p import A\n\nclass B(A):\n    def run(self):\n        self.go()\n        self.stop()\n", "q.far": "from q.use import B\n\ndef main(b: B):\n    b.go()\n    b.run()\n", "r.alone": "import os\n\ndef f():\n    return f()\n",
    "r.waits": "from s.later import Z\n\nclass Y(Z):\n    pass\n",
}
#: Batches of module -> content (None: the file goes).
STEPS = [
    FIRST, {"p.core": "class A:\n    def stop(self):\n        return 1\n\n    def go(self):\n        return 2\n", "s.later": "class Z:\n    pass\n"},
    {"p.star": "from .other import *\n", "p.other": "class A:\n    pass\n", "q.use": "from p import A as C\n\nclass B(C):\n    pass\n", "r.alone": None, "s.later": "def broken(:\n"}, {m: None for m in (*FIRST, "s.later", "p.other")},
]


def rows(step):
    return [(m, "/w/" + (m.replace(".", "/") + ("/__init__.py" if m == "p" else ".py")), c) for m, c in step.items()]


def full(spark, now):
    if not now:
        return {"nodes": set(), "edges": set(), "unresolved": []}
    t = code.tables(code.facts(spark.createDataFrame(rows(now), CHANGED)))
    return {
        "nodes": {(r.handle, r.kind, r.file, r.line_start, r.signature) for r in t["nodes"].collect()}, "edges": {(r.src, r.kind, r.dst, r.ord) for r in t["edges"].collect()},
        "unresolved": sorted((r.src, r.edge, str(r.target)) for r in t["unresolved"].collect()),
    }


def kept(store, n):
    t = {name: store.table(name, n) for name in ("nodes", "edges", "unresolved")}
    return {
        "nodes": {(r.handle, r.kind, r.file, r.line_start, r.signature) for r in t["nodes"].collect()}, "edges": {(r.src, r.kind, r.dst, r.ord) for r in t["edges"].collect()},
        "unresolved": sorted((r.src, r.edge, str(r.target)) for r in t["unresolved"].collect()),
    }


def test_batches_of_a_stream_equal_full_rebuilds(spark, tmp_path):
    for step in STEPS:
        spark.createDataFrame(rows(step), CHANGED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store, now = derive.Store(spark, f"file://{tmp_path}/store"), {}
    q = store.follow(spark.readStream.schema(CHANGED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", availableNow=True)
    q.awaitTermination(1200)
    assert q.exception() is None and store.last() == len(STEPS) - 1
    for n, step in enumerate(STEPS):
        now = {m: c for m, c in {**now, **step}.items() if c is not None}
        parsed = spark.read.schema(code.SCHEMA).parquet(f"{tmp_path}/store/facts/{n}").select("file").distinct().count()
        assert parsed == sum(c is not None for c in step.values())
        assert kept(store, n) == full(spark, now), n
    store.apply(spark.createDataFrame(rows(STEPS[0]), CHANGED), 1)  # a batch that is delivered again
    assert store.last() == len(STEPS) - 1 and store.table("nodes").count() == 0
