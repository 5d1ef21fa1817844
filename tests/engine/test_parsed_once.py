from graphloom.operators import plugins
from graphloom.plans import rendered
from graphloom.sources import code


def test_plugins_switch_on_in_one_pass(spark):
    files = spark.createDataFrame([("m", "m.py", "import flask\n"), ("n", "n.py", "from pydantic import BaseModel\n"), ("r", "r.py", "from .django import x\n")], "module string, file string, content string")
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    facts = code.facts(files).localCheckpoint()
    assert [p.name for p in plugins.activate(facts.mapInArrow(watched, facts.schema))] == ["flask", "pydantic"]
    assert seen.value == facts.count()
    assert plugins.BUILT_IN[0].detect(facts) and not plugins.BUILT_IN[1].detect(facts)
    assert plugins.activate(facts.limit(0)) == [] == plugins.activate(facts, ())


def test_rendered_sources_are_parsed_once(spark):
    facts = rendered.facts(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in facts._jdf.queryExecution().executedPlan().toString()
