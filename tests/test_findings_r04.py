"""What the fourth round of findings named."""

from pathlib import Path

from pyspark.sql import functions as F

from scenelake.operators import joins
from scenelake.sources import outputs, stage
from tests.test_findings_r03 import events, same_as_sql


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f1_pairs_are_written_as_they_are_met(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 1).alias("s"), "id", (F.col("id") % 3).cast("string").alias("v"))
    plan = _plan(joins.value_pairs(df, ["s"], "id", "v", lambda x, y: F.length(x) + F.length(y), most=7, block=50))
    assert "least(" not in plan and "greatest(" not in plan  # no pair is put in order on its own
    assert plan.count("RepartitionByExpression") == 4  # lists are made in dealt tasks too, not only met in them
    # equal keys are no pair, wherever the blocks are cut
    part = spark.createDataFrame([(i // 3, ["red bolt", None, "red rod"][i % 3], "Brand#1", "T") for i in range(90)], "p_partkey long, p_name string, p_brand string, p_type string")
    assert len(same_as_sql(spark, tmp_path, "bigram_jaccard", part=part)) == 9 * (30 * 29 // 2)
    one = part.select(F.lit(1).alias("s"), F.col("p_partkey").alias("id"), F.lit("x").alias("v"))
    for block, most in ((4, 2), (10, 256), (256, 3)):
        got = joins.value_pairs(one, ["s"], "id", "v", lambda x, y: F.lit(1.0), block=block, most=most)
        assert got.agg(F.count(F.lit(1)), F.count_distinct("a", "b"), F.max(F.col("a") >= F.col("b"))).first()[:] == (9 * (30 * 29 // 2), 30 * 29 // 2, False)


def test_f2_documents_are_packed_and_dealt_once(spark, tmp_path, monkeypatch):
    places, plans, folder, enriched = [], [], stage.folder, outputs.enriched
    monkeypatch.setattr(stage, "folder", lambda s: places.append(folder(s)) or places[-1])
    monkeypatch.setattr(outputs, "enriched", lambda docs, states: plans.append(enriched(docs, states)) or plans[-1])
    rows = events(spark, [0.5, 1.5, 1.25, 7.0]).unionByName(events(spark, [3.0, 3.0], user=7).withColumn("event_id", F.col("event_id") + 1000))
    assert len(same_as_sql(spark, tmp_path, "document_round_trip", events=rows)) == 2
    files = [f.name for p in places for f in Path(p.removeprefix("file://")).glob("part-*")]
    assert len(places) == 2 and files and all(f.endswith(".json.gz") for f in files)
    # the documents for their states and for the join: the same exchange, and no other
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_f2_what_a_document_holds_besides_is_kept(spark):
    held = '"more":[1.10,1E400,-0.0,123456789012345678901234567890.5,"1.10","\u00e9",null,true]'
    doc = '{"simulation":{"b":{"objects":{"1":{"n":1.0E-4},"2":7}},"a":{"objects":{"1":{"kinematics":{"old":1}}}},"c":5,"d":{"objects":[]}},' + held + "}"
    texts = {"good": doc, "twice": '{"simulation":{},"simulation":{}}', "nan": '{"simulation":{},"x":NaN}', "bad": "{", "list": "[1]", "none": None, "bare": doc}
    docs = spark.createDataFrame(list(texts.items()), "sim_id string, text string")
    rows = [(n, i, "1", [float(i)], None, None, 0.5) for n in texts if n != "bare" for i in range(5)] + [("good", 0, "2", None, None, None, None)]
    states = spark.createDataFrame(rows, "sim_id string, step int, object_id string, v array<double>, speed double, a array<double>, accel double")
    got = {r.sim_id: r.text for r in outputs.enriched(docs, states).collect()}
    told = lambda v: '"kinematics":{"a":null,"accel":0.5,"speed":null,"v":[' + v + "]}"
    # steps are numbered as they stand in the text, which is how scenes are read
    assert got.pop("good") == "{" + held + ',"simulation":{"a":{"objects":{"1":{' + told("1.0") + '}}},"b":{"objects":{"1":{' + told("0.0") + ',"n":1.0E-4},"2":7}},"c":5,"d":{"objects":[]}}}'
    assert got == {k: v for k, v in texts.items() if k != "good"}
