"""Tables that grow with the input are not broadcast by the size of their files."""

from pyspark.sql import functions as F

from cityloom.operators import sampling as R
from cityloom.session import cut_lineage
from cityloom.sources.views import Inputs


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_merged_but_for_a_broadcast_by_name(spark):
    rows = cut_lineage(spark.range(3000).withColumn("v", F.col("id") % 7))
    wide = cut_lineage(spark.range(3000).withColumn("x", F.array_repeat(F.col("id").cast("double"), 40)))
    kept = wide.where("id > 5").select("id", "x")
    for how in ("inner", "left", "left_anti"):
        plan = _plan(rows.join(kept, "id", how))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in _plan(rows.join(F.broadcast(kept), "id"))
    assert rows.join(kept, "id").count() == 2994


def test_views_join_input_tables_by_merge(spark, small):
    assert "BroadcastHashJoin" not in _plan(Inputs(spark, small).view("truth"))


def test_labelling_list_matches_once(spark, monkeypatch):
    """The labelled buildings, a join of its own, are stored before the strata read them."""
    conf = ((F.col("id") * 7919) % 1000).cast("double") / 1000
    kind = F.when(F.col("id") % 9 == 0, "hotel").when(F.col("id") % 9 == 1, "sport_culture").otherwise("office")
    rows = spark.range(4000).select(
        F.col("id").alias("bid"), kind.alias("archetype"), (kind == "sport_culture").alias("bundled_label"), (50.0 + F.col("id") % 90).alias("area_m2"),
        (F.col("id") % 40).cast("int").alias("floors"), kind.alias("pred_class"), conf.alias("pred_confidence"),
    )
    met = spark.sparkContext.accumulator(0)

    def seen(v):
        met.add(1)
        return v

    matched = spark.range(50).select(F.col("id").alias("val_id"), (F.udf(seen, "bigint")("id") * 3).alias("bid"))
    got = R.labelling_list(cut_lineage(rows), matched, [4], {"w": F.col("bid") < 500}, 1).collect()
    assert met.value == 50
    assert len({r.bid for r in got}) == len(got) and [r.bid for r in got if r.stratum == "reassess_4"] == [12]
    assert not {r.bid for r in got if r.stratum != "reassess_4"} & {3 * k for k in range(50)}
