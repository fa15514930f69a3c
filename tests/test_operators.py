from __future__ import annotations

from pyspark.sql import functions as F

from perindex.functions import columns as C
from perindex.operators import concepts, events
from perindex.operators.lookup import hot_keys, is_small, lookup_join, salted_sides
from perindex.registry import PRODUCTION


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def skewed_events(spark):
    """A third of the events share one code, another third one person."""
    return spark.range(9000).selectExpr(
        "if(id % 3 = 1, 7, id) as person_id",
        "if(id % 3 = 0, 1, 1 + id % 50) as code",
        "date_add(date '2020-01-01', cast(id % 40 as int)) as event_date",
    )


def test_lookup_is_broadcast_only_below_the_bound(spark):
    rows = skewed_events(spark)
    lookup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "concept_id long, feature string")
    assert is_small(lookup, 3) and not is_small(lookup, 2)
    small = lookup_join(rows, lookup, "code", "concept_id")
    large = lookup_join(
        rows, lookup, "code", "concept_id", small=False, spread_by=("person_id", "event_date")
    )
    assert "BroadcastHashJoin" in plan_of(small) and small.columns == large.columns
    assert sorted(small.collect()) == sorted(large.collect())


def test_only_hot_codes_are_salted(spark):
    rows = skewed_events(spark)
    lookup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (60, "d")], "concept_id long, feature string")
    assert {r.hot_key: r.salts for r in hot_keys(rows, "code", 500).collect()} == {1: 7}  # 3,120 events
    assert hot_keys(rows, "code").count() == 0 and hot_keys(rows.limit(0), "code").count() == 0
    left, right = salted_sides(rows, lookup, "code", "concept_id", ("person_id", "event_date"), 500)
    hot = [r["count"] for r in left.where("code = 1").groupBy("__salt").count().collect()]
    assert len(hot) == 7 and sum(hot) == 3120 and max(hot) < 700
    assert left.where("code <> 1").select("__salt").distinct().count() == 1
    repeated = {r.concept_id: r["count"] for r in right.groupBy("concept_id").count().collect()}
    assert repeated == {1: 14, 2: 1, 60: 1}
    on = (F.col("code") == F.col("concept_id")) & (F.col("__salt") == F.col("__lookup_salt"))
    joined = left.join(right, on).select("person_id", "code", "event_date", "feature")
    plain = lookup_join(rows, lookup, "code", "concept_id", small=True)
    assert sorted(joined.collect()) == sorted(plain.collect())


def test_events_are_folded_by_day_before_they_meet_the_index(spark):
    rows = skewed_events(spark).selectExpr("person_id", "event_date", "'f' as feature")
    days = events.daily_counts(rows)
    assert days.where("person_id = 7").count() <= 40
    index = spark.createDataFrame([(7,)], "person_id long").selectExpr(
        "person_id", "date '2020-01-05' as index_start_date", "date '2020-01-10' as index_end_date"
    )
    placed = events.with_period(days, index)
    found = {r.period: r.n for r in placed.groupBy("period").sum("n").toDF("period", "n").collect()}
    assert sum(found.values()) == rows.where("person_id = 7").count()


def test_a_hot_person_is_split_in_the_row_level_join(spark):
    """Row-level periods keep every event; the join itself must share a hot person."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 300_000, 1, 16).selectExpr(
            "if(id % 3 = 0, 7, id) as person_id", "id as event",
            "date_add(date '2020-01-01', cast(id % 40 as int)) as event_date",
        )
        index = spark.range(300_000).selectExpr(
            "id as person_id", "date '2020-01-05' as index_start_date",
            "date '2020-01-10' as index_end_date",
        )
        placed = events.with_period(rows, index, how="left")
        assert len(placed.select("person_id", "event", "period").collect()) == 300_000
        executed = placed.select("person_id", "event", "period")
        executed.collect()
        assert "skew=true" in plan_of(executed)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_concepts_are_tagged_once(spark, table):
    sets = table(
        "concept_set_members",
        dict(codeset_id=761556952, concept_id=1, concept_set_name="x", concept_name="y"),
        dict(codeset_id=761556952, concept_id=1, concept_set_name="x", concept_name="y"),
        dict(codeset_id=298033057, concept_id=2, concept_set_name="x", concept_name="y"),
        dict(codeset_id=1, concept_id=3, concept_set_name="x", concept_name="y"),
    )
    med = concepts.tag_concepts(sets, PRODUCTION.medications).collect()
    assert [(r.feature, r.temporality, r.preferred_unit) for r in med] == [
        ("anticoagulants", "before_after", None)
    ]
    vital = concepts.tag_concepts(sets, PRODUCTION.vitals).collect()
    assert [(r.feature, r.temporality, r.preferred_unit) for r in vital] == [("spo2", None, "percent")]
    assert concepts.concept_lookup(sets, PRODUCTION.medications).count() == 2
    assert concepts.concept_lookup(sets, PRODUCTION.medications, distinct=True).count() == 1
    assert concepts.all_small(sets, PRODUCTION)


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [(1, "before", 2.0, "cm"), (2, "after", None, None)],
        "person_id int, period string, h_value double, h_unit string",
    )
    assert C.affix(df, suffix="_x").columns == ["person_id", "h_value_x", "h_unit_x"]
    assert C.affix(df, prefix="x_").columns == ["person_id", "x_h_value", "x_h_unit"]
    assert C.drop_matching(df, ".*unit").columns == ["person_id", "period", "h_value"]
    assert C.rename(df, {"h_unit": "the unit", "none": "z"}).columns[-1] == "the_unit"
    assert C.add_missing(df, ["period", "new"], -1).first()["new"] == -1
    kept = C.replace_values(df, "period", {"before": "it's"}).collect()
    assert sorted(r.period for r in kept) == ["after", "it's"]
    assert C.replace_values(df, "period", {"before": "b"}, keep_unmapped=False).count() == 1
    quoted = spark.range(1).selectExpr(f"{C.sql_literal(chr(92) + chr(39))} as x").first().x
    assert quoted == "\\'"
