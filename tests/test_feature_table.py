from __future__ import annotations

import math

import pytest
from conftest import by_key, day

from perindex import registry as R
from perindex.operators.concepts import concept_lookup
from perindex.operators.index_range import index_range
from perindex.operators.lookup import lookup_join
from perindex.plans import diagnoses, jobs, labs, medications, procedures, smoking, vitals
from perindex.plans import feature_table as ft
from perindex.plans import utilization as ut
from perindex.plans.demographics import demographics
from perindex.sources.readers import (
    empty_features,
    empty_frame,
    read_features,
    read_index_range,
    read_predictions,
)
from perindex.sources.star_views import DEMO, ClinicalViews
from perindex.session import materialize
from perindex.sources import schemas
from perindex.sources.versions import current

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return ClinicalViews(spark, FOLDER)


def separately(v: ClinicalViews):
    """The feature table from one plan per family, joined one after the other."""
    index = index_range(v.cohort, v.visits)
    sets = v.concept_sets
    standard = labs.standardise(labs.curate(v.named_measurement, sets, DEMO.labs))
    icu = ut.icu_visits(v.procedure_occurrence, v.condition_occurrence, v.observation, sets, DEMO.icu)
    families = [
        diagnoses.diagnosis_counts(v.condition_occurrence, sets, DEMO.diagnoses),
        labs.labs(standard, index),
        medications.medications(v.drug_exposure, sets, index, DEMO.medications),
        smoking.smoking_status(v.observation, sets, DEMO.smoking),
        procedures.procedures_wide(v.procedure_occurrence, sets, index, DEMO.procedures),
        ut.utilization(index, v.visits, icu),
        vitals.vitals(v.measurement, sets, index, DEMO.vitals),
    ]
    return ft.impute(ft.assemble(demographics(v.person), families, index))


def test_single_pass_equals_family_by_family(views):
    table = ft.feature_table(views.tables(), DEMO)
    assert table.columns == ["person_id", *R.FEATURE_COLUMNS, R.LABEL] and len(R.FEATURE_COLUMNS) == 261
    one, many = by_key(table, "person_id"), by_key(separately(views), "person_id")
    assert len(one) == views.person.count() and set(one) == set(many)
    for person, row in one.items():
        for name, value in row.items():
            other = many[person][name] if name != "Asian_Indian" else 0
            assert value == other or math.isclose(value, other, rel_tol=1e-12), (person, name)


def test_lookups_above_the_broadcast_bound_give_the_same_features(views):
    index = index_range(views.cohort, views.visits)
    one, many = (
        by_key(ft.event_features(views.tables(), index, DEMO, small), "person_id")
        for small in (True, False)
    )
    assert one == many and len(one) > 100


def test_empty_inputs_give_filled_rows(spark, table):
    tables = {
        name: empty_frame(spark, schemas.TABLES[name])
        for name in (
            "concept_set_members", "visits", "drug_exposure", "measurement", "observation",
            "condition_occurrence", "procedure_occurrence",
        )
    }
    tables["person"] = table("person", dict(person_id=1, year_of_birth=2000), dict(person_id=2))
    tables["cohort"] = table(
        "cohort", dict(person_id=1, covid_index=day("2020-01-01"), pasc_code_after_four_weeks=1)
    )
    rows = by_key(ft.feature_table(tables, R.PRODUCTION), "person_id")
    assert len(rows) == 2 and rows[1][R.LABEL] == 1 and rows[2][R.LABEL] is None
    assert rows[1]["age"] == 22 and rows[1]["avg_los"] == -1.0 and rows[2]["avg_los"] == 0.0
    for row in rows.values():
        assert all(row[c] == 0 for c in R.ZERO_FILLED if c not in R.LOS_COLUMNS)
        assert all(row[c] == -1 for c in R.MINUS_ONE_FILLED)


def test_missing_family_is_filled(spark, table):
    person = table("person", dict(person_id=1)).select("person_id")
    index = table("index_range", dict(person_id=1, pasc_code_after_four_weeks=0))
    empty = [empty_features(spark, R.UTILIZATION_COLUMNS), empty_features(spark, R.LAB_COLUMNS)]
    row = ft.impute(ft.assemble(person, empty, index)).first()
    assert row.avg_los == 0.0 and row.before_hgb_value == -1.0 and row.smoker == -1


def test_featurize_train_infer(spark, views, tmp_path):
    features = jobs.featurize(views.tables(), str(tmp_path / "out"), DEMO, test_share=0.25)
    assert features.count() == views.person.count()
    shape = jobs.shape(features).first()
    assert (shape.n_rows, shape.n_columns) == (features.count(), 264)
    train = read_features(spark, str(tmp_path / "out/features"), "train")
    test = read_features(spark, str(tmp_path / "out/features"), "test")
    assert train.count() + test.count() == features.count()
    jobs.train(train, str(tmp_path / "model"), rounds=2)
    metrics = jobs.infer({"train": train, "test": test}, str(tmp_path / "model"), str(tmp_path / "pred"))
    assert sorted(r.dataset for r in metrics.collect()) == ["test", "train"]
    predictions = read_predictions(spark, str(tmp_path / "pred"))
    assert set(predictions.columns) == {"person_id", "predict_prob", "dataset"}
    assert predictions.count() == features.count()
    stored = read_index_range(spark, str(tmp_path / "out/index_range"))
    assert stored.columns == schemas.INDEX_RANGE.names
    given = jobs.featurize(views.tables(), str(tmp_path / "again"), DEMO, index=stored)
    assert sorted(given.drop("split").collect()) == sorted(features.drop("split").collect())
    assert given.select("split").distinct().collect() == [("full",)]


def test_featurize_keeps_the_index_range_it_reads(spark, views, tmp_path):
    folder = str(tmp_path / "out")
    index_range(views.cohort, views.visits).write.parquet(f"{folder}/index_range")  # a plain folder
    before = sorted(spark.read.parquet(f"{folder}/index_range").collect())
    index = read_index_range(spark, f"{folder}/index_range")
    with pytest.raises(ValueError, match="more than once"):
        jobs.featurize(views.tables(), folder, DEMO, index=index.unionByName(index))
    assert sorted(read_index_range(spark, f"{folder}/index_range").collect()) == before
    jobs.featurize(views.tables(), folder, DEMO, index=index)
    again = read_index_range(spark, f"{folder}/index_range")
    assert sorted(again.collect()) == before
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted(
        ["_CURRENT", current(spark, folder)]
    )
    features = sorted(read_features(spark, f"{folder}/features").collect())

    def fail(*args):
        raise RuntimeError("lost")

    with pytest.MonkeyPatch.context() as patch:  # the index range is written, the features are not
        patch.setattr(jobs, "feature_table", fail)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.featurize(views.tables(), folder, DEMO, index=again.where("person_id < 100"))
    assert sorted(read_index_range(spark, f"{folder}/index_range").collect()) == before
    assert sorted(read_features(spark, f"{folder}/features").collect()) == features


def test_repeated_persons_are_refused(views):
    index = index_range(views.cohort, views.visits)
    with pytest.raises(ValueError, match="more than once"):
        ft.feature_table(views.tables(), DEMO, index.unionByName(index.where("person_id = 1")))


def scanned_roots(df) -> list[str]:
    """Root folder of every relation in a plan, once for each time that the plan reads it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    roots = []
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots.append(leaf.relation().location().rootPaths().mkString(","))
    return roots


def test_every_event_table_is_scanned_once(views, monkeypatch, tmp_path):
    tables = {}
    for name, df in views.tables().items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = views.spark.read.parquet(str(tmp_path / name))
    plans = []

    def recorded(df, name):
        plans.extend(scanned_roots(df))
        return materialize(df, name)

    monkeypatch.setattr(ft, "materialize", recorded)
    plans.extend(scanned_roots(ft.feature_table(tables, DEMO)))
    for name in ("measurement", "drug_exposure", "procedure_occurrence", "condition_occurrence", "observation", "person"):
        assert sum(root.endswith(f"/{name}") for root in plans) == 1, name
    # Once for the index range and once for the utilisation.
    assert sum(root.endswith("/visits") for root in plans) == 2


def test_icu_evidence_without_a_person_still_marks_its_visit(table):
    tables = {
        "concept_set_members": table("concept_set_members", dict(codeset_id=34, concept_id=1), dict(codeset_id=20, concept_id=1)),
        "procedure_occurrence": table(
            "procedure_occurrence",
            dict(visit_occurrence_id=7, procedure_concept_id=1),
            dict(person_id=1, visit_occurrence_id=7, procedure_concept_id=1, procedure_date=day("2020-01-01")),
            dict(person_id=1, procedure_concept_id=1, procedure_date=day("2020-01-01")),
        ),
        **{n: table(n) for n in ("measurement", "drug_exposure", "condition_occurrence", "observation")},
    }
    rows = ft.tagged_days(tables, DEMO).collect()
    assert [r.icu_visit for r in rows if r.feature == ft.ICU] == [7]
    # A code of both kinds feeds the feature as well: two events of one day, and one without a person.
    features = {(r.person_id, r.n) for r in rows if r.feature != ft.ICU}
    assert features == {(1, 2), (None, 1)}


def test_events_without_a_code_are_not_shuffled_by_the_joins_below(spark, views):
    lookup = concept_lookup(views.concept_sets, DEMO.procedures)
    for events, code in (
        (views.procedure_occurrence, "procedure_concept_id"), (views.drug_exposure, "drug_concept_id"),
        (views.named_measurement.where("value_as_number is not null"), "measurement_concept_id"),
    ):
        plan = lookup_join(events, lookup, code, "concept_id", small=True)._jdf.queryExecution().optimizedPlan()
        depth = {kind: [line.index("Join") for line in plan.toString().split("\n") if kind in line]
                 for kind in ("Join LeftSemi", "Join Inner, (l_orderkey")}
        assert min(depth["Join LeftSemi"]) > max(depth["Join Inner, (l_orderkey"])


def test_the_pivot_moves_day_rows_by_person_and_nothing_else(spark, views, tmp_path):
    index_range(views.cohort, views.visits).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    days = ft.tagged_days(views.tables(), DEMO)
    days.write.parquet(f"{tmp_path}/days")
    wide = ft._pivot(spark.read.parquet(f"{tmp_path}/days"), index, DEMO)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parts_by_person_follow_the_counted_persons(spark, views, monkeypatch):
    expected = sorted(ft.feature_table(views.tables(), DEMO).collect())
    index = materialize(index_range(views.cohort, views.visits), "index_range")
    assert ft.person_parts(index) is None
    monkeypatch.setattr(ft, "PERSONS_PER_TASK", 10)
    assert ft.person_parts(index) == math.ceil(index.count() / 10) > 10
    parted = ft.feature_table(views.tables(), DEMO, index)
    assert sorted(parted.collect()) == expected
    plan = parted._jdf.queryExecution().executedPlan().toString()
    assert f"{ft.person_parts(index)}), REPARTITION_BY_NUM" in plan
