from __future__ import annotations

import math
import statistics

import pytest
from conftest import by_key, day

from perindex import registry as R
from perindex.plans import demographics, diagnoses, labs, medications, procedures, smoking
from perindex.plans import utilization as ut
from perindex.plans import vitals

P = R.PRODUCTION


@pytest.fixture(scope="module")
def index(table):
    return table(
        "index_range",
        dict(person_id=1, index_start_date=day("2020-03-05"), index_end_date=day("2020-03-10")),
        dict(person_id=2, index_start_date=day("2020-03-10"), index_end_date=day("2020-03-05")),
        dict(person_id=3, index_start_date=day("2020-03-05"), index_end_date=day("2020-03-05")),
    )


def members(table, *rows):
    return table(
        "concept_set_members",
        *[
            dict(codeset_id=s, concept_id=c, concept_set_name=n, concept_name=f"concept {c}")
            for s, c, n in rows
        ],
    )


def test_medications(table, index):
    sets = members(table, (761556952, 1, "a"), (761556952, 1, "a"), (804872085, 2, "b"), (7, 3, "c"))
    def drug(p, c, d):
        return dict(person_id=p, drug_concept_id=c, drug_exposure_start_date=day(d))

    drugs = table(
        "drug_exposure",
        drug(1, 1, "2020-03-04"), drug(1, 1, "2020-03-04"), drug(1, 1, "2020-03-06"),
        drug(1, 1, "2020-03-11"), drug(1, 2, "2020-03-05"), drug(1, 2, "2020-03-10"),
        drug(1, 2, "2020-03-11"), drug(1, 3, "2020-03-06"), drug(1, 2, None),
        drug(2, 1, "2020-03-07"), drug(9, 1, "2020-03-07"),
    )
    long = by_key(
        medications.medication_counts(drugs, sets, index, P.medications),
        "person_id", "period", "feature",
    )
    # The repeated member counts once; a period that is not allowed does not count.
    assert {k: r["med_count"] for k, r in long.items()} == {
        (1, "before", "anticoagulants"): 2,
        (1, "after", "anticoagulants"): 1,
        (1, "during", "corticosteroids"): 2,
        (2, "before", "anticoagulants"): 1,
    }
    wide = by_key(medications.medications(drugs, sets, index, P.medications), "person_id")
    assert set(R.MEDICATION_COLUMNS) < set(wide[1])
    assert wide[1]["corticosteroids_during"] == 2 and wide[1]["paxlovid_during"] == 0


def test_vitals(table, index):
    sets = members(table, (844379916, 5, "hr"))
    def row(p, d, x):
        return dict(person_id=p, measurement_concept_id=5, measurement_date=day(d), value_as_number=x)

    values = [60.0, 72.5, 60.1, 899.9, 0.0]
    measurement = table(
        "measurement",
        *[row(1, d, x) for d, x in zip(["2020-03-01", "2020-03-01", "2020-03-02", "2020-03-03", "2020-03-04"], values)],
        row(1, "2020-03-01", None), row(1, "2020-03-01", -1.0), row(1, "2020-03-01", 900.0),
        row(1, "2020-03-06", 80.0), row(1, None, 80.0), row(3, "2020-03-06", 70.0),
    )
    stats = by_key(
        vitals.vital_stats(measurement, sets, index, P.vitals), "person_id", "feature", "period"
    )
    before = stats[1, "heart_rate", "before"]
    assert before["vital_count"] == 5
    assert math.isclose(before["vital_avg"], statistics.mean(values))
    assert math.isclose(before["vital_stddev"], statistics.stdev(values))
    assert stats[1, "heart_rate", "during"]["vital_stddev"] is None
    assert stats[1, "heart_rate", None]["vital_count"] == 1
    wide = by_key(vitals.vitals(measurement, sets, index, P.vitals), "person_id")
    assert set(R.VITAL_COLUMNS) < set(wide[1])
    assert wide[1]["heart_rate_during"] == 80.0 and wide[1]["spo2_during"] is None
    assert wide[3]["heart_rate_after"] == 70.0


def test_deviation_of_equal_values_is_zero(table, index):
    sets = members(table, (844379916, 5, "hr"))
    measurement = table(
        "measurement",
        *[
            dict(person_id=1, measurement_concept_id=5, value_as_number=0.1,
                 measurement_date=day(f"2020-02-0{i}"))
            for i in range(1, 8)
        ],
    )
    row = vitals.vital_stats(measurement, sets, index, P.vitals).first()
    assert row.vital_stddev < 1e-15


def test_diagnoses_follow_name_or_code_set(table):
    sets = members(
        table,
        (834391873, 1, "HYPERTENSION"), (33199070, 2, "some COPD set"), (602584947, 3, "[VSAC] Asthma "),
        (834391873, 4, "HEART FAILURE"), (5, 6, "HYPERTENSION"),
    )
    conditions = table(
        "condition_occurrence",
        *[dict(person_id=p, condition_concept_id=c) for p, c in [(1, 1), (1, 1), (1, 2), (2, 3), (2, 4), (3, 6)]],
    )
    found = by_key(diagnoses.diagnosis_counts(conditions, sets, P.diagnoses), "person_id")
    assert sorted(found) == [1, 2]
    assert (found[1]["hypertension"], found[1]["copd"], found[1]["asthma"]) == (2, 1, 0)
    assert (found[2]["asthma"], found[2]["heart_failure"], found[2]["hypertension"]) == (1, 1, 0)


def test_procedures(table, index):
    sets = members(table, (260036299, 1, "Chest x-ray"), (469361388, 2, "[ICU/MODS]IMV"), (260036299, 3, "other"))
    def done(p, c, d):
        return dict(person_id=p, procedure_concept_id=c, procedure_date=day(d))

    rows = table(
        "procedure_occurrence",
        done(1, 1, "2020-03-01"), done(1, 1, "2020-03-01"), done(1, 2, "2020-03-10"),
        done(1, 3, "2020-03-10"), done(1, 1, None), done(2, 1, "2020-03-10"),
    )
    long = by_key(procedures.procedure_counts(rows, sets, index, P.procedures), "person_id", "period")
    assert sorted(long) == [(1, "before"), (1, "during"), (2, "after")]
    wide = by_key(procedures.procedures_wide(rows, sets, index, P.procedures), "person_id")
    assert set(wide[1]) == {"person_id", *R.PROCEDURE_COLUMNS}
    assert wide[1]["before_Chest_X_ray"] == 2 and wide[1]["during_Ventilator_used"] == 1
    assert wide[2]["after_Chest_X_ray"] == 1 and wide[2]["during_Chest_X_ray"] == 0


def test_smoking(table):
    sets = members(table, (628969102, 1, "s"))
    seen = table(
        "observation",
        *[dict(person_id=p, observation_concept_id=c) for p, c in [(1, 1), (1, 1), (2, 2)]],
    )
    assert by_key(smoking.smoking_status(seen, sets, P.smoking), "person_id") == {
        1: dict(person_id=1, smoker=1)
    }


def test_demographics(table):
    person = table(
        "person",
        dict(person_id=1, year_of_birth=1980, gender_concept_id=8532, race_concept_id=8516,
             ethnicity_concept_id=38003563),
        dict(person_id=2, gender_concept_id=0, race_concept_id=8657),
    )
    found = by_key(demographics.demographics(person), "person_id")
    assert found[1]["age"] == 42 and found[1]["FEMALE"] == 1 and found[1]["MALE"] == 0
    assert found[1]["Black_or_African_American"] == 1 and found[1]["Hispanic_or_Latino"] == 1
    assert all(v == 0 for k, v in found[2].items() if k != "person_id")
    names = by_key(demographics.code_labels(person), "person_id")
    assert names[2]["race_concept_name"] == "American_Indian_or_AL_Native"
    assert names[2]["gender_concept_name"] == "" and names[2]["ethnicity_concept_name"] == ""


NAMES = {f: n for _, n, f in R.lab_names()}
PANELS = {f: p for p, _, f in R.lab_names()}
SETS = {"htwt": 854721978, "cbc": 985622897, "cmp": 212998332, "immuno": 459475527}


def lab_rows(table, *rows):
    """Rows (person, date, feature, value, unit) as measurements and members."""
    panels = list(SETS)
    sets = members(table, *[(s, i, p) for i, (p, s) in enumerate(SETS.items())])
    measurement = table(
        "measurement",
        *[
            dict(person_id=p, measurement_date=day(d), value_as_number=x, unit_concept_name=u,
                 measurement_concept_name=NAMES.get(f, f),
                 measurement_concept_id=panels.index(PANELS.get(f, "cbc")))
            for p, d, f, x, u in rows
        ],
    )
    return labs.standardise(labs.curate(measurement, sets, P.labs))


@pytest.mark.parametrize("features, target, synonyms", R.STRICT_UNITS)
def test_strict_units(table, features, target, synonyms):
    units = [target, *synonyms, "nonsense", R.NO_MATCH]
    rows = [(1, "2020-01-01", f, 7.0, u) for f in features for u in units]
    found = {
        (r.feature, r.unit_concept_name): (r.value, r.unit) for r in lab_rows(table, *rows).collect()
    }
    for feature in features:
        for unit in units:
            good = unit == target or unit in synonyms
            assert found[feature, unit] == ((7.0, target) if good else (None, unit))


def test_size_units(table):
    rows = [(1, "2020-01-01", f, 10.0, u) for f, u, _, _ in R.SIZE_UNITS]
    rows += [(1, "2020-01-01", "body_height", 10.0, "centimeter"), (1, "2020-01-01", "body_weight", 10.0, "pound (US)")]
    found = {(r.feature, r.unit_concept_name): r.value for r in lab_rows(table, *rows).collect()}
    assert found["body_height", "Inches"] == 25.4 and found["body_height", "meter"] == 1000.0
    assert found["body_height", None] is None and found["body_height", "centimeter"] == 10.0
    assert found["body_weight", "kilogram"] == pytest.approx(22.0462)
    assert found["body_weight", "meter"] is None and found["body_weight", "pound (US)"] == 10.0


def test_other_labs_keep_any_unit_and_unknown_names_drop(table):
    rows = lab_rows(
        table, (1, "2020-01-01", "anion_gap", 4.0, "odd"), (1, "2020-01-01", "no such test", 4.0, None),
        (None, "2020-01-01", "hgb", 4.0, None), (1, "2020-01-01", "hgb", None, None),
    ).collect()
    assert [(r.feature, r.value, r.unit) for r in rows] == [("anion_gap", 4.0, "odd")]


def test_daily_pick_prefers_an_accepted_unit(table, index):
    standard = lab_rows(
        table,
        (1, "2020-03-01", "hgb", 3.0, "nonsense"), (1, "2020-03-01", "hgb", 9.0, None),
        (1, "2020-03-01", "hgb", 8.0, "gram per deciliter"), (1, "2020-03-02", "hgb", 4.0, "nonsense"),
        (1, "2020-03-03", "hgb", 10.0, R.NO_MATCH), (1, None, "hgb", 20.0, None),
        (7, "2020-03-03", "sodium", 140.0, None), (2, "2020-03-07", "sodium", 141.0, None),
    )
    picked = by_key(labs.pick(standard), "person_id", "event_date", "feature")
    first = picked[1, day("2020-03-01"), "hgb"]
    assert (first["value"], first["raw_value"], first["unit"]) == (8.0, 8.0, "gram per deciliter")
    assert picked[1, day("2020-03-02"), "hgb"]["value"] is None
    means = by_key(labs.lab_means(standard, index), "person_id", "period", "feature")
    assert means[1, "before", "hgb"]["value"] == 9.0
    assert means[1, "during", "hgb"]["value"] == 20.0  # no date
    assert means[7, "during", "sodium"]["value"] == 140.0  # no index
    assert means[2, "after", "sodium"]["value"] == 141.0  # inverted interval
    wide = by_key(labs.labs(standard, index), "person_id")
    assert set(wide[1]) == {"person_id", *R.LAB_COLUMNS}
    assert wide[1]["before_hgb_value"] == 9.0 and wide[1]["after_hgb_value"] is None


def test_panels_merge_on_height_and_weight_days(table):
    standard = lab_rows(
        table,
        (1, "2020-01-01", "body_height", 170.0, "centimeter"), (1, "2020-01-01", "sodium", 1.0, None),
        (1, "2020-01-01", "hgb", 2.0, None), (1, "2020-01-02", "sodium", 3.0, None),
        (1, "2020-01-02", "hgb", 4.0, None),
    )
    panels = [
        labs.panel_by_day(standard, p, f)
        for p, f in (("htwt", R.HTWT_FEATURES), ("cmp", R.CMP_FEATURES), ("cbc", R.CBC_FEATURES))
    ]
    rows = labs.merge_panels(*panels).collect()
    found = sorted(
        ((r.event_date, r.body_height_value, r.sodium_value, r.hgb_value) for r in rows), key=str
    )
    assert found == [
        (day("2020-01-01"), 170.0, 1.0, 2.0),
        (day("2020-01-02"), None, 3.0, None),
        (day("2020-01-02"), None, None, 4.0),
    ]


def test_circulated_names_can_be_restored():
    names = {n: f for _, n, f in R.lab_names(as_written=True)}
    assert names["Dry body weight Measured"] == "dry_body_height"
    changed = [n for _, n, f in R.lab_names() if names[n] != f]
    assert sorted(changed) == sorted(R.AS_WRITTEN_NAMES)


def visit(person, number, start, end, name="Office Visit", macro=(None, None)):
    return dict(
        person_id=person, visit_occurrence_id=number, visit_start_date=day(start),
        visit_end_date=day(end), visit_concept_name=name, macrovisit_start_date=day(macro[0]),
        macrovisit_end_date=day(macro[1]),
    )


@pytest.fixture(scope="module")
def visited(table):
    visits = table(
        "visits",
        visit(1, 1, "2020-03-01", "2020-03-03", "Emergency Room Visit"),
        visit(1, 2, "2020-03-05", "2020-03-09", "Inpatient Visit", ("2020-03-04", "2020-03-08")),
        visit(1, 3, "2020-03-06", "2020-03-08", "Inpatient Visit", ("2020-03-04", "2020-03-08")),
        visit(1, 4, "2020-03-04", "2020-03-06", "Office Visit"),  # straddles the start
        visit(1, 5, "2020-03-20", None, "Telehealth Visit"),
        visit(1, 6, "2020-04-20", "2020-04-10", None),  # negative stay, no name
        visit(3, 7, None, "2020-03-01", "Emergency Room Visit"),
    )
    icu = members(table, (469361388, 9, "icu"), (469361388, 9, "icu"))
    procedure = table("procedure_occurrence", dict(person_id=1, visit_occurrence_id=2, procedure_concept_id=9))
    condition = table(
        "condition_occurrence",
        dict(person_id=1, visit_occurrence_id=2, condition_concept_id=9),
        dict(person_id=1, condition_concept_id=9),
    )
    observation = table("observation", dict(person_id=1, visit_occurrence_id=1, observation_concept_id=8))
    return visits, ut.icu_visits(procedure, condition, observation, icu, P.icu)


def test_icu_flag_does_not_repeat_visits(visited):
    visits, icu = visited
    flags = by_key(ut.flag_icu(visits, icu), "visit_occurrence_id")
    assert {k: r["is_icu"] for k, r in flags.items()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_stays(visited):
    visits, _ = visited
    found = by_key(ut.stays(visits), "visit_occurrence_id")
    assert {k: r["los"] for k, r in found.items()} == {1: 2, 2: 4, 3: 4, 4: 2, 5: 0, 6: -10, 7: None}
    assert [found[6][f"is_{t}"] for t in ut.TYPES] == [0, 0, 0, 0]
    capped = by_key(ut.stays(visits, los_max=3), "visit_occurrence_id")
    assert [capped[k]["los"] for k in (1, 2, 6)] == [2, 0, 0]


def test_utilization(visited, index):
    visits, icu = visited
    found = by_key(ut.utilization(index, visits, icu), "person_id")
    one = found[1]
    # Distinct stays: 2, 4 (shared by two visits), 2, 0 and -10 days.
    assert one["avg_los"] == pytest.approx((2 + 4 + 2 + 0 - 10) / 5) and one["avg_icu_los"] == 4
    assert (one["before_ed_cnt"], one["during_ip_cnt"], one["before_op_cnt"], one["during_op_cnt"]) == (1, 2, 0, 0)
    assert one["after_ed_cnt"] == 0 and one["is_index_ed"] == 1 and one["is_index_op"] == 1
    # No visit at all.
    assert found[2]["avg_los"] == -1 and found[2]["avg_icu_los"] == -1 and found[2]["is_index_op"] == 0
    # Only an undated visit: its length is unknown, its ICU average is 0.
    assert found[3]["avg_los"] == -1 and found[3]["avg_icu_los"] == 0 and found[3]["is_index_ed"] == 1
    staged = ut.stays(visits)
    parts = (
        ut.index_visit_flags(index, staged)
        .join(ut.los_stats(staged, icu), "person_id", "left")
        .join(ut.visit_counts(index, staged), "person_id", "left")
    )
    assembled = by_key(ut.fill_utilization(parts).select("person_id", *R.UTILIZATION_COLUMNS), "person_id")
    assert assembled == found
