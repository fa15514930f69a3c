"""Every registered query: the Spark side and, where one exists, the SQL side."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import duckdb_sql as D
from checks.duckdb_sql import statement
from perindex import registry as R
from perindex.functions import columns as C
from perindex.functions.codes import visit_types
from perindex.functions.periods import period_of, period_or_during, visit_in_period
from perindex.metrics import curves, threshold
from perindex.ml import model as M
from perindex.ml.explain import top_factors
from perindex.ml.split import assign_split, random_split
from perindex.operators import concepts, events, index_range as ir
from perindex.plans import (
    demographics,
    diagnoses,
    feature_table as ft,
    labs,
    medications,
    jobs,
    procedures,
    smoking,
    utilization as ut,
    vitals,
)
from perindex.session import checkpoint_dir, materialize
from perindex.sources import readers, schemas, writers
from perindex.sources.star_views import DEMO, ClinicalViews

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query on the clinical views under its function's name."""

    def wrap(build: Callable[[ClinicalViews], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(ClinicalViews(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = statement(sql)
        return build

    return wrap


def rounded(df: DataFrame, *names: str) -> DataFrame:
    chosen = set(names)
    return df.selectExpr(*[f"round({c}, 6) as {c}" if c in chosen else c for c in df.columns])


def index_of(v: ClinicalViews) -> DataFrame:
    return ir.index_range(v.cohort, v.visits)


def standard_of(v: ClinicalViews) -> DataFrame:
    return labs.standardise(labs.curate(v.named_measurement, v.concept_sets, DEMO.labs))


def icu_of(v: ClinicalViews) -> DataFrame:
    return ut.icu_visits(
        v.procedure_occurrence, v.condition_occurrence, v.observation, v.concept_sets, DEMO.icu
    )


# Sources and concept selection.

VIEW_NAMES = (
    "person", "visits", "cohort", "drug_exposure", "measurement", "observation",
    "condition_occurrence", "procedure_occurrence",
)


@query(
    " union all ".join(
        f"select '{n}' as table_name, count(*) as n_rows, count(distinct person_id) as n_persons from {n}"
        for n in VIEW_NAMES
    )
)
def omop_views(v):
    tables = {n: getattr(v, n) for n in VIEW_NAMES}
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(
                F.lit(n).alias("table_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_distinct("person_id").alias("n_persons"),
            )
            for n, df in tables.items()
        ],
    )


@query("select codeset_id, concept_id, concept_set_name, concept_name from concept_sets")
def concept_sets(v):
    return v.concept_sets


@query(
    "select person_id, visit_start_date from visits "
    "order by person_id, visit_start_date nulls first, visit_occurrence_id limit 3"
)
def sql_projection_limit(v):
    return v.spark.sql(
        "select person_id, visit_start_date from {visits} "
        "order by person_id, visit_start_date nulls first, visit_occurrence_id limit 3",
        visits=v.visits,
    )


def fresh_path(spark: SparkSession) -> str:
    """A folder that no other run writes to."""
    return f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


@query("select * from index_range")
def index_range_round_trip(v):
    """A stored index range, and nothing from a path where none is."""
    stored = index_of(v)
    writers.write_index_range(stored, path := fresh_path(v.spark))
    found = readers.read_index_range(v.spark, path)
    return found.unionByName(readers.read_index_range(v.spark, fresh_path(v.spark)))


@query(
    "select d.*, s.split from demographics d join (select person_id, case when cast('0x' || "
    "substr(md5(person_id || ':16'), 1, 8) as bigint) / 4294967296::double < 0.75 then 'train' else 'test' end "
    "as split from person) s on s.person_id = d.person_id where s.split = 'test'"
)
def features_round_trip(v):
    """A split of a stored feature table, after a second write has replaced the first."""
    table = assign_split(demographics.demographics(v.person), 0.25)
    path = fresh_path(v.spark)
    for share in (table.where("split = 'test'"), table):
        writers.write_features(share, path)
    return readers.read_features(v.spark, path, "test")


@query("select person_id, predict_prob, subgroup as dataset from scores")
def predictions_round_trip(v):
    scores = v.scores.withColumnRenamed("subgroup", "dataset")
    writers.write_predictions(scores, path := fresh_path(v.spark))
    return readers.read_predictions(v.spark, path)


@query(
    "select person_id, "
    + ", ".join(f"cast({-1 if c in R.LOS_COLUMNS else 0} as {'double' if c in R.LOS_COLUMNS else 'bigint'}) as {c}" for c in R.UTILIZATION_COLUMNS)
    + " from person"
)
def typed_empty_frames(v):
    """A family without rows still gives its columns, with the types and fills of a full one."""
    absent = readers.empty_features(v.spark, R.UTILIZATION_COLUMNS)
    rows = v.person.unionByName(readers.empty_frame(v.spark, schemas.PERSON), allowMissingColumns=True)
    return ut.fill_utilization(rows.select("person_id").join(absent, "person_id", "left"))


@query("select person_id as person, visit_occurrence_id as the_visit, visit_start_date as start_date from visits")
def rename_columns(v):
    rows = v.visits.select("person_id", F.col("visit_occurrence_id").alias("the visit"), "visit_start_date")
    return C.rename(rows, {"person_id": "person", "visit_start_date": "start_date", "absent": "unused"})


def _tag_sql(table: str, extra: dict[str, dict[str, str]]) -> str:
    columns = ", ".join(
        "case "
        + " ".join(f"when feature = '{f}' then '{x}'" for f, x in pairs.items())
        + f" else null end as {name}"
        if pairs
        else f"cast(null as varchar) as {name}"
        for name, pairs in extra.items()
    )
    return f"select *, {columns} from {table}"


@query(
    _tag_sql(
        "med_concepts",
        {
            "temporality": {f: "_".join(p) for f, p in DEMO.medications.periods.items()},
            "preferred_unit": {},
        },
    )
    + " union all "
    + _tag_sql("vital_concepts", {"temporality": {}, "preferred_unit": DEMO.vitals.units})
)
def concept_select(v):
    tagged = [concepts.tag_concepts(v.concept_sets, g) for g in (DEMO.medications, DEMO.vitals)]
    return tagged[0].unionByName(tagged[1])


@query(
    "select codeset_id, concept_id, concept_set_name from concept_sets "
    f"where codeset_id in ({D.codesets(DEMO.diagnoses)}, {D.codesets(DEMO.procedures)})"
)
def codeset_in_filter(v):
    wanted = DEMO.diagnoses.codesets + DEMO.procedures.codesets
    return concepts.members_of(v.concept_sets, wanted).select(
        "codeset_id", "concept_id", "concept_set_name"
    )


@query("select * from code_labels")
def code_labels(v):
    return demographics.code_labels(v.person)


# A dictionary over the set names of the demo views; PROMO and SMALL have no entry.
SET_NAMES = {"STANDARD": "std", "ECONOMY": "eco", "MEDIUM": "mid", "LARGE": "big"}


@query(
    "select concept_id, case "
    + " ".join(f"when concept_set_name = '{k}' then '{x}'" for k, x in SET_NAMES.items())
    + " else concept_set_name end as concept_set_name from concept_sets"
)
def name_harmonize(v):
    replaced = C.replace_values(v.concept_sets, "concept_set_name", SET_NAMES)
    return replaced.select("concept_id", "concept_set_name")


@query("select person_id, event_date, measurement_concept_id, value_as_number, feature from vital_events")
def vitals_filter(v):
    return vitals.vital_events(v.measurement, v.concept_sets, DEMO.vitals).select(
        "person_id", "event_date", "measurement_concept_id", "value_as_number", "feature"
    )


LAB_COLUMNS = [
    "person_id", "event_date", "panel", "measurement_concept_name", "value_as_number",
    "unit_concept_name",
]


@query(f"select {', '.join(LAB_COLUMNS)} from lab_curated")
def lab_curate(v):
    return labs.curate(v.named_measurement, v.concept_sets, DEMO.labs).select(*LAB_COLUMNS)


@query(
    "select visit_occurrence_id, is_ed, is_ip, is_tele, is_op from stays"
)
def visit_class(v):
    return v.visits.select(
        "visit_occurrence_id",
        *[c.alias(n) for n, c in visit_types("visit_concept_name").items()],
    )


@query("select visit_occurrence_id, stay_start_date, stay_end_date, cast(los as int) as los from stays")
def visit_los(v):
    return ut.stays(v.visits).select(
        "visit_occurrence_id", "stay_start_date", "stay_end_date", F.col("los").cast("int")
    )


@query(
    "select visit_occurrence_id, cast(case when los > 7 then 0 when los < 0 then 0 else los end as int) as los from stays"
)
def los_coerce(v):
    return ut.stays(v.visits, los_max=7).select("visit_occurrence_id", F.col("los").cast("int"))


@query("select * from demographics")
def demographics_features(v):
    return demographics.demographics(v.person)


QUERIES["demographics"] = QUERIES.pop("demographics_features")
ORACLES["demographics"] = ORACLES.pop("demographics_features")


@query(
    "select person_id, event_date, "
    + D.rounded(f"{f}_value" for f in R.CBC_FEATURES)
    + " from cbc_days"
)
def drop_units(v):
    days = labs.panel_by_day(standard_of(v), "cbc", R.CBC_FEATURES)
    kept = C.drop_matching(days, ".*unit")
    return rounded(kept, *[f"{f}_value" for f in R.CBC_FEATURES])


@query(
    "select person_id, "
    + ", ".join(
        f"cast(coalesce(sum(case when feature = '{f}' then n end), 0) as bigint) as {f}_during"
        for f in DEMO.procedures.names
    )
    + " from proc_long where period = 'during' group by 1"
)
def pivot_suffix(v):
    counts = procedures.procedure_counts(
        v.procedure_occurrence, v.concept_sets, index_of(v), DEMO.procedures
    )
    return C.affix(counts.where(F.col("period") == "during"), suffix="_during")


@query("select *, 0 as never_seen, 0 as also_missing from dx_counts")
def add_missing(v):
    counts = diagnoses.diagnosis_counts(v.condition_occurrence, v.concept_sets, DEMO.diagnoses)
    return C.add_missing(counts, ["never_seen", "asthma", "also_missing"])


IMPUTED = R.VITAL_COLUMNS + R.SMOKING_COLUMNS + R.MEDICATION_COLUMNS


@query(f"select person_id, {', '.join(IMPUTED)} from feature_table")
def impute(v):
    index = index_of(v)
    families = [
        vitals.vitals(v.measurement, v.concept_sets, index, DEMO.vitals),
        smoking.smoking_status(v.observation, v.concept_sets, DEMO.smoking),
        medications.medications(v.drug_exposure, v.concept_sets, index, DEMO.medications),
    ]
    sparse = ft.assemble(v.person.select("person_id"), families, index)
    return rounded(ft.impute(sparse), *R.VITAL_COLUMNS).select("person_id", *IMPUTED)


@query(
    "select person_id, "
    + ", ".join(R.INDEX_FLAG_COLUMNS + R.VISIT_COUNT_COLUMNS)
    + f", {D.rounded(R.LOS_COLUMNS)} from utilization"
)
def utilization_fill(v):
    index, staged = index_of(v), ut.stays(v.visits)
    sparse = (
        ut.index_visit_flags(index, staged)
        .join(ut.los_stats(staged, icu_of(v)), "person_id", "left")
        .join(ut.visit_counts(index, staged), "person_id", "left")
    )
    filled = ut.fill_utilization(sparse).select("person_id", *R.UTILIZATION_COLUMNS)
    return rounded(filled, *R.LOS_COLUMNS)


@query("select c.concept_id, c.codeset_id, c.feature, a.period as temporality from med_concepts c join med_allowed a on a.feature = c.feature")
def temporality_explode(v):
    tagged = concepts.tag_concepts(v.concept_sets, DEMO.medications)
    return tagged.select(
        "concept_id", "codeset_id", "feature",
        F.explode(F.split("temporality", "_")).alias("temporality"),
    )


# Index range and periods.


@query("select * from index_range")
def index_range(v):
    return index_of(v)


@query(
    f"select {D.INDEX_COLUMNS} from (select *, case when distance is not null then "
    "row_number() over (partition by person_id order by distance nulls first, visit_occurrence_id) "
    "else 1 end as rn from index_candidates) where rn = 1"
)
def index_range_as_written(v):
    return ir.index_range_nulls_first(v.cohort, v.visits)


@query(
    "select e.person_id, e.drug_concept_id, e.event_date, e.feature, "
    f"{D.PERIOD.format(d='e.event_date')} as period "
    "from med_events e left join index_range i on i.person_id = e.person_id"
)
def bucket_events(v):
    rows = medications.medication_events(v.drug_exposure, v.concept_sets, DEMO.medications)
    bucketed = events.with_period(rows, index_of(v), how="left", rule=period_of)
    return bucketed.select("person_id", "drug_concept_id", "event_date", "feature", "period")


@query("select person_id, procedure_concept_id, event_date, feature, period from proc_events")
def bucket_procedures(v):
    rows = procedures.procedure_events(v.procedure_occurrence, v.concept_sets, DEMO.procedures)
    bucketed = events.with_period(rows, index_of(v), how="left", rule=period_of)
    return bucketed.select("person_id", "procedure_concept_id", "event_date", "feature", "period")


@query(
    "select l.person_id, l.event_date, l.panel, l.value_as_number, "
    f"{D.LAB_PERIOD.format(d='l.event_date')} as period "
    "from lab_curated l left join index_range i on i.person_id = l.person_id"
)
def bucket_labs(v):
    rows = labs.curate(v.named_measurement, v.concept_sets, DEMO.labs)
    bucketed = events.with_period(rows, index_of(v), how="left", rule=period_or_during)
    return bucketed.select("person_id", "event_date", "panel", "value_as_number", "period")


def _visits_in(v: ClinicalViews, period: str) -> DataFrame:
    joined = v.visits.join(ir.index_interval(index_of(v)), "person_id", "left")
    test = visit_in_period(
        "visit_start_date", "visit_end_date", "index_start_date", "index_end_date"
    )[period]
    return joined.where(test).select(
        "person_id", "visit_occurrence_id", "visit_start_date", "visit_end_date"
    )


def _visits_sql(period: str) -> str:
    return (
        "select s.person_id, s.visit_occurrence_id, s.visit_start_date, s.visit_end_date "
        "from visits s left join index_range i on i.person_id = s.person_id "
        f"where {D.VISIT_TESTS[period]}"
    )


@query(_visits_sql("before"))
def visits_before(v):
    return _visits_in(v, "before")


@query(_visits_sql("during"))
def visits_during(v):
    return _visits_in(v, "during")


@query(_visits_sql("after"))
def visits_after(v):
    return _visits_in(v, "after")


# Joins.


@query("select * from med_events")
def med_events(v):
    return medications.medication_events(v.drug_exposure, v.concept_sets, DEMO.medications)


@query("select * from dx_events")
def dx_events(v):
    return diagnoses.diagnosis_events(v.condition_occurrence, v.concept_sets, DEMO.diagnoses)


@query(
    "select visit_occurrence_id, case when visit_occurrence_id in "
    "(select visit_occurrence_id from icu_visits) then 1 else 0 end as is_icu from visits"
)
def icu_flag(v):
    return ut.flag_icu(v.visits, icu_of(v)).select("visit_occurrence_id", "is_icu")


MERGED = [f"{f}_value" for f in R.LAB_FEATURES]


@query(
    "select greatest(h.person_id, m.person_id, b.person_id) as person_id, "
    "greatest(h.event_date, m.event_date, b.event_date) as event_date, "
    + D.rounded(MERGED)
    + " from htwt_days h full outer join cmp_days m on h.person_id = m.person_id and h.event_date = m.event_date "
    "full outer join cbc_days b on h.person_id = b.person_id and h.event_date = b.event_date"
)
def full_outer_coalesce(v):
    # Three joins read each panel more than once: store the picked rows between.
    standard = materialize(standard_of(v), "lab_standard")
    panels = [
        C.drop_matching(labs.panel_by_day(standard, name, features), ".*unit")
        for name, features in (
            ("htwt", R.HTWT_FEATURES), ("cmp", R.CMP_FEATURES), ("cbc", R.CBC_FEATURES),
        )
    ]
    merged = labs.merge_panels(*panels)
    return rounded(merged, *MERGED)


@query(f"select person_id, {D.rounded(R.LOS_COLUMNS)} from los_stats")
def los_stats(v):
    return rounded(ut.los_stats(ut.stays(v.visits), icu_of(v)), *R.LOS_COLUMNS)


# Aggregations and families.


@query("select * from med_counts")
def med_counts(v):
    return medications.medication_counts(
        v.drug_exposure, v.concept_sets, index_of(v), DEMO.medications
    )


@query("select * from med_wide")
def med_wide(v):
    return medications.medications(v.drug_exposure, v.concept_sets, index_of(v), DEMO.medications)


@query(
    "select person_id, feature, period, round(vital_avg, 6) as vital_avg, "
    "round(vital_stddev, 6) as vital_stddev, vital_count from vital_stats"
)
def vitals_stats(v):
    stats = vitals.vital_stats(v.measurement, v.concept_sets, index_of(v), DEMO.vitals)
    return rounded(stats, "vital_avg", "vital_stddev")


@query(f"select person_id, {D.rounded(D.VITAL_CELLS)} from vitals_wide")
def vitals_wide(v):
    wide = vitals.vitals(v.measurement, v.concept_sets, index_of(v), DEMO.vitals)
    return rounded(wide, *D.VITAL_CELLS)


@query("select * from dx_counts")
def dx_counts(v):
    return diagnoses.diagnosis_counts(v.condition_occurrence, v.concept_sets, DEMO.diagnoses)


@query(
    "select person_id, period, "
    + ", ".join(
        f"cast(coalesce(sum(case when feature = '{f}' then n end), 0) as bigint) as {f}"
        for f in DEMO.procedures.names
    )
    + " from proc_long group by 1, 2"
)
def proc_counts(v):
    return procedures.procedure_counts(
        v.procedure_occurrence, v.concept_sets, index_of(v), DEMO.procedures
    )


@query("select * from proc_wide")
def proc_wide(v):
    return procedures.procedures_wide(
        v.procedure_occurrence, v.concept_sets, index_of(v), DEMO.procedures
    )


@query("select * from smokers")
def smoking_status(v):
    return smoking.smoking_status(v.observation, v.concept_sets, DEMO.smoking)


QUERIES["smoking"] = QUERIES.pop("smoking_status")
ORACLES["smoking"] = ORACLES.pop("smoking_status")


@query(
    "select person_id, event_date, panel, feature, value_as_number as raw_value, "
    "unit_concept_name as raw_unit, round(value, 6) as value, unit from lab_pick"
)
def lab_pick(v):
    return rounded(labs.pick(standard_of(v)), "value")


def _panel_sql(cte: str, features: list[str]) -> str:
    cells = ", ".join(f"round({f}_value, 6) as {f}_value, {f}_unit" for f in features)
    return f"select person_id, event_date, {cells} from {cte}"


def _panel(v: ClinicalViews, panel: str, features: list[str]) -> DataFrame:
    days = labs.panel_by_day(standard_of(v), panel, features)
    return rounded(days, *[f"{f}_value" for f in features])


@query(_panel_sql("htwt_days", R.HTWT_FEATURES))
def htwt_standard(v):
    return _panel(v, "htwt", R.HTWT_FEATURES)


@query(_panel_sql("cbc_days", R.CBC_FEATURES))
def cbc_standard(v):
    return _panel(v, "cbc", R.CBC_FEATURES)


@query(_panel_sql("cmp_days", R.CMP_FEATURES))
def cmp_standard(v):
    return _panel(v, "cmp", R.CMP_FEATURES)


@query(
    "select person_id, event_date, "
    + ", ".join(
        f"max(case when feature = '{f}' then value end) as {f}" for f in R.IMMUNO_FEATURES
    )
    + " from lab_pick where panel = 'immuno' group by 1, 2 order by 1, 2"
)
def immuno_wide(v):
    return labs.immunoassay_by_day(standard_of(v)).orderBy("person_id", "event_date")


@query("select person_id, period, feature, round(value, 6) as value from lab_means")
def lab_means(v):
    return rounded(labs.lab_means(standard_of(v), index_of(v)), "value")


@query(f"select person_id, {D.rounded(D.LAB_CELLS)} from lab_wide")
def lab_wide(v):
    return rounded(labs.labs(standard_of(v), index_of(v)), *D.LAB_CELLS)


@query(
    "select person_id, "
    + ", ".join(f"{p}_{t}_cnt" for p in R.PERIODS for t in ut.TYPES)
    + " from counts_before full join counts_during using (person_id) "
    "full join counts_after using (person_id)"
)
def visit_counts(v):
    return ut.visit_counts(index_of(v), ut.stays(v.visits))


@query("select * from index_flags")
def index_visit_flags(v):
    return ut.index_visit_flags(index_of(v), ut.stays(v.visits))


@query(
    "select i.person_id, max(v.visit_concept_name) as visit_concept_name from index_range i "
    "left join visits v on v.person_id = i.person_id group by 1"
)
def index_visit_name_top1(v):
    return ut.last_visit_name(index_of(v), v.visits)


@query(
    "select person_id, "
    + ", ".join(R.INDEX_FLAG_COLUMNS + R.VISIT_COUNT_COLUMNS)
    + f", {D.rounded(R.LOS_COLUMNS)} from utilization"
)
def utilization(v):
    return rounded(ut.utilization(index_of(v), v.visits, icu_of(v)), *R.LOS_COLUMNS)


# Set operations and scalar functions.


@query(
    "select * from cohort union all select person_id + 1000000000, covid_index, null, null, null from cohort"
)
def cohort_union(v):
    return ir.combine_cohorts(v.cohort, v.blinded_cohort)


@query(
    "select * from visits union all select visit_occurrence_id, person_id + 1000000000, "
    "visit_start_date, visit_end_date, visit_concept_name, macrovisit_id, macrovisit_start_date, "
    "macrovisit_end_date from visits"
)
def visit_union(v):
    return v.visits.unionByName(v.blinded_visits)


@query(
    "select * from condition_occurrence union all select person_id + 1000000000, "
    "visit_occurrence_id, condition_concept_id from condition_occurrence"
)
def condition_union(v):
    return v.condition_occurrence.unionByName(v.blinded_conditions)


@query(
    "select v.visit_occurrence_id, coalesce(v.macrovisit_start_date, v.visit_start_date, c.covid_index) as start_date, "
    "cast(abs(v.visit_start_date - c.covid_index) as int) as distance, "
    "case when v.visit_concept_name like '%Emergency%' then 'ed' when v.visit_concept_name is null then 'none' "
    "else 'other' end as kind, greatest(v.visit_end_date, v.macrovisit_end_date, v.visit_start_date) as latest, "
    "v.visit_occurrence_id * 2.54::double as scaled "
    "from visits v join cohort c on c.person_id = v.person_id"
)
def scalar_mix(v):
    name = F.col("visit_concept_name")
    return v.visits.join(v.cohort, "person_id").select(
        "visit_occurrence_id",
        F.coalesce("macrovisit_start_date", "visit_start_date", "covid_index").alias("start_date"),
        F.abs(F.datediff("visit_start_date", "covid_index")).alias("distance"),
        F.when(name.like("%Emergency%"), "ed").when(name.isNull(), "none").otherwise("other").alias("kind"),
        F.greatest("visit_end_date", "macrovisit_end_date", "visit_start_date").alias("latest"),
        (F.col("visit_occurrence_id") * F.lit(2.54)).alias("scaled"),
    )


# Feature table, split, models.


def features_of(v: ClinicalViews) -> DataFrame:
    return ft.feature_table(v.tables(), DEMO)


@query("select * from feature_table")
def feature_table(v):
    return rounded(features_of(v), *sorted(R.DOUBLE_COLUMNS))


@query("select count(*) as n_rows, 263 as n_columns from feature_table")
def feature_table_shape(v):
    return jobs.shape(features_of(v))


@query(
    "select person_id, case when cast('0x' || substr(md5(person_id || ':16'), 1, 8) as bigint) "
    "/ 4294967296::double < 0.75 then 'train' else 'test' end as split from person"
)
def split_assign(v):
    return assign_split(v.person.select("person_id"), 0.25)


def stored_split(v: ClinicalViews) -> tuple[DataFrame, DataFrame]:
    """Training reads the features many times, so they are stored first."""
    return random_split(materialize(features_of(v), "features"), 0.25)


# A probability is no number that SQL could give; that every person has one, in range, is.
SPLIT_SQL = ORACLES["split_assign"].rsplit("\n", 1)[-1]
IN_RANGE = "predict_prob between 0 and 1"


@query(
    "select person_id, ["
    + ", ".join(f"round(cast({c} as double), 6)" for c in R.FEATURE_COLUMNS)
    + "] as features from feature_table"
)
def vectorize(v):
    numbers = M.vector_to_array("features")
    return M.vectorize(features_of(v)).select(
        "person_id", F.transform(numbers, lambda x: F.round(x, 6)).alias("features")
    )


@query(
    f"select f.person_id, f.{R.LABEL} as true_label, s.split as dataset, true as in_range "
    f"from feature_table f join ({SPLIT_SQL}) s on s.person_id = f.person_id"
)
def gbt_scores(v):
    train, test = stored_split(v)
    model = M.fit(train, M.boosted_trees())
    scored = M.score_datasets(model, {"train": train, "test": test})
    return scored.select("person_id", "true_label", "dataset", F.expr(IN_RANGE).alias("in_range"))


METRICS = ("precision", "recall", "f1_score", "area_under_roc", "average_precision", "brier_score")
ALL_IN_RANGE = " and ".join(f"{m} between 0 and 1" for m in METRICS)


@query(
    f"select s.split as dataset, count(f.{R.LABEL}) as n, true as in_range from feature_table f "
    f"join ({SPLIT_SQL}) s on s.person_id = f.person_id group by 1"
)
def score_datasets(v):
    train, test = stored_split(v)
    model = M.fit(train, M.candidates(len(R.FEATURE_COLUMNS))["logistic_regression"])
    metrics = threshold.metric_set(M.score_datasets(model, {"train": train, "test": test}))
    return metrics.select("dataset", "n", F.expr(ALL_IN_RANGE).alias("in_range"))


CANDIDATES = (
    "logistic_regression", "decision_tree", "random_forest", "gradient_boosted_trees", "multilayer_perceptron",
)


@query(
    "select m.model, t.n, true as in_range from ("
    + " union all ".join(f"select '{name}' as model" for name in CANDIDATES)
    + f") m cross join (select count(f.{R.LABEL}) as n from feature_table f "
    f"join ({SPLIT_SQL}) s on s.person_id = f.person_id where s.split = 'test') t"
)
def model_compare(v):
    compared = M.compare(*stored_split(v))
    return compared.select("model", "n", F.expr(ALL_IN_RANGE).alias("in_range"))


@query(
    " union all ".join(
        f"select 'maxDepth={depth}, stepSize={step}' as params, true as in_range"
        for depth in M.GRID["maxDepth"]
        for step in M.GRID["stepSize"]
    )
)
def cv_grid(v):
    train, _ = stored_split(v)
    found = M.grid_results(M.grid_search(train, parallelism=8), v.spark)
    return found.select("params", F.expr("area_under_roc between 0 and 1").alias("in_range"))


@query("select person_id, true as same from feature_table")
def model_round_trip(v):
    """Persons whose score is the same by a model and by its stored form."""
    features = materialize(features_of(v), "features")
    model = M.fit(features, M.candidates(len(R.FEATURE_COLUMNS))["logistic_regression"])
    M.save(model, path := fresh_path(v.spark))
    stored = M.score(M.load(path), features).select("person_id", F.col("predict_prob").alias("stored"))
    both = M.score(model, features).join(stored, "person_id")
    return both.select("person_id", F.expr("predict_prob = stored").alias("same"))


# Evaluation.


@query(
    "select person_id, case when predict_prob > 0.5 then 1 else 0 end as pred_label from scores"
)
def pred_label(v):
    return threshold.with_predictions(v.scores).select("person_id", "pred_label")


@query("select * from confusion")
def confusion(v):
    return threshold.confusion(v.scores)


@query(
    "select round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, "
    "round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1_score from confusion"
)
def prf(v):
    return rounded(threshold.precision_recall_f1(v.scores), "precision", "recall", "f1_score")


@query(
    "select predict_prob as threshold, round(tp / (tp + fp)::double, 6) as precision, "
    "round(tp / positives::double, 6) as recall from score_steps "
    "union all select null, 1.0, 0.0"
)
def pr_curve(v):
    return rounded(curves.precision_recall_curve(v.scores), "precision", "recall")


@query(f"select round({D.AP}, 6) as average_precision from score_steps")
def avg_precision(v):
    return rounded(curves.average_precision(v.scores), "average_precision")


ROC_SQL = (
    "select predict_prob as threshold, round(fp / negatives::double, 6) as fpr, "
    "round(tp / positives::double, 6) as tpr from score_steps"
)


@query(
    ROC_SQL + " where (tp = pos and fp = neg) or next_pos is null or pos <> next_pos or neg <> next_neg "
    "union all select null, 0.0, 0.0"
)
def roc_curve(v):
    return rounded(curves.roc_curve(v.scores), "fpr", "tpr")


@query(ROC_SQL + " union all select null, 0.0, 0.0")
def roc_curve_full(v):
    return rounded(curves.roc_curve(v.scores, drop_intermediate=False), "fpr", "tpr")


@query(f"select round({D.AUROC}, 6) as area_under_roc from score_steps")
def auroc(v):
    return rounded(curves.auroc(v.scores), "area_under_roc")


@query(f"select subgroup, round({D.AUROC}, 6) as area_under_roc from group_steps group by 1")
def auroc_by_group(v):
    return rounded(curves.auroc(v.scores, by=("subgroup",)), "area_under_roc")


@query(
    f"select {D.sql_bin('>')} as bin, round(avg(predict_prob), 6) as prob_pred, "
    "round(avg(true_label), 6) as prob_true, count(*) as n from scores group by 1"
)
def calibration(v):
    return rounded(threshold.calibration_curve(v.scores), "prob_pred", "prob_true")


@query("select round(avg((predict_prob - true_label) * (predict_prob - true_label)), 6) as brier_score from scores")
def brier(v):
    return rounded(threshold.brier_score(v.scores), "brier_score")


@query(
    "select cast(b.bin as int) as bin, count(s.person_id) as n from range(10) b(bin) left join "
    f"(select person_id, {D.sql_bin('>=')} as bin from scores where predict_prob between 0 and 1) s "
    "on s.bin = b.bin group by 1"
)
def score_hist(v):
    return threshold.score_histogram(v.scores)


REPORT_SQL = (
    "with c as (select tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn from confusion), "
    "k as (select '0' as class, tn / (tn + fn) as precision, tn / (tn + fp) as recall, "
    "2 * tn / (2 * tn + fn + fp) as f1_score, tn + fp as support from c union all "
    "select '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn from c), "
    "r as (select * from k union all "
    "select 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), "
    "(tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn from c union all "
    "select 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) from k union all "
    "select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1_score * support) / sum(support), sum(support) from k) "
    "select class, round(precision, 6) as precision, round(recall, 6) as recall, "
    "round(f1_score, 6) as f1_score, cast(support as bigint) as support from r"
)


@query()
def class_report(v):
    return rounded(threshold.class_report(v.scores), "precision", "recall", "f1_score")


_confusion = statement("select 1 from confusion").rsplit("\n", 1)[0]
ORACLES["class_report"] = _confusion + ",\n" + REPORT_SQL.removeprefix("with ")

# Coefficients of a linear model for the explanation query.
COEFFICIENTS = {
    "age": 0.02,
    "asthma": 0.4,
    "copd": 0.5,
    "obesity": 0.3,
    "hypertension": 0.25,
    "anticoagulants_before": 0.15,
    "corticosteroids_during": 0.6,
    "asthma_drugs_after": 0.35,
}
_MEANS = ", ".join(f"avg({n}) over () as mean_{n}" for n in COEFFICIENTS)
_PARTS = " union all ".join(
    f"select person_id, '{n}' as factor, {c!r}::double * ({n} - mean_{n}) as contribution from base"
    for n, c in COEFFICIENTS.items()
)
_base = statement(
    "select 1 from demographics, dx_counts, med_wide"
).rsplit("\n", 1)[0]
_filled = ", ".join(
    f"cast(coalesce({n}, 0) as double) as {n}" for n in COEFFICIENTS if n != "age"
)


@query()
def top_factors_query(v):
    index = index_of(v)
    families = [
        diagnoses.diagnosis_counts(v.condition_occurrence, v.concept_sets, DEMO.diagnoses),
        medications.medications(v.drug_exposure, v.concept_sets, index, DEMO.medications),
    ]
    table = ft.assemble(demographics.demographics(v.person), families, index)
    filled = materialize(
        table.select("person_id", *COEFFICIENTS).na.fill(0), "linear_features"
    )
    return rounded(top_factors(filled, COEFFICIENTS), "contribution")


QUERIES["top_factors"] = QUERIES.pop("top_factors_query")
ORACLES["top_factors"] = (
    _base
    + f",\nflat as (select d.person_id, cast(d.age as double) as age, {_filled} from demographics d "
    "left join dx_counts x on x.person_id = d.person_id "
    "left join med_wide m on m.person_id = d.person_id),\n"
    f"base as (select *, {_MEANS} from flat),\nparts as ({_PARTS})\n"
    "select person_id, cast(rn as int) as rank, factor, round(contribution, 6) as contribution from ("
    "select *, row_number() over (partition by person_id order by round(contribution, 9) desc, factor) as rn "
    "from parts) where rn <= 3"
)


@query(
    "select g.subgroup, g.area_under_roc, g.average_precision, t.precision, t.recall, t.f1_score, "
    f"t.brier_score, t.n from (select subgroup, round({D.AUROC}, 6) as area_under_roc, "
    f"round({D.AP}, 6) as average_precision from group_steps group by 1) g join ("
    "select subgroup, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, "
    "round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, "
    "round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1_score, "
    "round(brier, 6) as brier_score, n from (select subgroup, "
    "sum(case when true_label = 1 and predict_prob > 0.5 then 1 else 0 end)::double as tp, "
    "sum(case when true_label = 0 and predict_prob > 0.5 then 1 else 0 end)::double as fp, "
    "sum(case when true_label = 1 and predict_prob <= 0.5 then 1 else 0 end)::double as fn, "
    "avg((predict_prob - true_label) * (predict_prob - true_label)) as brier, count(*) as n "
    "from scores group by 1)) t on t.subgroup = g.subgroup"
)
def metric_set(v):
    return rounded(
        threshold.metric_set(v.scores, by=("subgroup",)),
        "precision", "recall", "f1_score", "area_under_roc", "average_precision", "brier_score",
    )
