"""DuckDB statements that recompute every registered query from the raw tables.

They state the definitions directly (window ranks, direct group-bys, full joins)
and share no shortcut with the Spark plans. ``statement`` puts the common table
expressions a text names in front of it.
"""

from __future__ import annotations

import re

from perindex import registry as R
from perindex.functions import codes
from perindex.metrics.threshold import bin_edges
from perindex.sources.star_views import DEMO, DEMO_LAB_NAMES, DEMO_UNITS


def text(value: object) -> str:
    if value is None:
        return "null"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def double(value: float | None) -> str:
    return "null::double" if value is None else f"'{value!r}'::double"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(row) + ")" for row in rows)
    return f"select * from (values {body}) as t({columns})"


def codesets(group: R.CodeGroup) -> str:
    return ", ".join(str(c) for c in group.codesets)


def feature_case(group: R.CodeGroup) -> str:
    whens = " ".join(f"when {c} then {text(f)}" for c, f in group.features.items())
    return f"case codeset_id {whens} end"


def listed(items) -> str:
    return ", ".join(text(i) for i in items)


def tagged(group: R.CodeGroup) -> str:
    return (
        f"select distinct codeset_id, concept_id, concept_set_name, concept_name, "
        f"{feature_case(group)} as feature from concept_sets where codeset_id in ({codesets(group)})"
    )


def lab_name_case() -> str:
    whens = " ".join(
        f"when p_size = {codeset} then "
        f"([{listed(names)}])[cast(p_partkey % {len(names)} as int) + 1]"
        for codeset, names in DEMO_LAB_NAMES.items()
    )
    return f"case when p_partkey % 11 = 0 then p_type {whens} end"


UNIT_LIST = ", ".join(text(u) for u in DEMO_UNITS)

PERIOD = (
    "case when {d} >= i.index_start_date and {d} <= i.index_end_date then 'during' "
    "when {d} < i.index_start_date then 'before' when {d} > i.index_end_date then 'after' end"
)
LAB_PERIOD = (
    "case when {d} > i.index_end_date then 'after' "
    "when {d} < i.index_start_date then 'before' else 'during' end"
)
INDEX_COLUMNS = (
    "person_id, visit_occurrence_id, macrovisit_id, covid_index, visit_start_date, "
    "visit_end_date, macrovisit_start_date, macrovisit_end_date, index_start_date, "
    "index_end_date, pasc_code_after_four_weeks, pasc_code_prior_four_weeks, time_to_pasc"
)

CTES: dict[str, str] = {
    "person": "select c_custkey as person_id, 1930 + cast(c_custkey % 80 as int) as year_of_birth, "
    "case c_custkey % 3 when 0 then 8532 when 1 then 8507 else 0 end as gender_concept_id, "
    "case c_mktsegment when 'AUTOMOBILE' then 8515 when 'BUILDING' then 8516 "
    "when 'FURNITURE' then 8527 when 'HOUSEHOLD' then 8557 else 8552 end as race_concept_id, "
    "case n_regionkey when 0 then 38003563 when 1 then 38003564 else 0 end as ethnicity_concept_id "
    "from customer join nation on c_nationkey = n_nationkey",
    "concept_sets": "select cast(p_size as bigint) as codeset_id, p_partkey as concept_id, "
    "p_type as concept_set_name, p_name as concept_name from part "
    "union all select 100 + p_partkey % 7, p_partkey, p_brand, p_name from part "
    "where p_partkey % 3 = 0",
    "visits": "select o_orderkey as visit_occurrence_id, o_custkey as person_id, "
    "case when o_orderkey % 97 = 0 then null else cast(o_orderdate as date) end as visit_start_date, "
    "case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 12 as int) end as visit_end_date, "
    "case o_orderpriority when '1-URGENT' then 'Emergency Room Visit' when '2-HIGH' then 'Inpatient Visit' "
    "when '3-MEDIUM' then 'Telehealth Visit' when '4-NOT SPECIFIED' then null else 'Office Visit' end as visit_concept_name, "
    "case when o_orderstatus = 'P' then o_orderkey end as macrovisit_id, "
    "case when o_orderstatus = 'P' then cast(o_orderdate as date) - 1 end as macrovisit_start_date, "
    "case when o_orderstatus = 'P' then cast(o_orderdate as date) + cast(o_orderkey % 15 as int) end as macrovisit_end_date "
    "from orders",
    "cohort": "select c_custkey as person_id, date '1997-01-01' + cast(c_custkey * 37 % 900 as int) as covid_index, "
    "case when c_custkey % 5 = 0 then 1 else 0 end as pasc_code_after_four_weeks, "
    "case when c_custkey % 50 = 1 then 1 else 0 end as pasc_code_prior_four_weeks, "
    "case when c_custkey % 5 = 0 then 28 + cast(c_custkey % 200 as int) end as time_to_pasc from customer",
    "measurement": "select o_custkey as person_id, l_orderkey as visit_occurrence_id, "
    "cast(l_shipdate as date) as measurement_date, l_partkey as measurement_concept_id, "
    f"{lab_name_case()} as measurement_concept_name, "
    "case when l_quantity = 13 then null when l_quantity = 17 then 950::double "
    "when l_quantity = 19 then -1::double else l_quantity end as value_as_number, "
    f"([{UNIT_LIST}])[cast(l_suppkey % {len(DEMO_UNITS)} as int) + 1] as unit_concept_name "
    "from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    "drug_exposure": "select o_custkey as person_id, l_partkey as drug_concept_id, "
    "cast(l_shipdate as date) as drug_exposure_start_date, l_suppkey as drug_type_concept_id "
    "from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'O'",
    "condition_occurrence": "select o_custkey as person_id, l_orderkey as visit_occurrence_id, "
    "l_partkey as condition_concept_id from lineitem join orders on l_orderkey = o_orderkey "
    "where l_linestatus = 'F'",
    "procedure_occurrence": "select o_custkey as person_id, l_orderkey as visit_occurrence_id, "
    "l_partkey as procedure_concept_id, cast(l_shipdate as date) as procedure_date "
    "from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'",
    "observation": "select user_id as person_id, event_id as visit_occurrence_id, "
    "cast(ts as date) as observation_date, event_id % 2000 as observation_concept_id from events",
    "scores": "select labels.doc_id as person_id, lang as subgroup, quality as true_label, "
    "round(n_chars / (n_chars + cast(1000 as double)), 2) as predict_prob "
    "from labels join documents on labels.doc_id = documents.doc_id",
    # Index range: rank all of a person's visits.
    "index_candidates": "select s.*, v.visit_occurrence_id, v.macrovisit_id, v.visit_start_date, "
    "v.visit_end_date, v.macrovisit_start_date, v.macrovisit_end_date, "
    "coalesce(v.macrovisit_start_date, v.visit_start_date, s.covid_index) as index_start_date, "
    "coalesce(v.macrovisit_end_date, v.visit_end_date, s.covid_index) as index_end_date, "
    "abs(v.visit_start_date - s.covid_index) as distance "
    "from cohort s left join visits v on v.person_id = s.person_id",
    "index_range": f"select {INDEX_COLUMNS} from (select *, row_number() over (partition by person_id "
    "order by distance nulls last, visit_occurrence_id nulls last) as rn from index_candidates) "
    "where rn = 1",
    # Concept selections.
    "med_concepts": tagged(DEMO.medications),
    "vital_concepts": tagged(DEMO.vitals),
    # Events.
    "med_events": "select d.person_id, d.drug_concept_id, d.drug_type_concept_id, "
    "d.drug_exposure_start_date as event_date, c.feature "
    "from drug_exposure d join med_concepts c on d.drug_concept_id = c.concept_id",
    "med_allowed": values(
        [
            (text(f), text(p))
            for f, periods in DEMO.medications.periods.items()
            for p in periods
        ],
        "feature, period",
    ),
    "med_counts": f"select e.person_id, {PERIOD.format(d='e.event_date')} as period, e.feature, "
    "count(*) as med_count from med_events e left join index_range i on i.person_id = e.person_id "
    "join med_allowed a on a.feature = e.feature "
    f"and a.period = {PERIOD.format(d='e.event_date')} group by 1, 2, 3",
    "dx_events": "select e.person_id, e.visit_occurrence_id, e.condition_concept_id, "
    f"{feature_case(DEMO.diagnoses)} as feature from condition_occurrence e join concept_sets c "
    f"on e.condition_concept_id = c.concept_id where codeset_id in ({codesets(DEMO.diagnoses)})",
    "proc_events": "select e.person_id, e.visit_occurrence_id, e.procedure_concept_id, "
    f"e.procedure_date as event_date, {feature_case(DEMO.procedures)} as feature, "
    f"case when e.procedure_date < i.index_start_date then 'before' "
    "when e.procedure_date >= i.index_start_date and e.procedure_date <= i.index_end_date then 'during' "
    "when e.procedure_date > i.index_end_date then 'after' end as period "
    "from procedure_occurrence e join concept_sets c on e.procedure_concept_id = c.concept_id "
    "left join index_range i on i.person_id = e.person_id "
    f"where codeset_id in ({codesets(DEMO.procedures)})",
    "vital_events": "select m.person_id, m.measurement_date as event_date, "
    "m.measurement_concept_id, m.value_as_number, c.feature, "
    f"{PERIOD.format(d='m.measurement_date')} as period from measurement m "
    "left join vital_concepts c on m.measurement_concept_id = c.concept_id "
    "left join index_range i on i.person_id = m.person_id "
    "where c.feature is not null and m.value_as_number is not null "
    "and m.value_as_number >= 0 and m.value_as_number < 900",
    "smokers": "select distinct o.person_id, 1 as smoker from observation o join concept_sets c "
    f"on o.observation_concept_id = c.concept_id where codeset_id in ({codesets(DEMO.smoking)})",
    # Labs.
    "lab_curated": "select m.person_id, m.measurement_date as event_date, "
    f"{feature_case(DEMO.labs)} as panel, m.measurement_concept_name, m.value_as_number, "
    "m.unit_concept_name from measurement m join concept_sets c "
    f"on m.measurement_concept_id = c.concept_id where codeset_id in ({codesets(DEMO.labs)}) "
    "and m.person_id is not null and m.value_as_number is not null",
    "lab_names": values(
        [tuple(text(x) for x in row) for row in R.lab_names()], "panel, concept_name, feature"
    ),
    "unit_rules": values(
        [
            (text(f), text(u) + "::varchar", double(x), text(t) + "::varchar")
            for f, u, x, t in R.unit_rules()
        ],
        "feature, unit, factor, to_unit",
    ),
    "lab_standard": "select l.person_id, l.event_date, l.panel, n.feature, l.value_as_number, "
    "l.unit_concept_name, "
    "case when r.feature is not null then l.value_as_number * r.factor "
    f"when n.feature in ({listed(R.STRICT_FEATURES)}) then null else l.value_as_number end as value, "
    "case when r.feature is not null then r.to_unit else l.unit_concept_name end as unit "
    "from lab_curated l join lab_names n "
    "on n.panel = l.panel and n.concept_name = l.measurement_concept_name "
    "left join unit_rules r on r.feature = n.feature and r.unit is not distinct from l.unit_concept_name",
    "lab_pick": "select * exclude (rn) from (select *, row_number() over ("
    "partition by person_id, event_date, panel, feature order by value is null, value, "
    "value_as_number, unit_concept_name nulls last, unit nulls last) as rn from lab_standard) where rn = 1",
    "lab_means": f"select p.person_id, {LAB_PERIOD.format(d='p.event_date')} as period, p.feature, "
    "avg(p.value) as value from lab_pick p left join index_range i on i.person_id = p.person_id "
    f"where p.feature in ({listed(R.LAB_FEATURES)}) group by 1, 2, 3",
    # Utilisation.
    # A stay is the macro visit where there is one; kind tests go by the words of the visit's name.
    "staged": "select *, coalesce(macrovisit_start_date, visit_start_date) as stay_start_date, "
    "coalesce(macrovisit_end_date, visit_end_date) as stay_end_date, "
    "contains(visit_concept_name, 'Emergency') as named_ed, contains(visit_concept_name, 'Inpatient') as named_ip, "
    "contains(visit_concept_name, 'Tele') as named_tele from visits",
    "stays": "select person_id, visit_occurrence_id, visit_start_date, visit_end_date, visit_concept_name, "
    "named_ed, named_ip, named_tele, stay_start_date, stay_end_date, "
    "if(stay_end_date is null, 0, date_diff('day', stay_start_date, stay_end_date)) as los, "
    "if(named_ed, 1, 0) as is_ed, if(named_ip, 1, 0) as is_ip, if(named_tele, 1, 0) as is_tele, "
    "if(not (named_ed or named_ip or named_tele), 1, 0) as is_op from staged",
    "icu_concepts": f"select concept_id from concept_sets where codeset_id in ({codesets(DEMO.icu)})",
    "icu_visits": "select visit_occurrence_id from procedure_occurrence where procedure_concept_id in (select concept_id from icu_concepts) "
    "union select visit_occurrence_id from condition_occurrence where condition_concept_id in (select concept_id from icu_concepts) "
    "union select visit_occurrence_id from observation where observation_concept_id in (select concept_id from icu_concepts)",
    # One row per stay says whether any of its visits has evidence; both averages are taken over those rows.
    "stay_rows": "select person_id, stay_start_date, stay_end_date, los, bool_or(e.visit_occurrence_id is not null) as icu "
    "from stays left join icu_visits e using (visit_occurrence_id) group by all",
    "los_stats": "select person_id, avg(los) as avg_los, coalesce(avg(los) filter (where icu), 0) as avg_icu_los "
    "from stay_rows group by person_id",
    # An outpatient person has, for each word, a visit without it.
    "index_flags": "select i.person_id, if(bool_or(s.named_ed), 1, 0) as is_index_ed, if(bool_or(s.named_ip), 1, 0) as is_index_ip, "
    "if(bool_or(s.named_tele), 1, 0) as is_index_tele, if(bool_or(not s.named_ed) and bool_or(not s.named_ip) "
    "and bool_or(not s.named_tele), 1, 0) as is_index_op from index_range i left join stays s on s.person_id = i.person_id group by 1",
}

VISIT_TESTS = {
    "before": "coalesce(s.visit_end_date, s.visit_start_date) < i.index_start_date",
    "during": "s.visit_start_date >= i.index_start_date "
    "and coalesce(s.visit_end_date, s.visit_start_date) <= i.index_end_date",
    "after": "s.visit_start_date > i.index_end_date",
}
for _period, _test in VISIT_TESTS.items():
    CTES[f"counts_{_period}"] = (
        "select s.person_id, "
        + ", ".join(
            f"cast(sum(is_{t}) as bigint) as {_period}_{t}_cnt" for t in ("ed", "ip", "op", "tele")
        )
        + f" from stays s join index_range i on i.person_id = s.person_id where {_test} group by 1"
    )
CTES["utilization_raw"] = (
    "select f.*, l.avg_los, l.avg_icu_los, "
    + ", ".join(f"{c.split('_')[0]}.{c}" for c in R.VISIT_COUNT_COLUMNS)
    + " from index_flags f left join los_stats l on l.person_id = f.person_id "
    + " ".join(f"left join counts_{p} {p} on {p}.person_id = f.person_id" for p in R.PERIODS)
)
CTES["utilization"] = (
    "select person_id, "
    + ", ".join(R.INDEX_FLAG_COLUMNS)
    + ", "
    + ", ".join(f"coalesce({c}, -1) as {c}" for c in R.LOS_COLUMNS)
    + ", "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in R.VISIT_COUNT_COLUMNS)
    + " from utilization_raw"
)


def names_column(column: str, labels: dict[int, str]) -> str:
    whens = " ".join(f"when {k} then {text(v)}" for k, v in labels.items())
    return f"case {column} {whens} else '' end"


CTES["code_labels"] = (
    "select person_id, year_of_birth, "
    f"{names_column('gender_concept_id', codes.GENDERS)} as gender_concept_name, "
    f"{names_column('race_concept_id', codes.RACES)} as race_concept_name, "
    f"{names_column('ethnicity_concept_id', codes.ETHNICITIES)} as ethnicity_concept_name from person"
)
RACE_COLUMNS = ("Asian", "Black or African American", "Native Hawaiian or Other Pacific Islander", "White")


def one_hot(column: str, names) -> str:
    return ", ".join(
        f"count(case when {column} = {text(n)} then 1 end) as {n.replace(' ', '_')}" for n in names
    )


CTES["demographics"] = (
    "select person_id, "
    + one_hot("race_concept_name", RACE_COLUMNS)
    + ", "
    + one_hot("ethnicity_concept_name", codes.ETHNICITIES.values())
    + ", "
    + one_hot("gender_concept_name", codes.GENDERS.values())
    + ", 2022 - year_of_birth as age from code_labels group by person_id, year_of_birth"
)
CTES["dx_counts"] = (
    "select person_id, "
    + ", ".join(
        f"count(case when feature = {text(f)} then 1 end) as {f}" for f in DEMO.diagnoses.names
    )
    + " from dx_events group by 1"
)


def grid(source: str, value: str, cells: dict[str, tuple[str, str]], fold: str = "max") -> str:
    columns = ", ".join(
        f"{fold}(case when feature = {text(f)} and period = {text(p)} then {value} end) as {name}"
        for name, (f, p) in cells.items()
    )
    return f"select person_id, {columns} from {source} group by 1"


MED_CELLS = {
    f"{f}_{p}": (f, p) for f, periods in DEMO.medications.periods.items() for p in periods
}
VITAL_CELLS = {f"{f}_{p}": (f, p) for f in R.VITALS for p in R.PERIODS}
PROC_CELLS = {f"{p}_{f}": (f, p) for p in R.PERIODS for f in R.PROCEDURES}
LAB_CELLS = {f"{p}_{f}_value": (f, p) for p in R.PERIODS for f in R.LAB_FEATURES}


def filled(columns, fill: int) -> str:
    return ", ".join(f"coalesce({c}, {fill}) as {c}" for c in columns)


def rounded(columns) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


CTES["med_sparse"] = grid("med_counts", "med_count", MED_CELLS)
CTES["med_wide"] = f"select person_id, {filled(MED_CELLS, 0)} from med_sparse"
CTES["vital_stats"] = (
    "select person_id, feature, period, avg(value_as_number) as vital_avg, "
    "stddev_samp(value_as_number) as vital_stddev, count(value_as_number) as vital_count "
    "from vital_events group by 1, 2, 3"
)
CTES["vitals_wide"] = grid(
    "(select * from vital_stats where period is not null)", "vital_avg", VITAL_CELLS
)
CTES["proc_long"] = (
    "select person_id, period, feature, count(*) as n from proc_events "
    "where period is not null group by 1, 2, 3"
)
CTES["proc_sparse"] = grid("proc_long", "n", PROC_CELLS)
CTES["proc_wide"] = f"select person_id, {filled(PROC_CELLS, 0)} from proc_sparse"
CTES["lab_wide"] = grid("lab_means", "value", LAB_CELLS)


def panel(name: str, features) -> str:
    columns = ", ".join(
        f"max(case when feature = {text(f)} then value end) as {f}_value, "
        f"max(case when feature = {text(f)} then unit end) as {f}_unit"
        for f in features
    )
    return (
        f"select person_id, event_date, {columns} from lab_pick "
        f"where panel = {text(name)} group by 1, 2"
    )


CTES["htwt_days"] = panel("htwt", R.HTWT_FEATURES)
CTES["cbc_days"] = panel("cbc", R.CBC_FEATURES)
CTES["cmp_days"] = panel("cmp", R.CMP_FEATURES)
CTES["features"] = (
    "select d.*, 0 as Asian_Indian, x.* exclude (person_id), m.* exclude (person_id), "
    "v.* exclude (person_id), p.* exclude (person_id), l.* exclude (person_id), "
    "u.* exclude (person_id), s.smoker, i.pasc_code_after_four_weeks from demographics d "
    + " ".join(
        f"left join {t} {a} on {a}.person_id = d.person_id"
        for a, t in (
            ("x", "dx_counts"),
            ("m", "med_wide"),
            ("v", "vitals_wide"),
            ("p", "proc_wide"),
            ("l", "lab_wide"),
            ("u", "utilization"),
            ("s", "smokers"),
            ("i", "index_range"),
        )
    )
)


def imputed(column: str) -> str:
    fill = 0 if column in R.ZERO_FILLED else -1 if column in R.MINUS_ONE_FILLED else None
    value = column if fill is None else f"coalesce({column}, {fill})"
    if column in R.DOUBLE_COLUMNS:
        return f"round(cast({value} as double), 6) as {column}"
    return f"cast({value} as bigint) as {column}"


CTES["feature_table"] = (
    "select person_id, "
    + ", ".join(imputed(c) for c in R.FEATURE_COLUMNS)
    + f", {R.LABEL} from features"
)

# Ranking metrics: running totals over the distinct scores.
CTES["score_steps"] = (
    "select predict_prob, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, "
    "sum(pos) over () as positives, sum(neg) over () as negatives, "
    "lead(pos) over (order by predict_prob desc) as next_pos, "
    "lead(neg) over (order by predict_prob desc) as next_neg "
    "from (select predict_prob, sum(true_label) as pos, sum(1 - true_label) as neg from scores "
    "where true_label is not null group by 1) window w as (order by predict_prob desc)"
)
CTES["group_steps"] = (
    "select subgroup, predict_prob, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, "
    "sum(pos) over (partition by subgroup) as positives, "
    "sum(neg) over (partition by subgroup) as negatives "
    "from (select subgroup, predict_prob, sum(true_label) as pos, sum(1 - true_label) as neg "
    "from scores where true_label is not null group by 1, 2) "
    "window w as (partition by subgroup order by predict_prob desc)"
)
CTES["confusion"] = (
    "select cast(sum(case when true_label = 1 and predict_prob > 0.5 then 1 else 0 end) as bigint) as tp, "
    "cast(sum(case when true_label = 0 and predict_prob > 0.5 then 1 else 0 end) as bigint) as fp, "
    "cast(sum(case when true_label = 1 and predict_prob <= 0.5 then 1 else 0 end) as bigint) as fn, "
    "cast(sum(case when true_label = 0 and predict_prob <= 0.5 then 1 else 0 end) as bigint) as tn from scores"
)
AUROC = (
    "sum(neg * (tp - pos / 2.0::double))::double "
    "/ nullif(max(positives)::double * max(negatives)::double, 0)"
)
AP = "case when max(positives) = 0 then 0 else sum(pos * (tp / (tp + fp)::double)) / max(positives) end"


def statement(body: str) -> str:
    """Prefix ``body`` with the expressions it names, directly or through others."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", sql))):
            if word in CTES and word not in needed and CTES[word] is not sql:
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in needed) + "\n" + body


def sql_bin(operator: str) -> str:
    return " + ".join(
        f"(case when predict_prob {operator} {double(e)} then 1 else 0 end)" for e in bin_edges()
    )
