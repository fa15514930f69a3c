"""Code sets, name dictionaries, unit rules and the feature contract.

Everything here is configuration. The plans take a ``Registry`` and never
mention a code set directly, so the same plan runs on production code lists and
on the demo lists of ``sources.star_views``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

PERIODS = ("before", "during", "after")
BEFORE_AFTER = ("before", "after")
DURING = ("during",)


@dataclass(frozen=True)
class CodeGroup:
    """Code sets of one feature family.

    ``features`` maps a code set to its feature. ``set_names`` maps the name of a
    concept set to a feature and, where it has an entry, wins over ``features``.
    """

    features: dict[int, str | None]
    set_names: dict[str, str] = field(default_factory=dict)
    periods: dict[str, tuple[str, ...]] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)

    @property
    def codesets(self) -> list[int]:
        return list(self.features)

    @property
    def names(self) -> list[str]:
        """Every feature the group can produce, in a fixed order."""
        listed = [f for f in self.features.values() if f is not None]
        return list(dict.fromkeys(listed + list(self.set_names.values())))


@dataclass(frozen=True)
class Registry:
    medications: CodeGroup
    vitals: CodeGroup
    diagnoses: CodeGroup
    procedures: CodeGroup
    smoking: CodeGroup
    icu: CodeGroup
    labs: CodeGroup

    def codesets(self) -> list[int]:
        groups = (
            self.medications,
            self.vitals,
            self.diagnoses,
            self.procedures,
            self.smoking,
            self.icu,
            self.labs,
        )
        return sorted({c for g in groups for c in g.codesets})


# Medication features and the periods in which each one counts.
MEDICATION_PERIODS = {
    "anticoagulants": BEFORE_AFTER,
    "asthma_drugs": BEFORE_AFTER,
    "corticosteroids": DURING,
    "antivirals": DURING,
    "lopinavir": DURING,
    "antibiotics": DURING,
    "thymosin": DURING,
    "umifenovir": DURING,
    "iv_immunoglobulin": DURING,
    "remdesivir": DURING,
    "paxlovid": DURING,
}

# Preferred unit of a vital sign; carried as a label, not filtered on.
VITAL_UNITS = {
    "spo2": "percent",
    "bp_systolic": "millimeter mercury column",
    "bp_diastolic": "millimeter mercury column",
}
VITALS = ("spo2", "bp_systolic", "bp_diastolic", "heart_rate", "resp_rate")

DIAGNOSES = (
    "hypertension",
    "heart_failure",
    "diabetes_complicated",
    "diabetes_uncomplicated",
    "obesity",
    "tobacco_smoker",
    "asthma",
    "copd",
)

PROCEDURES = (
    "Ventilator_used",
    "Lungs_CT_scan",
    "Chest_X_ray",
    "Lung_Ultrasound",
    "ECMO_performed",
    "ECG_performed",
    "Echocardiogram_performed",
    "Blood_transfusion",
)

LAB_PANELS = ("htwt", "cbc", "cmp", "immuno")

# Production code sets.
PRODUCTION = Registry(
    medications=CodeGroup(
        features={
            761556952: "anticoagulants",
            56408680: "asthma_drugs",
            804872085: "corticosteroids",
            245992624: "antivirals",
            869338732: "lopinavir",
            54810628: "antibiotics",
            358954641: "thymosin",
            33014037: "umifenovir",
            241604784: "iv_immunoglobulin",
            719693192: "remdesivir",
            339287218: "paxlovid",
        },
        periods=MEDICATION_PERIODS,
    ),
    vitals=CodeGroup(
        features={
            298033057: "spo2",
            963705854: "bp_systolic",
            573275931: "bp_diastolic",
            844379916: "heart_rate",
            510707388: "resp_rate",
        },
        units=VITAL_UNITS,
    ),
    diagnoses=CodeGroup(
        features={
            834391873: "hypertension",
            882775108: "heart_failure",
            18918743: "diabetes_complicated",
            248468138: "diabetes_uncomplicated",
            581513221: "obesity",
            628969102: "tobacco_smoker",
            602584947: "asthma",
            33199070: "copd",
        },
        set_names={
            "HYPERTENSION": "hypertension",
            "HEART FAILURE": "heart_failure",
            "DIABETES COMPLICATED": "diabetes_complicated",
            "DIABETES UNCOMPLICATED": "diabetes_uncomplicated",
            "OBESITY": "obesity",
            "TOBACCO SMOKER": "tobacco_smoker",
            "[VSAC] Asthma ": "asthma",
        },
    ),
    # Procedure features follow the name of the concept set, not its id.
    procedures=CodeGroup(
        features={
            469361388: None,
            629960249: None,
            260036299: None,
            838273021: None,
            415149730: None,
            850548108: None,
            129959605: None,
            429864170: None,
        },
        set_names={
            "[ICU/MODS]IMV": "Ventilator_used",
            "Computed Tomography (CT) Scan": "Lungs_CT_scan",
            "Chest x-ray": "Chest_X_ray",
            "Lung Ultrasound": "Lung_Ultrasound",
            "Kostka - ECMO": "ECMO_performed",
            "ECG_procedure": "ECG_performed",
            "echocardiogram_performed": "Echocardiogram_performed",
            "Blood transfusion": "Blood_transfusion",
        },
    ),
    smoking=CodeGroup(features={628969102: "smoker"}),
    icu=CodeGroup(features={469361388: "icu"}),
    labs=CodeGroup(
        features={
            854721978: "htwt",
            186671483: "htwt",
            985622897: "cbc",
            212998332: "cmp",
            104464584: "cmp",
            459475527: "immuno",
        }
    ),
)

# Concept name of a measurement -> feature, per panel. Three
# entries differ on purpose from the commonly circulated list, which swaps the
# two band-neutrophil rows, files two IgM tests under IgA, and files a measured
# dry weight under height; ``lab_names(as_written=True)`` restores those.
WEIGHT_NAMES = {
    "Body weight": "body_weight",
    "Body weight Stated": "body_weight",
    "Body weight - Reported --usual": "body_weight",
    "Body weight Measured": "body_weight",
    "Body weight Measured --ante partum": "body_weight_msc",
    "Dry body weight Estimated": "body_weight_msc",
    "Body weight Measured --pre pregnancy": "body_weight_msc",
    "Dry body weight Measured": "dry_body_weight",
    "Body weight Measured --when specimen taken": "body_weight_msc",
    "Body weight --used for drug calculation": "body_weight_msc",
}
HEIGHT_NAMES = {
    "Body height Measured": "body_height",
    "Body height Stated": "body_height",
    "Body height measure": "body_height",
    "Body height": "body_height",
    "Body height --standing": "body_height",
}
CBC_NAMES = {
    "Hemoglobin [Mass/volume] in Blood": "hgb",
    "Erythrocytes [#/volume] in Blood by Automated count": "rbc_count",
    "Leukocytes [#/volume] in Blood by Automated count": "wbc_count",
    "Platelets [#/volume] in Blood by Automated count": "platelet_count",
    "Hematocrit [Volume Fraction] of Blood by Automated count": "hct",
    "MCHC [Mass/volume] by Automated count": "mchc",
    "MCH [Entitic mass] by Automated count": "mch",
    "MCV [Entitic volume] by Automated count": "mcv",
    "Platelet mean volume [Entitic volume] in Blood by Automated count": "mpv",
    "Erythrocyte distribution width [Entitic volume] by Automated count": "rdw_volume",
    "Erythrocyte distribution width [Ratio] by Automated count": "rdw_ratio",
    "Platelet distribution width [Entitic volume] in Blood by Automated count": "pdw_volume",
    "Neutrophils [#/volume] in Blood by Automated count": "absolute_neutrophils",
    "Neutrophils/100 leukocytes in Blood by Automated count": "percent_neutrophils",
    "Lymphocytes [#/volume] in Blood by Automated count": "absolute_lymph",
    "Lymphocytes/100 leukocytes in Blood by Automated count": "percent_lymph",
    "Eosinophils [#/volume] in Blood by Automated count": "absolute_eosinophils",
    "Eosinophils/100 leukocytes in Blood by Automated count": "percent_eosinophils",
    "Basophils [#/volume] in Blood by Automated count": "absolute_basophils",
    "Basophils/100 leukocytes in Blood by Automated count": "percent_basophils",
    "Monocytes [#/volume] in Blood by Automated count": "absolute_monocytes",
    "Monocytes/100 leukocytes in Blood by Automated count": "percent_monocytes",
    "Granulocytes/100 leukocytes in Blood by Automated count": "percent_granulocytes",
    "Other cells [#/volume] in Blood by Automated count": "absolute_other",
    "Other cells/100 leukocytes in Blood by Automated count": "percent_other",
    "Variant lymphocytes [#/volume] in Blood by Automated count": "absolute_var_lymph",
    "Variant lymphocytes/100 leukocytes in Blood by Automated count": "percent_var_lymph",
    "Band form neutrophils/100 leukocytes in Blood by Automated count": "percent_band_neutrophils",
    "Band form neutrophils [#/volume] in Blood by Automated count": "absolute_band_neutrophils",
    "CBC panel - Blood by Automated count": "cbc_panel",
}
CMP_NAMES = {
    "Calcium [Mass/volume] in Serum or Plasma": "calcium",
    "Potassium [Moles/volume] in Serum or Plasma": "potassium",
    "Bicarbonate [Moles/volume] in Serum or Plasma": "bicarbonate",
    "Chloride [Moles/volume] in Serum or Plasma": "chloride",
    "Sodium [Moles/volume] in Serum or Plasma": "sodium",
    "Carbon dioxide, total [Moles/volume] in Serum or Plasma": "carbon_dioxide_total",
    "Protein [Mass/volume] in Serum or Plasma": "protein",
    "Glucose [Mass/volume] in Serum or Plasma": "glucose",
    "Creatinine [Mass/volume] in Serum or Plasma": "creatinine",
    "Bilirubin.total [Mass/volume] in Serum or Plasma": "bilirubin_total",
    "Globulin [Mass/volume] in Serum by calculation": "globulin",
    "Albumin/Globulin [Mass Ratio] in Serum or Plasma": "albumin_globulin_ratio",
    "Albumin [Mass/volume] in Serum or Plasma by Bromocresol green (BCG) dye binding method": "albumin_bcg",
    "Albumin [Mass/volume] in Serum or Plasma": "albumin",
    "Albumin [Mass/volume] in Serum or Plasma by Electrophoresis": "albumin_electrophoresis",
    "Albumin [Mass/volume] in Serum or Plasma by Bromocresol purple (BCP) dye binding method": "albumin_bcp",
    "Alkaline phosphatase [Enzymatic activity/volume] in Serum or Plasma": "alkaline_phosphatase",
    "Alanine aminotransferase [Enzymatic activity/volume] in Serum or Plasma": "alanine_aminotransferase",
    "Aspartate aminotransferase [Enzymatic activity/volume] in Serum or Plasma": "aspartate_aminotransferase",
    "Anion gap in Serum or Plasma": "anion_gap",
    "Urea nitrogen [Mass/volume] in Serum or Plasma": "bun",
    "Urea nitrogen/Creatinine [Mass Ratio] in Serum or Plasma": "bun_creatinine_ratio",
    "Glomerular filtration rate/1.73 sq M.predicted among blacks [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (MDRD)": "glomerular_filt_blacks_MDRD",
    "Glomerular filtration rate/1.73 sq M.predicted among non-blacks [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (MDRD)": "glomerular_filt_nonblacks_MDRD",
    "Glomerular filtration rate/1.73 sq M.predicted among females [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (MDRD)": "glomerular_filt_females_MDRD",
    "Glomerular filtration rate/1.73 sq M.predicted among blacks [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (CKD-EPI)": "glomerular_filt_blacks_CKD",
    "Glomerular filtration rate/1.73 sq M.predicted among non-blacks [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (CKD-EPI)": "glomerular_filt_nonblacks_CKD",
    "Glomerular filtration rate/1.73 sq M.predicted [Volume Rate/Area] in Serum, Plasma or Blood by Creatinine-based formula (CKD-EPI)": "glomerular_filt_CKD",
}
IMMUNO_NAMES = {
    "SARS-CoV-2 (COVID-19) Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_Ab_presence",
    "SARS-CoV-2 (COVID-19) Ab panel - Serum or Plasma by Immunoassay": "cov2_Ab_panel",
    "SARS-CoV-2 (COVID-19) Ab [Units/volume] in Serum or Plasma by Immunoassay": "cov2_Ab_amt",
    "SARS-CoV-2 (COVID-19) Ag [Presence] in Respiratory specimen by Rapid immunoassay": "cov2_Ag_presence_rapid",
    "SARS-CoV-2 (COVID-19) Ag [Presence] in Upper respiratory specimen by Immunoassay": "cov2_Ag_presence",
    "SARS-CoV-2 (COVID-19) Ag [Presence] in Upper respiratory specimen by Rapid immunoassay": "cov2_Ag_presence_rapid",
    "SARS-CoV+SARS-CoV-2 (COVID-19) Ag [Presence] in Respiratory specimen by Rapid immunoassay": "cov2_Ag_presence",
    "SARS-CoV-2 (COVID-19) IgG Ab [Presence] in Serum, Plasma or Blood by Rapid immunoassay": "cov2_IgG_Ab_presence_rapid",
    "SARS-CoV-2 (COVID-19) IgG Ab [Presence] in DBS by Immunoassay": "cov2_IgG_Ab_presence_DBS",
    "SARS-CoV-2 (COVID-19) IgG Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_IgG_Ab_presence",
    "SARS-CoV-2 (COVID-19) IgG Ab [Units/volume] in Serum or Plasma by Immunoassay": "cov2_IgG_Ab_amt",
    "SARS-CoV-2 (COVID-19) IgA Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_IgA_Ab_presence",
    "Influenza virus A and B and SARS-CoV+SARS-CoV-2 (COVID-19) Ag panel - Upper respiratory specimen by Rapid immunoassay": "influ_cov2_Ag_panel",
    "Influenza virus A Ag [Presence] in Upper respiratory specimen by Rapid immunoassay": "influA_Ag_presence",
    "Influenza virus B Ag [Presence] in Upper respiratory specimen by Rapid immunoassay": "influB_Ag_presence",
    "SARS-CoV-2 (COVID-19) IgM Ab [Units/volume] in Serum or Plasma by Immunoassay": "cov2_IgM_Ab_amt",
    "SARS-CoV-2 (COVID-19) IgM Ab [Presence] in Serum, Plasma or Blood by Rapid immunoassay": "cov2_IgM_Ab_presence_rapid",
    "SARS-CoV-2 (COVID-19) IgM Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_IgM_Ab_presence",
    "SARS-CoV-2 (COVID-19) IgG+IgM Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_IgG_IgM_Ab_presence",
}

# The entries of the circulated list that the tables above correct.
AS_WRITTEN_NAMES = {
    "Dry body weight Measured": "dry_body_height",
    "Band form neutrophils/100 leukocytes in Blood by Automated count": "absolute_band_neutrophils",
    "Band form neutrophils [#/volume] in Blood by Automated count": "percent_band_neutrophils",
    "SARS-CoV-2 (COVID-19) IgM Ab [Presence] in Serum, Plasma or Blood by Rapid immunoassay": "cov2_IgA_Ab_presence_rapid",
    "SARS-CoV-2 (COVID-19) IgM Ab [Presence] in Serum or Plasma by Immunoassay": "cov2_IgA_Ab_presence",
}


def lab_names(as_written: bool = False) -> list[tuple[str, str, str]]:
    """Rows ``(panel, concept name, feature)`` of the lab dictionary."""
    panels = {
        "htwt": WEIGHT_NAMES | HEIGHT_NAMES,
        "cbc": CBC_NAMES,
        "cmp": CMP_NAMES,
        "immuno": IMMUNO_NAMES,
    }
    patch = AS_WRITTEN_NAMES if as_written else {}
    return [
        (panel, name, patch.get(name, feature))
        for panel, names in panels.items()
        for name, feature in names.items()
    ]


NO_MATCH = "No matching concept"

# Fixed values: (features, target unit, units read as the target). ``None`` is a
# missing unit. Any other unit makes the value of these features null.
STRICT_UNITS = (
    (("hgb",), "gram per deciliter", (None, NO_MATCH)),
    (("mchc",), "gram per deciliter", (None, NO_MATCH, "percent")),
    (("mcv", "mpv", "rdw_volume"), "femtoliter", (None, NO_MATCH)),
    (("rbc_count",), "million per microliter", (None, NO_MATCH, "trillion per liter")),
    (("mch",), "picogram", (None, NO_MATCH)),
    (
        (
            "absolute_basophils",
            "absolute_neutrophils",
            "absolute_eosinophils",
            "absolute_monocytes",
            "absolute_lymph",
            "platelet_count",
            "wbc_count",
        ),
        "thousand per microliter",
        (None, NO_MATCH, "billion per liter"),
    ),
    (
        (
            "rdw_ratio",
            "hct",
            "percent_neutrophils",
            "percent_lymph",
            "percent_basophils",
            "percent_eosinophils",
            "percent_monocytes",
        ),
        "percent",
        (None, NO_MATCH),
    ),
    (
        ("sodium", "chloride", "potassium", "carbon_dioxide_total"),
        "millimole per liter",
        (None, NO_MATCH),
    ),
    (
        ("bun", "calcium", "creatinine", "glucose", "bilirubin_total"),
        "milligram per deciliter",
        (None, NO_MATCH),
    ),
    (
        ("aspartate_aminotransferase", "alanine_aminotransferase"),
        "unit per liter",
        (None, NO_MATCH, "international unit per liter"),
    ),
    (("alkaline_phosphatase",), "unit per liter", (None, "international unit per liter")),
    (("protein", "albumin"), "gram per deciliter", (None, NO_MATCH)),
)

# Fixed values: (feature, unit, factor, resulting unit); a null factor rejects
# the value. Units not listed for these two features are left alone.
SIZE_UNITS = (
    ("body_height", "inch (US)", 2.54, "centimeter"),
    ("body_height", "inch (international)", 2.54, "centimeter"),
    ("body_height", "Inches", 2.54, "centimeter"),
    ("body_height", "meter", 100.0, "centimeter"),
    ("body_height", None, None, None),
    ("body_height", NO_MATCH, None, None),
    ("body_height", "percent", None, None),
    ("body_height", "milliliter", None, None),
    ("body_weight", "kilogram", 2.20462, "pound (US)"),
    ("body_weight", "ounce (avoirdupois)", 0.0625, "pound (US)"),
    ("body_weight", "gram", 0.00220462, "pound (US)"),
    ("body_weight", None, None, None),
    ("body_weight", NO_MATCH, None, None),
    ("body_weight", "fluid ounce (US)", None, None),
    ("body_weight", "oz", None, None),
    ("body_weight", "percent", None, None),
    ("body_weight", "meter", None, None),
    ("body_weight", "milliliter", None, None),
)

STRICT_FEATURES = [f for features, _, _ in STRICT_UNITS for f in features]


def unit_rules() -> list[tuple[str, str | None, float | None, str | None]]:
    """Rows ``(feature, unit, factor, resulting unit)``, one per known pair."""
    strict = [
        (feature, unit, 1.0, target)
        for features, target, synonyms in STRICT_UNITS
        for feature in features
        for unit in (target, *synonyms)
    ]
    return strict + list(SIZE_UNITS)


# The feature contract, in column order.
DEMOGRAPHIC_COLUMNS = [
    "age",
    "FEMALE",
    "MALE",
    "Asian",
    "Asian_Indian",
    "Black_or_African_American",
    "Native_Hawaiian_or_Other_Pacific_Islander",
    "White",
]
CMP_FEATURES = [
    "alanine_aminotransferase",
    "albumin",
    "albumin_bcg",
    "albumin_bcp",
    "albumin_electrophoresis",
    "albumin_globulin_ratio",
    "alkaline_phosphatase",
    "anion_gap",
    "aspartate_aminotransferase",
    "bicarbonate",
    "bilirubin_total",
    "bun",
    "bun_creatinine_ratio",
    "calcium",
    "carbon_dioxide_total",
    "chloride",
    "creatinine",
    "globulin",
    "glomerular_filt_CKD",
    "glomerular_filt_blacks_CKD",
    "glomerular_filt_blacks_MDRD",
    "glomerular_filt_females_MDRD",
    "glomerular_filt_nonblacks_CKD",
    "glomerular_filt_nonblacks_MDRD",
    "glucose",
    "potassium",
    "protein",
    "sodium",
]
CBC_FEATURES = [
    "absolute_band_neutrophils",
    "absolute_basophils",
    "absolute_eosinophils",
    "absolute_lymph",
    "absolute_monocytes",
    "absolute_neutrophils",
    "absolute_other",
    "absolute_var_lymph",
    "cbc_panel",
    "hct",
    "hgb",
    "mch",
    "mchc",
    "mcv",
    "mpv",
    "pdw_volume",
    "percent_band_neutrophils",
    "percent_basophils",
    "percent_eosinophils",
    "percent_granulocytes",
    "percent_lymph",
    "percent_monocytes",
    "percent_neutrophils",
    "percent_other",
    "percent_var_lymph",
    "platelet_count",
    "rbc_count",
    "rdw_ratio",
    "rdw_volume",
    "wbc_count",
]
HTWT_FEATURES = ["body_height", "body_weight"]
LAB_FEATURES = HTWT_FEATURES + CMP_FEATURES + CBC_FEATURES
IMMUNO_FEATURES = sorted(set(IMMUNO_NAMES.values()))

VITAL_COLUMNS = [
    f"{vital}_{period}"
    for period in PERIODS
    for vital in ("bp_diastolic", "bp_systolic", "heart_rate", "resp_rate", "spo2")
]
LAB_COLUMNS = [f"{period}_{lab}_value" for period in PERIODS for lab in LAB_FEATURES]
SMOKING_COLUMNS = ["smoker"]
DIAGNOSIS_COLUMNS = [
    "asthma",
    "copd",
    "diabetes_complicated",
    "diabetes_uncomplicated",
    "heart_failure",
    "hypertension",
    "obesity",
]
MEDICATION_COLUMNS = [
    "anticoagulants_before",
    "asthma_drugs_before",
    "antibiotics_during",
    "antivirals_during",
    "corticosteroids_during",
    "iv_immunoglobulin_during",
    "lopinavir_during",
    "paxlovid_during",
    "remdesivir_during",
    "anticoagulants_after",
    "asthma_drugs_after",
]
INDEX_FLAG_COLUMNS = ["is_index_ed", "is_index_ip", "is_index_tele", "is_index_op"]
LOS_COLUMNS = ["avg_los", "avg_icu_los"]
VISIT_COUNT_COLUMNS = [f"{p}_{k}_cnt" for p in PERIODS for k in ("ed", "ip", "op")]
UTILIZATION_COLUMNS = INDEX_FLAG_COLUMNS + LOS_COLUMNS + VISIT_COUNT_COLUMNS
PROCEDURE_COLUMNS = [
    f"{period}_{procedure}" for period in ("after", "before", "during") for procedure in PROCEDURES
]

LABEL = "pasc_code_after_four_weeks"
FEATURE_COLUMNS = (
    DEMOGRAPHIC_COLUMNS
    + VITAL_COLUMNS
    + LAB_COLUMNS
    + SMOKING_COLUMNS
    + DIAGNOSIS_COLUMNS
    + MEDICATION_COLUMNS
    + UTILIZATION_COLUMNS
    + PROCEDURE_COLUMNS
)
ZERO_FILLED = DIAGNOSIS_COLUMNS + PROCEDURE_COLUMNS + MEDICATION_COLUMNS + UTILIZATION_COLUMNS
MINUS_ONE_FILLED = SMOKING_COLUMNS + VITAL_COLUMNS + LAB_COLUMNS
DOUBLE_COLUMNS = set(VITAL_COLUMNS + LAB_COLUMNS + LOS_COLUMNS)
