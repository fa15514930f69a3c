from __future__ import annotations

from types import SimpleNamespace

import pytest
from conftest import day
from pyspark.sql import functions as F

from perindex.plans.jobs import load_inputs
from perindex.session import checkpoint_dir, materialize
from perindex.sources import readers, schemas, star_views, versions, writers


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "cohort.csv"
    path.write_text(
        "extra,time_to_pasc,person_id,covid_index,pasc_code_after_four_weeks\n"
        "x,70.0,76.0,2008-06-12,1\nx,,9007199254740993,2009-01-05 00:00:00,0\nx,,oops,bad,\n"
    )
    df = readers.read_table(spark, str(path), schemas.COHORT, "csv")
    assert df.schema == schemas.COHORT
    rows = sorted(df.collect(), key=lambda r: r.person_id or 0)
    assert rows[0].person_id is None and rows[0].covid_index is None
    assert (rows[1].person_id, rows[1].time_to_pasc) == (76, 70)
    assert rows[2].person_id == 9007199254740993 and rows[2].covid_index == day("2009-01-05")
    assert rows[1].pasc_code_prior_four_weeks is None


def test_a_fraction_never_makes_another_id(spark):
    for kind in ("string", "double", "decimal(10,2)"):
        frame = spark.createDataFrame([("76.0",), ("76.9",), ("7",)], "person_id string")
        frame = frame.selectExpr(f"cast(person_id as {kind}) as person_id")
        rows = readers.conform(frame, schemas.PERSON).collect()
        assert [r.person_id for r in rows] == [76, None, 7]


def test_key_columns_and_paths_must_exist(spark, tmp_path):
    with pytest.raises(ValueError, match="covid_index"):
        readers.conform(spark.range(1).selectExpr("id as person_id"), schemas.COHORT)
    for name in ("person", "drug_exposure", "measurement", "observation", "condition_occurrence",
                 "procedure_occurrence", "visits"):
        (tmp_path / f"{name}.csv").write_text(",".join(schemas.TABLES[name].names) + "\n")
    with pytest.raises(Exception, match="cohort"):
        load_inputs(spark, str(tmp_path), str(tmp_path / "sets.csv"), "csv")


def test_concept_ids_written_as_text(spark, tmp_path):
    path = tmp_path / "sets.csv"
    path.write_text("codeset_id,concept_id,concept_name\n761556952,1,\"a, b\"\nx,2.0,c\n")
    rows = readers.read_table(spark, str(path), schemas.CONCEPT_SET_MEMBERS, "csv").collect()
    assert sorted((r.codeset_id or 0, r.concept_id, r.concept_name) for r in rows) == [
        (0, 2, "c"), (761556952, 1, "a, b"),
    ]


def test_load_inputs(spark, tmp_path):
    for name in ("person", "drug_exposure", "measurement", "observation", "condition_occurrence",
                 "procedure_occurrence", "cohort"):
        header = ",".join(schemas.TABLES[name].names)
        (tmp_path / f"{name}.csv").write_text(header + "\n1" + "," * header.count(",") + "\n")
    (tmp_path / "sets.csv").write_text("codeset_id,concept_id\n1,2\n")
    tables = load_inputs(spark, str(tmp_path), str(tmp_path / "sets.csv"), "csv", may_lack=("visits",))
    assert all(df.schema == schemas.TABLES[name] for name, df in tables.items())
    assert tables["visits"].count() == 0 and tables["cohort"].first().person_id == 1


def test_index_range_falls_back_to_an_empty_frame(spark, table, tmp_path):
    path = str(tmp_path / "index")
    assert readers.read_index_range(spark, path).schema == schemas.INDEX_RANGE
    assert readers.read_index_range(spark, path).count() == 0
    table("index_range", dict(person_id=1)).write.parquet(path)
    assert readers.read_index_range(spark, path).first().person_id == 1


def test_empty_features(spark):
    df = readers.empty_features(spark, ["avg_los", "is_index_ed"])
    assert df.dtypes == [("person_id", "bigint"), ("avg_los", "double"), ("is_index_ed", "bigint")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_writers(spark, tmp_path, fmt):
    df = spark.range(6).selectExpr(
        "id as person_id", "id / 10 as predict_prob", "1 as true_label",
        "if(id < 2, 'test', 'train') as dataset",
    )
    path = str(tmp_path / fmt)
    for _ in range(2):  # the second write replaces the first
        writers.write_predictions(df, path, fmt)
    back = readers.read_predictions(spark, path, fmt)
    assert sorted(back.collect()) == sorted(df.select("person_id", "predict_prob", "dataset").collect())
    features = df.drop("dataset").withColumnRenamed("true_label", "f")
    writers.write_features(features, path + "-full", fmt)
    reader = spark.read.option("header", True).option("inferSchema", True)
    assert reader.format(fmt).load(versions.resolve(spark, path + "-full")).count() == 6


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "table")
    good = spark.range(50).selectExpr("id as person_id", "id / 100 as predict_prob")
    writers.write_predictions(good, path)
    bad = spark.range(50).selectExpr(
        "id as person_id", "if(id = 49, raise_error('broken row'), id / 100) as predict_prob"
    ).repartition(5)
    with pytest.raises(Exception, match="broken row"):
        writers.write_predictions(bad, path)
    assert sorted(readers.read_predictions(spark, path).collect()) == sorted(good.collect())
    # Nothing of the failed version is left, and the next write succeeds.
    folders = [p.name for p in (tmp_path / "table").iterdir() if p.is_dir()]
    assert folders == [versions.current(spark, path)]
    writers.write_predictions(good.where("person_id < 3"), path)
    assert readers.read_predictions(spark, path).count() == 3
    assert len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) == 1


def test_a_plain_folder_becomes_a_versioned_table(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(4).selectExpr("id as person_id", "0.5 as predict_prob").write.parquet(path)
    assert versions.current(spark, path) is None and readers.read_predictions(spark, path).count() == 4
    writers.write_predictions(spark.range(2).selectExpr("id as person_id", "0.1 as predict_prob"), path)
    assert readers.read_predictions(spark, path).count() == 2


def test_ids_in_text_are_never_cut_to_others(spark):
    texts = ["76", "76.0", "76.", " 76.000 ", "76.0000001", "76.5", "x", None, "9223372036854775807.0", "9223372036854775808"]
    df = spark.createDataFrame([(t,) for t in texts], "person_id string")
    back = readers.conform(df, schemas.PREDICTIONS).select("person_id").collect()
    assert [r.person_id for r in back] == [76, 76, 76, 76, None, None, None, None, 9223372036854775807, None]


def test_materialize_writes_to_the_checkpoint_folder(spark):
    df = materialize(spark.range(5).selectExpr("id", "id * 2 as twice"), "numbers")
    assert df.inputFiles()[0].replace("file://", "").startswith(
        checkpoint_dir(spark).replace("file:", "")
    )
    assert sorted(r.twice for r in df.collect()) == [0, 2, 4, 6, 8]
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def session_like(named, master, current=None):
    """What checkpoint_dir reads of a session; a real one cannot change the setting."""
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current)
    conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": named}[key] or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_the_named_checkpoint_folder_wins():
    assert checkpoint_dir(session_like("s3a://shared/cp", "yarn")) == "s3a://shared/cp"
    assert checkpoint_dir(session_like(None, "yarn", "hdfs://set/cp")) == "hdfs://set/cp"
    with pytest.raises(ValueError):
        checkpoint_dir(session_like(None, "yarn"))


def test_a_task_joins_a_bounded_number_of_lines(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    plain = star_views.ClinicalViews(spark, folder).condition_occurrence
    monkeypatch.setattr(star_views, "is_small", lambda df: False)
    monkeypatch.setattr(star_views, "LINES_PER_TASK", 300)
    parted = star_views.ClinicalViews(spark, folder).condition_occurrence
    sizes = parted.groupBy(F.spark_partition_id()).count().select(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 300 and sizes[1] >= 15
    assert sorted(parted.collect()) == sorted(plain.collect())
