"""Ingestion kept between runs, and the audits that it returns."""

import os
import uuid

import pytest

from scholar_spark.plans import store, workflow

HEAD = "Title,Authors,Source title,Year,Cited by,DOI,Abstract,Author Keywords,Document Type,Affiliations,References\n"


def export(path, years, title="Work"):
    path.write_text(HEAD + "".join(f'"{title} {i}",A B.,Journal,{y},{i},10.1/{i},text,k,Article,"University of X, Berlin, Germany",R1; R2\n' for i, y in enumerate(years)))
    return str(path)


def jobs(spark, make):
    """What ``make`` returns, and how many jobs it ran."""
    group = f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return make(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_an_ingestion_is_reused_until_files_or_settings_change(spark, tmp_path):
    path, config, folder = export(tmp_path / "a.csv", [2018, 2019, 2020, 2022]), {"as_of_year": 2022}, str(tmp_path / "store")
    first, some = jobs(spark, lambda: store.stored_ingestion(spark, [[path]], config, folder))
    again, fewer = jobs(spark, lambda: store.stored_ingestion(spark, [[path]], config, folder))
    assert not first.metadata["reused"] and again.metadata["reused"] and fewer <= 1 < some  # the description is read
    assert first.metadata["documents"] == again.data.count() == 3 and again.metadata["counts"]["fused"] == 4
    assert first.data.schema == again.data.schema and sorted(map(str, first.data.collect())) == sorted(map(str, again.data.collect()))
    assert set(first.tables) == set(again.tables) and {"temporal", "fields", "coverage", "prisma_table"} <= set(again.tables)
    export(tmp_path / "a.csv", [2018, 2019, 2020, 2021, 2021], "Other")
    changed = store.stored_ingestion(spark, [[path]], config, folder)
    assert not changed.metadata["reused"] and changed.metadata["documents"] == 5  # not the rows read before


def test_settings_and_unfinished_folders_are_written_anew(spark, tmp_path, monkeypatch):
    rows = spark.range(3).toDF("id")
    monkeypatch.setattr(store, "run_ingestion", lambda exports, config: store.Stage(rows, {"articles": rows}, ["w"], {"cutoff": config["as_of_year"]}))
    path, folder = export(tmp_path / "a.csv", [2018, 2019]), tmp_path / "store"
    run = lambda year: store.stored_ingestion(spark, [[path]], {"as_of_year": year}, str(folder))
    assert [run(y).metadata["reused"] for y in (2022, 2022, 2021)] == [False, True, False]
    for found in folder.glob("ingestion-*"):
        os.remove(found / "description" / "_SUCCESS")
    assert not run(2022).metadata["reused"]
    kept, manifest = run(2022), workflow.Manifest()
    manifest.add("ingestion", "Completed", kept.metadata["documents"], kept.warnings)
    assert kept.metadata["reused"] and kept.warnings == ["w"] and manifest.table(spark).first()["documents"] == 3


def test_a_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        store.stored_ingestion(spark, [[str(tmp_path / "nowhere.csv")]], {"as_of_year": 2022}, str(tmp_path / "store"))


def test_audits_of_an_ingestion(spark, tmp_path):
    path = export(tmp_path / "a.csv", [2018, 2019, 2020, 2022])
    stage = workflow.run_ingestion([store.readers.read_source(spark, [path])], {"as_of_year": 2022})
    temporal = stage.tables["temporal"].first().asDict()
    assert temporal == {"applied": True, "cutoff": 2022, "n_before": 4, "n_after": 3, "first_year": 2018, "last_year": 2020}
    fields = {r["field"]: r for r in stage.tables["fields"].collect()}
    assert fields["Title"]["present"] and fields["Title"]["n_values"] == 4 and fields["Title"]["kept"]
    assert any(not r["present"] and r["n_values"] == 0 for r in fields.values())
    covered = stage.tables["coverage"].first()
    assert covered["source"] == "Scopus" and covered["pct"] == pytest.approx(100 * covered["there"] / covered["recommended"])
