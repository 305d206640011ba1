"""One run from end to end, and its guards."""

import pytest

from ledgerloom.plans import pipeline
from ledgerloom.sources import files


def test_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    audit = pipeline.run(spark, d, str(tmp_path / "out"), "run-1", "2024-01-01T00:00:00Z")
    assert audit == files.read_json(str(tmp_path / "out" / "audit.json"))
    for facts in audit["tables"].values():
        assert facts["valid"] + facts["invalid"] == facts["raw"] >= facts["known"] > 0
    for name, n in audit["outputs"].items():
        back = files.read_csv(spark, str(tmp_path / "out" / f"{name}.csv"))
        assert back.count() == n and back.columns[0] == "run_id"
    lineages = files.read_csv(spark, str(tmp_path / "out" / "lineages.csv"))
    assert lineages.where("cast(gross_posted as long) - cast(reversed as long) <> cast(net_observed_posted as long) or cast(net_observed_posted as long) < 0").count() == 0
    assert lineages.where("cast(conflict_count as int) > 0").count() > 0


def test_guards(spark):
    assert pipeline.cutoff_of(None) is None and pipeline.cutoff_of("1970-01-01T00:00:01Z") == 1_000_000
    with pytest.raises(ValueError, match="offset"):
        pipeline.cutoff_of("2024-01-01T00:00:00")
    rows = spark.createDataFrame([(1, "payment")], "n_versions int, outcome string")
    assert pipeline.guard_features(rows.drop("outcome")).columns == ["n_versions"]
    with pytest.raises(ValueError, match="outcome"):
        pipeline.guard_features(rows)
