import zipfile

import pytest

from kinlink import cli
from kinlink.sources import entities


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = entities.adapted(spark, "/root/testdata/sf0.001").collect()
    for i, s in enumerate(("S1", "S2", "S3"), 1):
        clean = lambda t: " ".join((t or "").replace('"', " ").split())
        lines = ["\t".join((r.entity_id, clean(r.business_name), clean(r.business_address), r.country)) for r in rows if r.source == s]
        (at / f"s{i}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *lines]) + "\n")
    truth = [f"{r.source1_entity_id}\t{r.matched_entity_ids or ''}" for r in entities.adapted_truth(spark, "/root/testdata/sf0.001").collect()]
    (at / "truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *truth]) + "\n")
    return at


def test_train_infer_validate_package(spark, tables, capsys):
    sources = [x for i in (1, 2, 3) for x in (f"--source{i}", str(tables / f"s{i}.tsv"))]
    common = [*sources, "--model-path", str(tables / "model"), "--folds", "2"]
    assert cli.main(["train", *common, "--truth", str(tables / "truth.tsv"), "--trees", "3"]) == 0
    threshold = float(capsys.readouterr().out.split()[-1])
    assert 0.1 <= threshold <= 0.9
    out = tables / "out"
    assert cli.main(["infer", *common, "--out", str(out), "--threshold", str(threshold)]) == 0
    assert {r.fold for r in spark.read.parquet(str(tables / "model/oof_scores")).collect()} == {0, 1}
    assert [r.trees <= 3 for r in spark.read.parquet(str(tables / "model/best_iterations")).collect()] == [True, True]
    check = ["--source1", str(tables / "s1.tsv"), "--matching", str(out / "matching_results.tsv"), "--candidates", str(out / "candidate_pairs.tsv")]
    assert cli.main(["validate", *check, "--pool", str(tables / "s2.tsv"), "--pool", str(tables / "s3.tsv"), "--check-ids"]) == 0
    (tables / "about.md").write_text("what it is")
    assert cli.main(["package", *check, "--code", "kinlink/plans", "--document", str(tables / "about.md"), "--out", str(tables / "s.zip")]) == 0
    packed = zipfile.ZipFile(tables / "s.zip")
    assert {"matching_results.tsv", "candidate_pairs.tsv", "about.md", "code/inference.py"} <= set(packed.namelist())
    for name in ("matching_results.tsv", "candidate_pairs.tsv"):
        lines = packed.read(name).decode().splitlines()
        ids = [x.split("\t")[0] for x in lines[1:]]
        want = [x.split("\t")[0] for x in (tables / "s1.tsv").read_text().splitlines()[1:]]
        assert lines[0].startswith("source1_entity_id\t") and sorted(ids) == sorted(want)
    # What was packed is a file that the checker takes.
    packed.extract("matching_results.tsv", tables / "unpacked")
    assert cli.main(["validate", "--source1", str(tables / "s1.tsv"), "--matching", str(tables / "unpacked/matching_results.tsv")]) == 0


def test_package_needs_its_files(tables, spark):
    from kinlink.sources import sinks

    with pytest.raises(FileNotFoundError):
        sinks.write_archive(str(tables / "none.zip"), [str(tables / "nothing.tsv")], "kinlink/plans")
    empty = tables / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        sinks.write_archive(str(tables / "none.zip"), [str(empty)], "kinlink/plans")
