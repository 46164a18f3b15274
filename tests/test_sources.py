import numpy as np
import pytest

from seriesforge.plans import experiments
from seriesforge.plans.experiments import main, run_archive, run_scaling
from seriesforge.sources.results import union_by_k, write_results
from seriesforge.sources.series import SeriesError, assert_series, read_dataset_list, read_series_csv, read_series_text, repair_series


def waves(n, length, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return y, np.sin(np.arange(length) * (0.2 + 0.3 * y[:, None]) + rng.uniform(0, 6, (n, 1)))


def write(path, y, x, sep):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(sep.join([f"{c:.7e}", *(f"{v:.6f}" for v in r)]) + "\n" for c, r in zip(y, x, strict=True)))


def test_text_and_csv_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  1.0   2.5e0 -3\n\n2  4\t5 \n")
    rows = sorted(map(tuple, read_series_text(spark, str(tmp_path / "a.txt")).collect()))
    assert rows == [(0, 1, [2.5, -3.0]), (1, 2, [4.0, 5.0])]
    (tmp_path / "b.csv").write_text("".join(f"{i},{i}.5,1\n" for i in range(9)))
    got = sorted(map(tuple, read_series_csv(spark, str(tmp_path / "b.csv"), 3, 4).collect()))
    assert got == [(i, i, [i + 0.5, 1.0]) for i in range(3, 7)]
    (tmp_path / "names").write_text("only\n")
    assert read_dataset_list(spark, str(tmp_path / "names")) == ["only"]


def test_bad_series_are_refused_and_repaired(spark):
    schema = "series_id long, x array<double>"
    for bad in ([1.0, None], [1.0, float("nan")], [1.0, float("inf")], None):
        with pytest.raises(SeriesError):
            assert_series(spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], schema))
    with pytest.raises(SeriesError):
        assert_series(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], schema))
    assert assert_series(spark.createDataFrame([], schema)) == 0
    fixed = repair_series(spark.createDataFrame([(1, [1.0, None, float("nan"), 2.0]), (2, [5.0])], schema), 3)
    assert {r.series_id: r.x for r in fixed.collect()} == {1: [1.0, 1.0, 1.0], 2: [5.0, 0.0, 0.0]}


def test_experiment_drivers(spark, tmp_path):
    for split, seed in (("TRAIN", 1), ("TEST", 2)):
        write(tmp_path / "in" / "toy" / f"toy_{split}.txt", *waves(40, 32, seed), "  ")
        write(tmp_path / f"{split}.csv", *waves(300, 32, seed), ",")
    r = run_archive(spark, ["toy"], str(tmp_path / "in"), runs=2, kernels=30).first()
    assert r.accuracy_mean > 0.9 and r.time_training_seconds > 0
    s = run_scaling(spark, str(tmp_path / "TRAIN.csv"), str(tmp_path / "TEST.csv"), 20, sizes=[128], num_classes=2, holdout=100)
    assert s.first().accuracy > 0.7
    write_results(union_by_k({20: s}), str(tmp_path / "out"))
    assert (tmp_path / "out").is_file()  # one file of that name
    assert (tmp_path / "out").read_text().splitlines()[0] == "k,num_training_examples,accuracy,time_training_seconds"


def test_command_lines(spark, tmp_path, monkeypatch):
    for split, seed in (("TRAIN", 1), ("TEST", 2)):
        write(tmp_path / "in" / "toy" / f"toy_{split}.txt", *waves(30, 32, seed), "  ")
        write(tmp_path / f"{split}.csv", *waves(200, 32, seed), ",")
    (tmp_path / "names").write_text("toy\n")
    main(["archive", "-d", str(tmp_path / "names"), "-i", str(tmp_path / "in"), "-o", str(tmp_path), "-n", "1", "-k", "20"])
    rows = (tmp_path / "results_archive.csv").read_text().splitlines()
    assert rows[0].startswith("dataset,accuracy_mean") and rows[1].startswith("toy,") and len(rows) == 2
    monkeypatch.setattr(experiments, "run_scaling", lambda s, a, b, k: run_scaling(s, a, b, k, sizes=[64, 100], num_classes=2, holdout=100))
    main(["scaling", "-tr", str(tmp_path / "TRAIN.csv"), "-te", str(tmp_path / "TEST.csv"), "-o", str(tmp_path), "-k", "10"])
    rows = (tmp_path / "results_scaling_k=10.csv").read_text().splitlines()
    assert [r.split(",")[0] for r in rows] == ["num_training_examples", "64", "100"]
