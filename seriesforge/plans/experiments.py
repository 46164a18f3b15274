"""Experiment drivers: archive of small datasets (ridge) and growth with rows (softmax).

    spark-submit -m seriesforge.plans.experiments archive -d names.txt -i DIR -o OUT [-n RUNS] [-k KERNELS]
    spark-submit -m seriesforge.plans.experiments scaling -tr TRAIN.csv -te TEST.csv -o OUT -k KERNELS
"""

from __future__ import annotations

import argparse
import logging
import time
import zlib

from pyspark.sql import DataFrame, SparkSession

from seriesforge.functions.kernels import make_kernels
from seriesforge.operators.evaluate import accuracy, predict
from seriesforge.operators.normalise import znormalise
from seriesforge.operators.ridge import fit_ridge
from seriesforge.operators.softmax import SoftmaxTrainer
from seriesforge.sources.results import ARCHIVE_SCHEMA, RUNS_SCHEMA, SCALING_SCHEMA, results_frame, summarise_runs, write_results
from seriesforge.sources.series import assert_series, dataset_paths, read_dataset_list, read_series_csv, read_series_text


log = logging.getLogger(__name__)


def timed(action) -> tuple[float, object]:
    at = time.perf_counter()
    out = action()
    return time.perf_counter() - at, out


def materialise(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def cell_seed(base: int, *key) -> int:
    """Seed of one experiment cell, stable across processes."""
    return zlib.crc32(repr((base, *key)).encode())


def run_archive(spark: SparkSession, names: list[str], root: str, runs: int = 10, kernels: int = 10_000, seed: int = 0) -> DataFrame:
    """Accuracy and times of every dataset over ``runs`` banks; timers exclude reading and drawing kernels."""
    rows = []
    for name in names:
        train, test = (read_series_text(spark, p).persist() for p in dataset_paths(root, name))
        length = assert_series(train)
        if assert_series(test) != length:
            raise ValueError(f"{name}: train and test series differ in length")
        for run in range(runs):
            bank = make_kernels(length, kernels, cell_seed(seed, name, run))
            # fitting and scoring transform in the same pass, so their times hold the transform
            t_fit, model = timed(lambda: fit_ridge(train, bank))
            t_score, acc = timed(lambda: accuracy(predict(test, bank, model)).first()[0])
            rows.append((name, run, acc, 0.0, 0.0, t_fit, t_score))
            log.info("%-32s run %3d accuracy %.4f", name, run, acc)
        train.unpersist(), test.unpersist()
    return summarise_runs(results_frame(spark, rows, RUNS_SCHEMA)) if rows else results_frame(spark, [], ARCHIVE_SCHEMA)


def run_scaling(
    spark: SparkSession, train_path: str, test_path: str, kernels: int, sizes: list[int] | None = None, num_classes: int = 24, holdout: int = 2048, seed: int = 0
) -> DataFrame:
    """Accuracy and training seconds by number of training rows; validation is the head of the training file."""
    rows = []
    for n in sizes or [2**e for e in range(8, 21)]:
        valid = read_series_csv(spark, train_path, 0, holdout).persist()
        train = read_series_csv(spark, train_path, holdout, n).persist()
        materialise(valid), materialise(train)  # the timer leaves out reading
        bank = make_kernels(assert_series(train), kernels, cell_seed(seed, n))
        seconds, model = timed(lambda: SoftmaxTrainer(num_classes, seed=seed).fit(train, valid, bank))
        test = znormalise(read_series_csv(spark, test_path, 0, holdout))
        rows.append((n, accuracy(predict(test, bank, model)).first()[0], seconds))
        valid.unpersist(), train.unpersist()
        log.info("%8d training series accuracy %.4f in %.1f s", *rows[-1])
    return results_frame(spark, rows, SCALING_SCHEMA)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser()
    sub = top.add_subparsers(dest="what", required=True)
    a = sub.add_parser("archive")
    a.add_argument("-d", "--dataset_names", required=True)
    a.add_argument("-i", "--input_path", required=True)
    a.add_argument("-o", "--output_path", required=True)
    a.add_argument("-n", "--num_runs", type=int, default=10)
    a.add_argument("-k", "--num_kernels", type=int, default=10_000)
    s = sub.add_parser("scaling")
    s.add_argument("-tr", "--training_path", required=True)
    s.add_argument("-te", "--test_path", required=True)
    s.add_argument("-o", "--output_path", required=True)
    s.add_argument("-k", "--num_kernels", type=int, required=True)
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("seriesforge").getOrCreate()
    if args.what == "archive":
        names = read_dataset_list(spark, args.dataset_names)
        out = run_archive(spark, names, args.input_path, args.num_runs, args.num_kernels)
        write_results(out, f"{args.output_path}/results_archive.csv")
    else:
        out = run_scaling(spark, args.training_path, args.test_path, args.num_kernels)
        write_results(out, f"{args.output_path}/results_scaling_k={args.num_kernels}.csv")


if __name__ == "__main__":
    main()
