"""Command line: python -m inkgauge recognise | benchmark | analyse | calibrate | route."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from inkgauge.plans import pipelines
from inkgauge.sources import backends, readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkgauge")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    must = {"required": True}
    add("recognise", ("--input", must), ("--output", must), ("--backend", {"default": "mock"}))
    add("benchmark", ("--records", must), ("--dataset", must), ("--config", {}), ("--output_csv", must), ("--output_json", must))
    add("analyse", ("--benchmark_csv", must), ("--output_dir", must), ("--bins", {"type": int, "default": 10}))
    add("calibrate", ("--benchmark_csv", must), ("--method", {"default": "platt"}), ("--output_model", must))
    add("route", ("--benchmark_csv", must), ("--config", {}), ("--output_csv", must))
    return top


def settings(spark: SparkSession, path: str | None, **changes) -> readers.EngineConfig:
    """From a YAML file that Spark can read; a missing one gives the defaults."""
    from dataclasses import replace

    text = ""
    if path:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one settings file
    return replace(readers.engine_config(text), **changes)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"inkgauge {args.command}").getOrCreate()
    if args.command == "recognise":
        images = readers.image_files(spark, args.input).withColumnRenamed("path", "image_path")
        writers.records_json(pipelines.recognise(images, backends.backend(args.backend)), args.output)
        return 0
    if args.command == "benchmark":
        truth = readers.ground_truth(spark, args.dataset)
        if truth.isEmpty():
            print("no samples", file=sys.stderr)
            return 1
        rows, summary = pipelines.benchmark(readers.ocr_results(spark, args.records), truth, settings(spark, args.config))
        writers.benchmark_csv(rows, args.output_csv)
        writers.summary_json(summary, args.output_json, dataset=args.dataset, spark_version=spark.version)
        writers.report(summary)
        return 0
    rows = readers.benchmark_csv(spark, args.benchmark_csv)
    if args.command == "analyse":
        bins, metrics = pipelines.analyse(rows, settings(spark, None, confidence_bins=args.bins))
        writers.table_csv(bins, f"{args.output_dir}/confidence_bins")
        writers.summary_json(metrics, f"{args.output_dir}/calibration_metrics")
        writers.report(bins)
        writers.report(metrics)
    elif args.command == "calibrate":
        model = pipelines.calibrate(rows, args.method)
        writers.calibrator(model, args.output_model)
        writers.report(model)
    else:
        table = pipelines.route(rows, settings(spark, args.config))
        writers.table_csv(table, args.output_csv)
        writers.report(table, ["threshold", "pct_high_confidence", "high_conf_cer", "high_conf_acceptable_rate", "low_conf_cer", "high_incorrect_count", "low_correct_count"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
