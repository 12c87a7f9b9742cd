"""Command line: python -m fakturnik process|batch|config|models."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import models
from .config import Config
from .operators import ocr
from .operators.recognition import dictionary
from .pipeline import process
from .sources import sinks


def _engine(spark: SparkSession, folder: str | None, config: Config) -> ocr.Engine | None:
    """The models of a folder by their usual names; none without a detection model."""
    at = lambda name: p if folder and os.path.exists(p := os.path.join(folder, name)) else None
    if at("det.onnx") is None:
        return None
    signs = [r["ch"] for r in dictionary(spark, at("latin_dict.txt")).orderBy("idx").collect()] if at("latin_dict.txt") else ocr.DICTIONARY
    return ocr.Engine(at("det.onnx"), at("latin_rec.onnx"), at("cls.onnx"), at("layout.onnx"), signs=tuple(signs), options=config.ocr)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fakturnik")
    p.add_argument("-c", "--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "batch"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("-f", "--format", choices=("json", "csv", "text"), default="json")
        s.add_argument("-m", "--model-dir")
        s.add_argument("--keep-unk", action="store_true")
        if name == "process":
            s.add_argument("-o", "--output")
            s.add_argument("--text-only", action="store_true")
            s.add_argument("--show-confidence", action="store_true")
            s.add_argument("--validate", action="store_true")
        else:
            s.add_argument("-o", "--output-dir", default="out")
            s.add_argument("--summary", action="store_true")
            s.add_argument("--continue-on-error", action="store_true")
    s = sub.add_parser("config")
    s.add_argument("action", choices=("init", "show", "get", "set"))
    s.add_argument("rest", nargs="*")
    s = sub.add_parser("models")
    s.add_argument("action", choices=("list", "status", "use", "clean"))
    s.add_argument("rest", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    config = Config.load(args.config) if args.config and os.path.exists(args.config) else Config()
    if args.command == "config":
        path = args.config or "fakturnik.json"
        if args.action == "init":
            Config().save(path)
        elif args.action == "show":
            print(config.text())
        elif args.action == "get":
            print(json.dumps(config.get(args.rest[0])))
        else:
            config.set(*args.rest[:2])
            config.save(path)
        return 0
    spark = spark or SparkSession.builder.appName("fakturnik").getOrCreate()
    if args.command == "models":
        folder = config.models.folder
        if args.action == "use":
            models.use(folder, args.rest[0])
        elif args.action == "clean":
            print("\n".join(models.clean(folder, args.rest[0])))
        else:
            models.registry(spark, folder).show(truncate=False)
            print("active:", models.active(folder))
        return 0
    config.ocr.keep_unk = config.ocr.keep_unk or args.keep_unk
    engine = None if getattr(args, "text_only", False) else _engine(spark, args.model_dir, config)
    rows = process(spark, args.input, config, engine)
    if args.command == "batch":
        rows = rows.persist()
        if rows.filter("error IS NOT NULL").limit(1).count() and not args.continue_on_error:
            print(rows.filter("error IS NOT NULL").first()["error"], file=sys.stderr)
            return 1
        sinks.write_each(rows, args.output_dir, args.format)
        if args.summary:
            sinks.summary(rows).coalesce(1).write.mode("overwrite").csv(f"{args.output_dir}/summary", header=True)
        print(json.dumps(sinks.counters(rows).first().asDict()))
        for r in sinks.failures(rows).toLocalIterator():
            print(f"{r['filename']}: {r['error']}", file=sys.stderr)
        rows.unpersist()
        return 0
    inv = F.col("invoice")
    shown = {"json": sinks.json_text(inv), "text": sinks.plain_text(inv), "csv": sinks.csv_line(inv)}[args.format]
    r = rows.select("error", shown.alias("out"), "warnings", "invoice.metadata.confidence").first()  # one file
    if r is None or r["error"]:
        print(r["error"] if r else "no such file", file=sys.stderr)
        return 1
    out = (sinks.CSV_HEAD + "\n" if args.format == "csv" else "") + r["out"]
    if args.output:
        with open(args.output, "w") as f:
            f.write(out + "\n")
    else:
        print(out)
    if args.show_confidence:
        print(f"confidence: {r['confidence']:.2f}", file=sys.stderr)
    if args.validate:
        print("\n".join(r["warnings"]) or "no issues", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
