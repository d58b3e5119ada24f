"""Command line: run registered queries, score runs, strip prompts."""

from __future__ import annotations

import argparse
import importlib
import time

from agreemill.config import fraction_or_none, load
from agreemill.functions.text import STRIPPERS, comma_list, strip_subject
from agreemill.session import session
from agreemill.sinks.tables import bench_rows


#: Stands for a flag that was not given, where None is a value.
UNSET = object()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="agreemill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run registered queries")
    run.add_argument("names", nargs="+")
    run.add_argument("--sf-dir", required=True)
    run.add_argument("--out")
    listing = sub.add_parser("list", help="names of the registered queries")
    listing.add_argument("--sql", action="store_true", help="with their SQL")
    score = sub.add_parser("score", help="score pairs of stored features")
    score.add_argument("--config", required=True)
    score.add_argument("--pairs", required=True)
    score.add_argument("--patches", required=True)
    score.add_argument("--texts", help="vectors by pf_prompt")
    score.add_argument("--tokens", help="parsed prompts, for the syntax stripper")
    score.add_argument("--names", help="parsed names of the subjects, for the syntax stripper")
    score.add_argument("--method", help="comma-separated methods, instead of the configuration's")
    score.add_argument("--min-fg-fraction", type=fraction_or_none, default=UNSET, help="a number, or none, instead of the configuration's")
    score.add_argument("--tag-suffix", default="", help="added to the configuration's tag")
    score.add_argument("--stripper", choices=STRIPPERS, help="instead of the configuration's")
    score.add_argument("--dump-patch-arrays", action="store_true")
    score.add_argument("--max-samples", type=int)
    score.add_argument("--batches", type=int, default=1, help="parts of the run that are committed one by one")
    score.add_argument("--out", help="instead of the configuration's")
    strip = sub.add_parser("strip", help="strip a subject from a prompt")
    strip.add_argument("prompt")
    strip.add_argument("subject")
    strip.add_argument("--stripper", choices=("regex", "none"), default="regex")
    bench = sub.add_parser("bench", help="time registered queries")
    bench.add_argument("--sf-dir", required=True)
    bench.add_argument("--only", help="comma-separated names")
    bench.add_argument("--skip", default="")
    bench.add_argument("--warmup", type=int, default=1)
    bench.add_argument("--runs", type=int, default=3)
    bench.add_argument("--out", help="a folder for one JSON line a query")
    follow = sub.add_parser("follow", help="score a variant of prompt following from stored features")
    follow.add_argument("--config", required=True)
    follow.add_argument("--samples", required=True, help="samples with text_id, image_id and prompt")
    follow.add_argument("--patches", required=True)
    follow.add_argument("--texts", help="pooled vectors by text_id")
    follow.add_argument("--tokens", help="token features by text_id")
    follow.add_argument("--variant")
    follow.add_argument("--skip-style", action="store_true")
    follow.add_argument("--batches", type=int, default=1)
    follow.add_argument("--out")
    masks = sub.add_parser("masks", help="make masks by a registered segmenter")
    masks.add_argument("--jobs", required=True, help="path, name and what the segmenter reads")
    masks.add_argument("--segmenter", required=True)
    masks.add_argument("--plugins", help="a module that registers it")
    masks.add_argument("--overwrite", action="store_true")
    masks.add_argument("--batches", type=int, default=1)
    masks.add_argument("--out", required=True)
    boot = sub.add_parser("boot", help="agreement of rated rows with bootstrap intervals")
    boot.add_argument("--table", required=True, help="row_idx, g1, g2 and a column a row label")
    boot.add_argument("--rows", required=True, help="label:ordinal or label:continuous, comma-separated")
    boot.add_argument("--id", default="table", help="names the draws")
    boot.add_argument("--cluster", help="column of the cluster bootstrap")
    auc = sub.add_parser("auc", help="AUC of pair scores with paired bootstrap intervals")
    auc.add_argument("--pairs", required=True, help="a, b, within and a column a metric")
    auc.add_argument("--metrics", required=True)
    for p in (boot, auc):
        p.add_argument("--compare", default="", help="pairs one-two, comma-separated")
        p.add_argument("--B", type=int, default=10_000, help="replicates")
        p.add_argument("--out", required=True, help="a folder for one table a part")
    return top


def _pairs_of(text: str) -> list[tuple[str, str]]:
    out = []
    for part in methods(text):
        one, dash, two = part.partition("-")
        if not dash:
            raise ValueError(f"{part!r} names no two labels")
        out.append((one, two))
    return out


def _tables(frames: dict, out: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
        print(f"{name}\t{out}/{name}")


def appendix(spark, args) -> None:
    """The commands boot and auc."""
    if args.command == "auc":
        from agreemill.operators.paired import auc_table

        _tables(auc_table(spark.read.parquet(args.pairs), methods(args.metrics), _pairs_of(args.compare), args.B), args.out)
        return
    from agreemill.plans.rated import rated

    kinds = dict(part.partition(":")[::2] for part in methods(args.rows))
    if set(kinds.values()) - {"ordinal", "continuous"}:
        raise ValueError("rows are label:ordinal or label:continuous")
    _tables(rated(spark, spark.read.parquet(args.table), {k: v == "ordinal" for k, v in kinds.items()}, args.id, args.B, _pairs_of(args.compare), args.cluster), args.out)


def features_run(spark, args) -> None:
    """The commands follow and masks."""
    from agreemill.plans import scoring

    if args.command == "masks":
        if args.plugins:
            importlib.import_module(args.plugins)
        run = scoring.mask_run(spark, spark.read.parquet(args.jobs), args.segmenter, args.out, args.overwrite, args.batches)
    else:
        config = load(args.config, out=args.out, variant=args.variant, skip_style=args.skip_style or None)
        if not config.out:
            raise SystemExit("no place for the results: set out in the configuration or --out")
        optional = [spark.read.parquet(p) if p else None for p in (args.texts, args.tokens)]
        run = scoring.follow_run(spark, config, spark.read.parquet(args.samples), spark.read.parquet(args.patches), *optional, batches=args.batches)
    print(f"{sum(r['n_rows'] for r in run.records())} rows in {len(run.records())} batches")


def methods(text: str | None) -> list[str]:
    return [m.strip() for m in (text or "").split(",") if m.strip()]


def timed(query, spark, sf_dir: str, warmup: int, runs: int) -> list[float]:
    """Seconds of each timed run, after the warm-up ones."""
    out = []
    for i in range(warmup + runs):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.append(time.perf_counter() - start)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import functions as F

    from agreemill.plans import registry

    queries = registry.queries()
    if args.command == "list":
        for name in sorted(queries):
            print(name, registry.oracle_sql().get(name, "") if args.sql else "", sep="\t" if args.sql else "")
        return 0
    spark = session()
    if args.command == "run":
        for name in args.names:
            df = queries[name](spark, args.sf_dir)
            df.write.mode("overwrite").parquet(f"{args.out}/{name}") if args.out else df.show(50, truncate=False)
    elif args.command == "bench":
        wanted = methods(args.only) or sorted(queries)
        rows = [(n, s) for n in wanted if n not in methods(args.skip) for s in timed(queries[n], spark, args.sf_dir, args.warmup, args.runs)]
        df = spark.createDataFrame(rows, "name string, seconds double")
        summary = df.groupBy("name").agg(F.median("seconds").alias("median"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("stdev")).orderBy("name")
        summary.show(200, truncate=False)
        if args.out:
            bench_rows(summary, args.out)
    elif args.command in ("boot", "auc"):
        appendix(spark, args)
    elif args.command in ("follow", "masks"):
        features_run(spark, args)
    elif args.command == "strip":
        row = spark.createDataFrame([(args.prompt, args.subject)], "prompt string, subject string")
        print(row.select(strip_subject("prompt", "subject", args.stripper)).first()[0])
    else:
        from dataclasses import replace

        from agreemill.plans import scoring
        from agreemill.sinks.reports import run_record

        config = load(args.config, stripper=args.stripper, max_samples=args.max_samples, dump_patch_arrays=args.dump_patch_arrays or None, out=args.out, methods=methods(args.method) or None)
        config = replace(config, tag=config.tag + args.tag_suffix, **({} if args.min_fg_fraction is UNSET else {"min_fg_fraction": args.min_fg_fraction}))
        if not config.out:
            raise SystemExit("no place for the results: set out in the configuration or --out")
        pairs, features = spark.read.parquet(args.pairs), spark.read.parquet(args.patches)
        parses = (spark.read.parquet(args.tokens), spark.read.parquet(args.names)) if args.tokens and args.names else None
        texts = spark.read.parquet(args.texts) if args.texts else None
        run = scoring.score_run(spark, config, pairs, features, texts, parses, batches=args.batches)
        missing = scoring.without_features(scoring.samples_of(config, pairs), features).first()
        records = run.records()
        run_record(spark, scoring.settings(config), out=config.out, n_samples=missing["n_samples"], n_missing=missing["n_missing"], n_rows=sum(r["n_rows"] for r in records), n_batches=len(records)).write.mode("append").json(f"{config.out}/_runs")
        print(f"{sum(r['n_rows'] for r in records)} rows in {len(records)} batches; {missing['n_missing']} of {missing['n_samples']} samples without features")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
