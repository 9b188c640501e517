"""Command line: ``python -m costweave.cli {profile,validate,run,propose-mappings,init-config,backtest,historical-actuals} ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave import config
from costweave.operators import backtest, basket, bridge, classify, committed, forecast, indices, matching, pairs, panel, quality, regression
from costweave.operators.clean import clean_lines, flag_duplicates
from costweave.plans.historical import historical_tables, markdown
from costweave.plans.sinks import snapshot, write_package
from costweave.plans.stages import staged, tuned
from costweave.plans.store import StageStore, each_time, input_fingerprint
from costweave.sources import files, star_schema, workbooks


def _lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.format == "star":
        return star_schema.po_lines(spark, args.input)
    if args.format == "workbooks":
        return workbooks.read_workbooks(spark, [str(f) for f in files.discover(args.input, (".xlsx", ".xlsm"))])
    return files.read_csv(spark, args.input) if args.format == "csv" else files.read_parquet(spark, args.input)


def run_tables(
    lines: DataFrame | Callable[[], DataFrame],
    resolved: config.Resolved,
    bands: bool = False,
    keep: Callable[[Callable[[], DataFrame], str], DataFrame] = each_time,
) -> tuple[dict[str, DataFrame], dict]:
    """All tables of a full run. Stops where pairs are too few or the fit does not converge.

    With ``bands`` the method comes from the rolling backtest, and the composite forecast has the quantiles of refits on resampled parts.
    ``keep`` writes the large stages or finds them again (:class:`costweave.plans.store.StageStore`); ``lines``
    may be a function, which is called only where the classified lines are not found.
    """
    c = resolved.controls

    def classified_lines() -> DataFrame:
        read = lines() if callable(lines) else lines
        return classify.classify_lines(flag_duplicates(clean_lines(read, c), c.deduplication_mode), resolved)

    classified = keep(classified_lines, "classified")
    latest = classified.agg(F.max("effective_date")).first()[0]
    base, _ = config.resolve_dates(c, latest)
    known = keep(lambda: classify.label_categories_at(classified.where(F.col("effective_date") <= F.lit(base)), base), "known")
    daily = keep(lambda: panel.realized_daily(known, base, c.same_day_price_aggregation), "daily")
    adjacent = keep(lambda: pairs.adjacent_pairs(daily, c.historical_min_pair_gap_days), "pairs")
    weighted = keep(lambda: pairs.pair_weights(pairs.flag_extremes(adjacent), c.pair_weight_method), "weighted")
    n = weighted.count()
    if n < 50:
        raise ValueError(f"only {n} repeat-purchase pairs; 50 are needed")
    model = regression.fit_repeat_sales(weighted, c)
    if not model.converged and c.fail_on_nonconvergence:
        raise ValueError("the repeat-sales fit did not converge")
    rates = model.rates(classified.sparkSession)
    weights = basket.planned_weights(known, resolved.planned_basket, base) if resolved.planned_basket is not None else basket.fiscal_weights(known, base, c.fiscal_year_start_month)
    detail = committed.committed_detail(known, base)
    signal = committed.committed_signal(detail)
    method, extra = None, {}
    if bands:
        detail_ = staged(backtest.composite_backtest(daily, known, base, c, None), "backtest")
        summary_ = backtest.backtest_summary(detail_)
        best = summary_.where("selected").first()
        method = best.method if best else forecast.METHODS[0]
        extra = {"composite_backtest": detail_, "composite_summary": summary_}
    bucket, composite = forecast.annual_forecast(rates, weights, quality.pair_coverage(weighted), base, signal, forced_method=method, controls=c)
    resampled: dict = {}
    if bands:
        found, resampled = backtest.bootstrap_forecasts(weighted.drop("pair_weight"), weights, base, method, signal, c)
        composite = backtest.with_bands(composite, found)
    index = regression.monthly_index(rates, weights, base)
    residuals = regression.part_residuals(regression.predict_pairs(weighted, model))
    bridged = bridge.bridged_prices(daily, residuals, model, base, bridge.manual_values(known))
    priced = staged(bridge.basket_quantities(bridged, known.withColumn("model_eligible", F.col("included_for_pricing")), base, resolved.planned_basket), "priced")
    parts = staged(bridge.part_forecast(priced, bucket, composite), "part-forecast")
    tables = {
        "monthly_rates": rates, "monthly_index": index, "fiscal_and_trailing_rates": regression.fiscal_and_trailing_rates(index, base, c.fiscal_year_start_month), "bucket_weights": weights,
        "coverage": quality.coverage_table(weighted, known, base), "committed_detail": detail, "committed_signal": signal, "bucket_forecast": bucket, "composite_forecast": composite,
        "part_forecast": parts, "purchasing_cost": bridge.purchasing_cost(parts.where("forecast_year = 1")), "source_trace": bridge.source_trace(known),
        "data_quality": quality.data_quality(classified, daily, weighted), "exclusions": quality.exclusion_log(classified), "family_candidates": matching.family_candidates(staged(matching.part_stats(known), "parts")),
        **indices.all_benchmarks(daily, c.fiscal_year_start_month), **extra,
    }
    return tables, {"selected_method": method, "resamples": resampled, "base_date": base, "pairs": n, "sigma": model.sigma, "gamma": model.gamma0, "warnings": model.warnings, "controls": vars(c), "sources": resolved.sources}


def backtest_tables(lines: DataFrame, resolved: config.Resolved) -> tuple[dict[str, DataFrame], dict]:
    """Rolling backtests of the composite and of parts, and the chosen method."""
    c = resolved.controls
    classified = classify.classify_lines(flag_duplicates(clean_lines(lines, c), c.deduplication_mode), resolved)
    base, _ = config.resolve_dates(c, classified.agg(F.max("effective_date")).first()[0])
    known = staged(classified.where(F.col("effective_date") <= F.lit(base)), "known")
    daily = staged(panel.realized_daily(known, base, c.same_day_price_aggregation), "daily")
    detail = staged(backtest.composite_backtest(daily, known, base, c, None), "backtest")
    summary = backtest.backtest_summary(detail)
    parts = staged(backtest.part_backtest_summary(backtest.part_backtest(daily, c, wide=True)), "part-summary")
    tables = {"composite_backtest": detail, "composite_summary": summary, "part_backtest": parts}
    best = summary.where("selected").first()
    return tables, {"selected_part_model": backtest.select_model(parts, c), "base_date": base, "selected_method": best.method if best else None, "controls": vars(c)}


def profile_tables(spark: SparkSession, lines: DataFrame, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Every source file with its rows, dates, size, time, fingerprint and warnings."""
    listing = files.listing(spark, args.input, fingerprints=True)
    return {"files": quality.file_profile(staged(lines.select("source_file", "source_sheet", "po_date"), "profile-lines"), listing).orderBy("first_date", "source_file")}


def validation_tables(lines: DataFrame, resolved: config.Resolved, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Profile figures, lines by the reason that leaves them out, data quality, and expected figures where they are given."""
    c = resolved.controls
    classified = staged(classify.classify_lines(flag_duplicates(clean_lines(lines, c), c.deduplication_mode), resolved), "classified")
    base, _ = config.resolve_dates(c, classified.agg(F.max("effective_date")).first()[0])
    known = classify.label_categories_at(classified.where(F.col("effective_date") <= F.lit(base)), base)
    daily = staged(panel.realized_daily(known, base, c.same_day_price_aggregation), "daily")
    flagged = staged(pairs.flag_extremes(staged(pairs.adjacent_pairs(daily, c.historical_min_pair_gap_days), "pairs")), "flagged")
    profile = staged(quality.profile(classified), "profile")
    tables = {"profile": profile, "exclusions": quality.exclusion_log(classified), "data_quality": quality.data_quality(classified, daily, flagged)}
    if args.expected:
        with open(args.expected, encoding="utf-8") as f:
            tables["expected"] = quality.compare_profile(profile, json.load(f))
    return tables


def _resolved(spark: SparkSession, args: argparse.Namespace) -> config.Resolved:
    own = {"base_date": args.base_date, "fast_mode": args.fast or None}
    if not args.config:
        return config.resolve({}, own)
    return config.load(args.config, own) if args.config.lower().endswith(".json") else config.load_tables(spark, args.config, own)


def _config_digest(spark: SparkSession, args: argparse.Namespace) -> str:
    return input_fingerprint(snapshot(spark, [args.config])) if args.config else ""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="costweave")
    p.add_argument("command", choices=("profile", "validate", "run", "propose-mappings", "init-config", "backtest", "historical-actuals"))
    p.add_argument("--input", required=True)
    p.add_argument("--format", choices=("star", "csv", "parquet", "workbooks"), default="parquet")
    p.add_argument("--output")
    p.add_argument("--config", help="JSON of controls, .xlsx workbook, or folder of CSV files")
    p.add_argument("--base-date", type=date.fromisoformat)
    p.add_argument("--first-fiscal-year", type=int)
    p.add_argument("--fast", action="store_true")
    p.add_argument("--cache", help="folder where run keeps its large stages and finds them again for the same files, rules and controls")
    p.add_argument("--cache-days", type=float, default=30.0, help="stages older than that are deleted from the folder")
    p.add_argument("--no-bands", action="store_true", help="run without the backtest and the refits on resampled parts")
    p.add_argument("--workbook", action="store_true", help="write the tables as sheets of report.xlsx too")
    p.add_argument("--expected", help="JSON file of expected profile figures, which validate compares")
    args = p.parse_args(argv)
    spark = tuned(SparkSession.builder.getOrCreate())
    resolved = _resolved(spark, args)
    writes = args.command in ("run", "backtest", "historical-actuals")
    before = staged(snapshot(spark, [args.input]), "inputs") if writes else None
    if args.command == "run":
        keep = each_time
        if args.cache:
            # Mappings and overrides are inputs too; their sources stand in the configuration.
            settings = {"controls": vars(resolved.controls), "config": _config_digest(spark, args), "format": args.format}
            keep = StageStore(spark, args.cache, input_fingerprint(before), settings)
            keep.sweep(args.cache_days)
        try:
            tables, summary = run_tables(lambda: _lines(spark, args), resolved, bands=not args.no_bands, keep=keep)
            if args.cache:
                summary["stages"] = {"found": keep.hits, "built": keep.built}
            write_package(tables, args.output, summary, inputs=[args.input], before=before, required=("composite_forecast", "monthly_rates", "bucket_weights"), workbook=args.workbook)
        except BaseException:
            for stage in keep.built if args.cache else ():  # they may hold lines of files that changed
                keep.invalidate(stage)
            raise
        return 0
    lines = _lines(spark, args)
    if args.command in ("profile", "validate"):
        tables = profile_tables(spark, lines, args) if args.command == "profile" else validation_tables(lines, resolved, args)
        if args.output:
            write_package(tables, args.output, {"controls": vars(resolved.controls), "sources": resolved.sources}, workbook=args.workbook)
        for table in tables.values():
            table.show(1000, truncate=False)
    elif args.command == "init-config":
        print("\n".join(config.write_template(args.output, classify.complete_mapping(clean_lines(lines, resolved.controls)))))
    elif args.command == "propose-mappings":
        parts = staged(matching.part_stats(classify.classify_lines(clean_lines(lines, resolved.controls), resolved)), "parts")
        write_package({"family_candidates": matching.family_candidates(parts)}, args.output, {})
    else:
        if args.command == "backtest":
            tables, summary = backtest_tables(lines, resolved)
        else:
            tables, summary = historical_tables(lines, resolved.controls, args.base_date, args.first_fiscal_year, resolved.scope_mapping)
        texts = {"report.md": markdown(tables, summary)} if args.command == "historical-actuals" else {}
        write_package(tables, args.output, summary, inputs=[args.input], before=before, workbook=args.workbook, texts=texts)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
