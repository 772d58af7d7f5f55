"""Command verbs: ``python -m voxloom VERB ...``; JSON results on standard output.

Exit code 0 where all is accepted, 2 where something is not or the call is wrong.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import audit, measures, ranking, speech
from voxloom.sources import files


def _json(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise argparse.ArgumentTypeError(f"no JSON: {e}") from e


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom", description="Curation, scoring and encoding of speech and text data.")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("audit", help="accept or reject the rows of a manifest")
    a.add_argument("manifest"), a.add_argument("accepted"), a.add_argument("rejected")
    a.add_argument("--thresholds", type=_json, default={}, help="JSON object of thresholds")
    e = verbs.add_parser("evaluate", help="error rates and optional metrics of a table of texts and hypotheses")
    e.add_argument("rows"), e.add_argument("--report")
    d = verbs.add_parser("distill", help="good winners of generation reports as a manifest")
    d.add_argument("reports", nargs="+"), d.add_argument("target")
    d.add_argument("--least-score", type=float, default=0.75), d.add_argument("--most-cer", type=float, default=0.10)
    c = verbs.add_parser("codec-check", help="distance of decoded signals from their originals")
    c.add_argument("pairs"), c.add_argument("--rate", type=int, default=24000)
    return p


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # a few rows: a report


def _audit(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, bool]:
    manifest = files.read_jsonl(spark, a.manifest)
    made = audit.audit(manifest.withColumn("_line", F.col("_line")), "_line", "id", thresholds=audit.Thresholds(**a.thresholds)).drop("_file")
    files.write_jsonl(audit.accepted(made).drop("_line"), a.accepted, "overwrite")
    files.write_jsonl(audit.rejected(made).drop("_line"), a.rejected, "overwrite")
    totals = _rows(audit.totals(made))[0]
    return totals | {"reasons": {r["reason"]: r["n_rows"] for r in _rows(audit.reason_counts(made))}}, True


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, bool]:
    out = {r.pop("metric"): r for r in _rows(measures.aggregate_numeric(speech.evaluated(_read(spark, a.rows))))}
    if a.report:
        files.write_small_json(out, a.report)
    return out, True


def _distill(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, bool]:
    reports = files.read_reports(spark, a.reports)
    kept = ranking.distilled(reports, a.least_score, a.most_cer)
    files.write_jsonl(kept, a.target, "overwrite")
    n, k = reports.count(), kept.count()
    return {"n_reports": n, "n_kept": k}, n == k


def _codec(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, bool]:
    made = speech.codec_check(_read(spark, a.pairs), "reference", "estimate", a.rate)
    return {r.pop("metric"): r for r in _rows(measures.aggregate_numeric(made))}, True


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("voxloom").getOrCreate()
    run = {"audit": _audit, "evaluate": _evaluate, "distill": _distill, "codec-check": _codec}[args.verb]
    try:
        result, good = run(session, args)
    except (ValueError, TypeError, OSError) as e:
        print(f"voxloom {args.verb}: {e}", file=sys.stderr)
        return 2
    print(json.dumps(result, ensure_ascii=False, sort_keys=True, indent=2))
    return 0 if good else 2


if __name__ == "__main__":
    sys.exit(main())
