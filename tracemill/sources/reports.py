"""Sinks of a transcript check: summary.json, one JSON file for each sample that was drawn, and a text report. What is
drawn is bounded by the sampler's quotas, so these rows may pass through the driver; findings are a few rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession

from tracemill.operators import checks, sampling

STRATA = ("failures", "successes", "random")
MARKS = {"CRITICAL": "!!!", "WARNING": "!", "INFO": "i"}


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file to any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def plain(value):
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def write_output(samples: DataFrame, folder: str, source: str, kind: str, most: int = 15, seed: int = 42) -> tuple[dict, list[dict]]:
    """(summary, drawn samples), after both are written. An empty input has a summary of zeros and no findings. Findings
    list the ids of the first affected samples; checks.affected() has them all."""
    spark = samples.sparkSession
    held = samples.persist()
    drawn = [plain(r) for r in sampling.stratified_sample(held, most, seed).collect()]
    first = {r.type: r.ids for r in checks.first_affected(held).collect()}
    found = [plain(r) for r in checks.findings(held).collect()]
    spread = {r.label: r.n for r in checks.score_distribution(held).collect()}
    held.unpersist()
    summary = {
        "source": source, "format_detected": kind, "total_samples": sum(spread.values()), "score_distribution": spread,
        "issues": [f | {"affected_samples": first.get(f["type"], []) if f["affected"] else []} for f in found],
        "samples_extracted": len(drawn), "extraction_breakdown": {s: sum(d["stratum"] == s for d in drawn) for s in STRATA},
    }
    put(spark, f"{folder}/summary.json", json.dumps(summary, indent=2))
    for d in drawn:
        put(spark, f"{folder}/samples/{d['id']}.json", json.dumps({k: v for k, v in d.items() if k not in ("idx", "stratum")}, indent=2))
    return summary, drawn


def clipped(text: str, most: int = 120) -> str:
    return text if len(text) <= most else text[:most] + "..."


def report(summary: dict, drawn: list[dict], verbose: bool = False) -> str:
    counts = lambda d: ", ".join(f"{k} {v}" for k, v in d.items())
    out = [f"{summary['source']} ({summary['format_detected']}): {summary['total_samples']} samples; {counts(summary['score_distribution'])}"]
    out.append(f"drawn {summary['samples_extracted']}: {counts(summary['extraction_breakdown'])}")
    for f in summary["issues"]:
        out.append(f"[{MARKS.get(f['severity'], ' ')}] {f['severity']} {f['type']}: {f['message']}")
        if ids := f["affected_samples"]:
            more = f["affected"] - len(ids[:5])
            out.append(f"    {', '.join(ids[:5])}" + (f" (+{more} more)" if more > 0 else ""))
    if not summary["issues"]:
        out.append("no issues found")
    for d in drawn if verbose else []:
        out += [f"{d['id']}: {d['score']} ({d['score_label']})", f"    in:  {clipped(d['input'] or '')}", f"    out: {clipped(d['output'] or '')}"]
    return "\n".join(out)
