"""The usage ledger: what answers cost and what they saved."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration, short_number, shorten_path
from ..sources.index import LEDGER_SCHEMA, append_ledger, read_ledger

READ_RATE = 1000.0  # tokens a second
TOP_REPOS = 10


def read_rate() -> float:
    try:
        rate = float(os.environ.get("QUARRY_READ_RATE", ""))
    except ValueError:
        return READ_RATE
    return rate if rate > 0 else READ_RATE


def ledger_path(flag: str | None = None) -> str:
    """Flag, then environment, then the user's data folder."""
    home = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return flag or os.environ.get("QUARRY_LEDGER") or os.path.join(home, "quarry", "ledger")


def log_run(spark: SparkSession, path: str, repo: str, verb: str, spent_tokens: int, spent_ms: int, naive: int | None, rate: float | None = None) -> None:
    """Append one run. naive: tokens that reading the answer's files would cost, None if no file is named."""
    ms = None if naive is None else int(naive / (rate or read_rate()) * 1000 + 0.5)
    row = (int(time.time()), repo, verb, spent_tokens, spent_ms, naive, ms, "none" if naive is None else "file-set")
    append_ledger(spark.createDataFrame([row], LEDGER_SCHEMA), path)


def rollup(ledger: DataFrame) -> DataFrame:
    """(level, name, runs, spent_tokens, ...): totals, repositories and verbs in one pass of grouping sets."""
    ledger.createOrReplaceTempView("quarry_ledger")
    return ledger.sparkSession.sql("""
        SELECT CASE WHEN grouping(repo) = 0 THEN 'repo' WHEN grouping(verb) = 0 THEN 'verb' ELSE 'total' END AS level,
               coalesce(repo, verb, '') AS name, count(*) AS runs, sum(spent_tokens) AS spent_tokens, sum(spent_ms) AS spent_ms,
               count_if(model <> 'file-set') AS unmodelled,
               coalesce(sum(naive_tokens), 0) AS naive_tokens, coalesce(sum(naive_ms), 0) AS naive_ms,
               coalesce(sum(CASE WHEN naive_tokens IS NOT NULL THEN spent_tokens END), 0) AS modelled_tokens,
               coalesce(sum(CASE WHEN naive_ms IS NOT NULL THEN spent_ms END), 0) AS modelled_ms
        FROM quarry_ledger GROUP BY GROUPING SETS ((), (repo), (verb))""")


def savings(totals: DataFrame) -> DataFrame:
    """saved_tokens and saved_ms with whole percents in [0, 100]; nothing saved counts as 0."""
    def part(naive: str, spent: str):
        saved = F.col(naive) - F.col(spent)
        share = F.when((F.col(naive) > 0) & (saved > 0), F.least(F.expr(f"(({naive} - {spent}) * 100) div {naive}"), F.lit(100))).otherwise(F.lit(0))
        return saved, share.cast("bigint")

    tokens, tokens_pct = part("naive_tokens", "spent_tokens")
    ms, ms_pct = part("naive_ms", "spent_ms")
    return totals.withColumn("saved_tokens", tokens).withColumn("saved_tokens_pct", tokens_pct).withColumn("saved_ms", ms).withColumn("saved_ms_pct", ms_pct)


def gain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a ledger file."""
    rows = rollup(read_ledger(spark, path))
    return rows.where("level <> 'total'").orderBy("level", "name"), savings(rows.where("level = 'total'"))


def top_repos(repos: DataFrame) -> DataFrame:
    """The TOP_REPOS repositories that spent most, ties by name."""
    return repos.orderBy(F.desc("spent_tokens"), "name").limit(TOP_REPOS)


def report(spark: SparkSession, path: str) -> str:
    """The gain report as text."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return f"No ledger at {path}: nothing has been logged yet."
    rows, summary = gain(spark, path)
    s = summary.select("*", short_number(F.col("spent_tokens")).alias("spent"), short_number(F.col("naive_tokens")).alias("naive"),
                       short_number(F.col("saved_tokens")).alias("saved"), duration(F.col("saved_ms")).alias("time")).first()
    out = [f"Runs: {s['runs']}", f"Tokens: {s['spent']} spent, {s['naive']} by reading whole files, {s['saved']} saved ({s['saved_tokens_pct']} %)",
           f"Time: {s['time']} saved ({s['saved_ms_pct']} %)", f"Runs without a model of the cost avoided: {s['unmodelled']}"]
    repos = rows.where("level = 'repo'")
    n = repos.count()
    out += [f"  {r['p']}: {r['runs']} runs, {r['t']} tokens" for r in top_repos(repos).select(
        shorten_path(F.col("name")).alias("p"), "runs", short_number(F.col("spent_tokens")).alias("t")).collect()]
    if n > TOP_REPOS:
        out.append(f"  and {n - TOP_REPOS} more")
    out += [f"  {r['name']}: {r['runs']} runs, {r['t']} tokens" for r in rows.where("level = 'verb'").select(
        "name", "runs", short_number(F.col("spent_tokens")).alias("t")).orderBy("name").collect()]
    return "\n".join(out) + "\n"
