"""Upsert of daily batches: what is new, repeated or in conflict, and a log of what was done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.functions.arrays import arrays_nearly_equal, nearly_equal
from stallwise.operators.lineage import written
from stallwise.operators.panel_checks import panel_violations
from stallwise.operators.recovery import recover_by_profile
from stallwise.sources.panels import build_panel, load_layer, save_layer

KEY = ("series_id", "dt")


def prepare_batch(raw: DataFrame) -> DataFrame:
    return build_panel(raw).withColumn("split", F.lit("update"))


def classify(current: DataFrame, batch: DataFrame, compared: Sequence[str]) -> DataFrame:
    """The batch with kind: new, duplicate (equal within tolerance, nulls and array elements too) or conflict."""
    types = dict(batch.dtypes)
    old = current.select(*KEY, F.struct(*compared).alias("_old"))
    same = F.lit(True)
    for c in compared:
        a, b = F.col(c), F.col(f"_old.{c}")
        same = same & (arrays_nearly_equal(a, b) if types[c].startswith("array") else nearly_equal(a, b) if types[c] in ("double", "float", "int", "bigint") else a.eqNullSafe(b))
    met = batch.join(old, list(KEY), "left")
    return met.withColumn("kind", F.when(F.col("_old").isNull(), "new").when(same, "duplicate").otherwise("conflict")).drop("_old")


def report(current: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: rows of each kind, series of the batch that the panel lacks, and its days."""
    known = current.select("series_id").distinct()
    fresh = classified.select("series_id").distinct().join(known, "series_id", "left_anti").agg(F.count(F.lit(1)).alias("n_new_series"))
    sums = classified.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("new", "duplicate", "conflict")), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))
    return sums.crossJoin(fresh)


def merge(current: DataFrame, classified: DataFrame, on_conflict: str = "reject") -> DataFrame:
    """The panel after the batch: as it was if there is a conflict and those are rejected, else with new rows added and
    conflicting ones replaced."""
    if on_conflict not in ("reject", "replace"):
        raise ValueError("on_conflict is reject or replace")
    taken = classified.filter(F.col("kind") != "duplicate")
    if on_conflict == "reject":
        clash = classified.agg((F.count_if(F.col("kind") == "conflict") > 0).alias("_clash"))
        taken = taken.crossJoin(F.broadcast(clash)).filter("not _clash").drop("_clash")
    kept = current.join(taken.select(*KEY), list(KEY), "left_anti")
    return kept.unionByName(taken.select(*current.columns))


LOG = T.StructType([T.StructField(n, t) for n, t in (("version", T.StringType()), ("status", T.StringType()), ("n_rows", T.LongType()), ("n_new", T.LongType()), ("n_duplicate", T.LongType()), ("n_conflict", T.LongType()), ("n_new_series", T.LongType()), ("last_day", T.DateType()), ("at", T.TimestampType()), ("batch_hash", T.StringType()))])


def _text(name: str, kind: str) -> Column:
    """A value as text that is the same for equal values: doubles with six places, elements apart, nulls marked."""

    def number(c: Column) -> Column:
        x = c.cast("double") + F.lit(0.0)
        # A decimal has the same text and is several times as quick to write; beyond its range, and below zero, where the format
        # keeps the sign of what it rounds to zero, the format itself is used.
        return F.coalesce(F.when((x >= 0) & (x < 1e11), x.cast("decimal(18,6)").cast("string")).otherwise(F.format_string("%.6f", x)), F.lit("-"))

    c = F.col(name)
    if kind.startswith("array<") and kind[6:-1] in ("double", "float"):
        text = F.array_join(F.transform(c, number), ";")
    elif kind.startswith("array<"):
        text = F.array_join(c.cast("array<string>"), ";", "-")
    else:
        text = number(c) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(text, F.lit("-"))


def batch_hash(raw: DataFrame) -> DataFrame:
    """One row (n_rows, batch_hash): the sum of the rows' hashes, so that the order of rows and the way they are dealt don't
    matter; repeated rows count. A row's hash is the first 60 bits of the MD5 of its values, columns in order of name."""
    line = F.concat_ws("|", *(_text(n, k) for n, k in sorted(raw.dtypes)))
    number = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string").alias("batch_hash"))


def ingest(spark: SparkSession, raw: DataFrame, layer: str, compared: Sequence[str], on_conflict: str = "reject", dry_run: bool = False) -> DataFrame:
    """Applies a batch to the newest version of a layer and writes the next version, recovered anew, and a log row.

    A version is written whole before its log row names it, so a reader never sees half of one. A batch whose hash is that
    of the last written one is a replay: it changes nothing, and the layer isn't read for it."""
    log = read_log(spark, layer)
    mark = batch_hash(raw).first()
    last = log.filter("status = 'written'").agg(F.max_by("batch_hash", "at").alias("h"), F.max_by("version", "at").alias("v"), F.max_by("last_day", "at").alias("d")).first()
    if last["h"] == mark["batch_hash"]:
        entry = spark.createDataFrame([(last["v"], "no change", mark["n_rows"], 0, mark["n_rows"], 0, 0, last["d"], mark["batch_hash"])], "version string, status string, n_rows long, n_new long, n_duplicate long, n_conflict long, n_new_series long, last_day date, batch_hash string")
        entry = written(entry.withColumn("at", F.current_timestamp()).select(*LOG.fieldNames()))
        entry.write.mode("append").parquet(f"{layer}/log")
        return entry
    latest = log.filter("status = 'written'").agg(F.max_by("version", "at").alias("v"), F.count(F.lit(1)).alias("n")).first()
    current = load_layer(spark, f"{layer}/{latest['v']}")
    classified = classify(current, prepare_batch(raw), compared).persist()
    row = report(current, classified)
    got = row.first()
    status = "rejected" if got["n_conflict"] and on_conflict == "reject" else "no change" if got["n_new"] + got["n_conflict"] == 0 else "dry run" if dry_run else "written"
    version = f"v{latest['n']:06d}" if status == "written" else latest["v"]
    if status == "written":
        merged = merge(current.select([c for c in current.columns if c not in ("demand_latent", "inflation_factor", "profile_share")]), classified, on_conflict)
        # Written first and judged as it stands there, so that it is made once; without a log row no reader takes it.
        save_layer(recover_by_profile(merged), f"{layer}/{version}")
        bad = panel_violations(load_layer(spark, f"{layer}/{version}")).filter("rule != 'series_with_gaps' and violations > 0").count()
        if bad:
            raise ValueError(f"the merged panel breaks {bad} rules")
    entry = row.select(F.lit(version).alias("version"), F.lit(status).alias("status"), "n_rows", "n_new", "n_duplicate", "n_conflict", "n_new_series", "last_day", F.current_timestamp().alias("at"), F.lit(mark["batch_hash"]).alias("batch_hash"))
    entry = written(entry)
    entry.write.mode("append").parquet(f"{layer}/log")
    classified.unpersist()
    return entry


def start_layer(panel: DataFrame, layer: str) -> None:
    """The first version of a layer and of its log."""
    save_layer(recover_by_profile(panel), f"{layer}/v000000")
    one = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.max("dt").alias("last_day"))
    zero = F.lit(0).cast("long")
    one.select(F.lit("v000000").alias("version"), F.lit("written").alias("status"), "n_rows", F.col("n_rows").alias("n_new"), zero.alias("n_duplicate"), zero.alias("n_conflict"), zero.alias("n_new_series"), "last_day", F.current_timestamp().alias("at"), F.lit(None).cast("string").alias("batch_hash")).write.mode("overwrite").parquet(f"{layer}/log")


def read_log(spark: SparkSession, layer: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{layer}/log")


def status(log: DataFrame, trained_until: DataFrame) -> DataFrame:
    """One row: the version and last day of the newest written entry, attempts by outcome, and days by which
    trained_until lies behind."""
    kinds = {"n_written": "written", "n_rejected": "rejected", "n_no_change": "no change", "n_dry_run": "dry run"}
    done = F.col("status") == "written"
    sums = log.agg(F.max_by("version", F.when(done, F.col("at"))).alias("version"), F.max_by("last_day", F.when(done, F.col("at"))).alias("last_day"), *(F.count_if(F.col("status") == k).alias(n) for n, k in kinds.items()))
    return sums.crossJoin(freshness(log, trained_until).select("days_behind"))


def freshness(log: DataFrame, trained_until: DataFrame) -> DataFrame:
    """Days by which trained_until (one row, trained_until) lies behind the newest data."""
    newest = log.filter("status = 'written'").agg(F.max("last_day").alias("data_until"))
    return newest.crossJoin(trained_until).select("data_until", "trained_until", F.datediff("data_until", "trained_until").alias("days_behind"))
