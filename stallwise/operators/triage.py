"""Which series to look at first, and why; histories and summaries of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.statistics import correlation
from stallwise.operators.lineage import written
from stallwise.operators.numbering import ranks
from stallwise.operators.quantiles import exact_quantiles, levels
from stallwise.operators.recovery import stockout_runs


@dataclass(frozen=True)
class Cuts:
    mase: float = 1.0
    estimated_share: float = 0.30
    run_days: int = 5
    volume_quantile: float = 0.90
    waste: float = 0.50
    window_days: int = 28


REASONS = ("unreliable", "high_volume", "scarce_signal", "out_now", "waste_risk")


def waste_signals(lines: DataFrame) -> DataFrame:
    """Expected waste of both orders per series, as shares of the expected demand; zero where none is expected."""
    sums = lines.groupBy("series_id").agg(F.sum("expected_demand").alias("d"), F.sum("waste_model").alias("m"), F.sum("waste_policy").alias("p"))
    share = lambda x: F.coalesce(x / F.when(F.col("d") > 0, F.col("d")), F.lit(0.0))
    return sums.select("series_id", F.col("d").alias("expected_demand"), share(F.col("p")).alias("waste_policy"), share(F.col("m")).alias("waste_model"), share(F.greatest(F.col("p") - F.col("m"), F.lit(0.0))).alias("waste_avoidable"))


def series_signals(panel: DataFrame, result: DataFrame | None = None, cuts: Cuts = Cuts(), season: int = 7) -> DataFrame:
    """Per series over the last days of the panel: demand, share of it that is estimated, stock-out days that end on the
    last day, stock-out rate; with a backtest result also the series' error over its seasonal step."""
    last = panel.agg(F.max("dt").alias("_end"))
    w = Window.partitionBy("series_id").orderBy("dt")
    recent = panel.crossJoin(F.broadcast(last)).filter(F.col("dt") > F.date_sub("_end", cuts.window_days)).withColumn("_pos", F.row_number().over(w) - 1)
    y = F.col("demand_latent")
    out = recent.groupBy("series_id").agg(
        F.avg(y).alias("mean_demand"),
        F.coalesce(F.sum(F.greatest(y - F.col("sale_amount"), F.lit(0.0))) / F.nullif(F.greatest(F.sum(y), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("estimated_share"),
        (F.count(F.lit(1)) - 1 - F.max(F.when(~F.col("is_censored"), F.col("_pos")).otherwise(-1))).alias("current_run"),
        F.avg(F.col("is_censored").cast("int")).alias("stockout_rate"),
        F.count(F.lit(1)).alias("days"),
    )
    if result is None:
        return out
    scale = panel.select("series_id", F.abs(y - F.lag("demand_latent", season).over(w)).alias("step")).groupBy("series_id").agg(F.avg("step").alias("scale"))
    error = result.groupBy("series_id").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    mase = error.join(scale, "series_id").select("series_id", (F.col("mae") / F.when(F.col("scale") > 0, F.col("scale"))).alias("series_mase"))
    return out.join(mase, "series_id", "left").withColumn("series_mase", F.coalesce("series_mase", F.lit(0.0)))


def triage(signals: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """A flag per reason whose signal there is, their names as text, and how many apply."""
    flags: dict[str, Column] = {}
    out = written(signals)
    if "series_mase" in signals.columns:
        flags["unreliable"] = F.col("series_mase") > cuts.mase
    cut = exact_quantiles(out, [], "mean_demand", levels(cuts.volume_quantile)).select(F.col("q")[0].alias("_cut"))
    out = out.join(F.broadcast(cut), F.lit(True), "left")
    flags["high_volume"] = F.col("mean_demand") >= F.col("_cut")
    flags["scarce_signal"] = F.col("estimated_share") > cuts.estimated_share
    flags["out_now"] = F.col("current_run") >= cuts.run_days
    if "waste_policy" in signals.columns:
        flags["waste_risk"] = (F.col("waste_policy") >= cuts.waste) & (F.col("waste_avoidable") > 0)
    out = out.withColumns(flags).drop("_cut")
    named = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in flags)))
    return out.withColumns({"reasons": F.array_join(named, ", "), "n_reasons": F.size(named)})


def triage_summary(marked: DataFrame) -> DataFrame:
    """Per reason: series, their share, their share of volume, and series with no other reason."""
    here = [r for r in REASONS if r in marked.columns]
    rows = marked.select("mean_demand", "n_reasons", F.explode(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("hit")) for r in here))).alias("x"))
    return rows.groupBy("x.reason").agg(
        F.count_if("x.hit").alias("series"),
        F.avg(F.col("x.hit").cast("int")).alias("share_series"),
        F.coalesce(F.sum(F.when(F.col("x.hit"), F.col("mean_demand"))) / F.nullif(F.sum("mean_demand"), F.lit(0.0)), F.lit(0.0)).alias("share_volume"),
        F.count_if(F.col("x.hit") & (F.col("n_reasons") == 1)).alias("only_reason"),
    )


def alerts_page(marked: DataFrame, reason: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = marked.filter("n_reasons > 0")
    rows = rows.filter(F.col(reason)) if reason else rows
    return rows.orderBy(F.desc("n_reasons"), F.desc("mean_demand"), "series_id").offset(offset).limit(limit)


def signal_state(signals: DataFrame) -> DataFrame:
    """How far a series' recent demand was observed at all, and whether it is out of stock for some days now."""
    share = F.col("estimated_share")
    state = F.when(share >= 0.40, "scarce").when(share >= 0.30, "partial").otherwise("observed")
    return signals.select("series_id", "estimated_share", "current_run", state.alias("state"), F.when(F.col("current_run") >= 3, "out for days").otherwise(state).alias("label"))


def series_history(panel: DataFrame, days: int | None = None) -> DataFrame:
    """One summary row per series over its last days: stock-outs and their runs, days since a sale, estimated share,
    uplift on sums (on clean days it is zero by construction)."""
    back = Window.partitionBy("series_id").orderBy(F.desc("dt"))
    rows = panel.withColumn("_back", F.row_number().over(back) - 1)
    rows = rows.filter(F.col("_back") < days) if days else rows
    out, y, s = F.col("is_censored"), F.col("demand_latent"), F.col("sale_amount")
    late = F.col("_back") < 28
    up = lambda y, s: F.when(F.sum(s) > 0, 100 * (F.sum(y) / F.sum(s) - 1)).otherwise(0.0)
    sums = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(out).alias("n_censored"),
        F.count_if(out & late).alias("censored_last_28"),
        F.coalesce(F.min(F.when(~out, F.col("_back"))), F.count(F.lit(1))).cast("long").alias("current_run"),
        F.min(F.when(s > 0, F.col("_back"))).alias("days_since_sale"),
        F.least(F.greatest(F.coalesce(F.sum(F.when(late, y - s)) / F.nullif(F.sum(F.when(late, y)), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("estimated_share_28"),
        up(y, s).alias("uplift_pct"),
        up(F.when(~out, y), F.when(~out, s)).alias("uplift_clean_pct"),
    )
    runs = stockout_runs(rows).groupBy("series_id").agg(F.max("days").alias("max_run"))
    return sums.join(runs, "series_id", "left").withColumn("max_run", F.coalesce("max_run", F.lit(0)))


def group_stats(panel: DataFrame, key: str) -> DataFrame:
    """Per store, category, weekday or day: series, mean demand, share of volume, stock-outs and uplift."""
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(28,6)")).cast("double")  # noqa: E731  the same in any order of the rows
    mean = lambda c: exact(c) / F.count(c)
    sums = panel.groupBy(key).agg(F.count_distinct("series_id").alias("n_series"), mean("sale_amount").alias("mean_observed"), mean("demand_latent").alias("mean_demand"), exact("demand_latent").alias("v"), exact("sale_amount").alias("o"), F.avg(F.col("is_censored").cast("int")).alias("share_censored"))
    total = panel.agg(exact("demand_latent").alias("_all"))
    return sums.crossJoin(F.broadcast(total)).select(key, "n_series", "mean_observed", "mean_demand", F.coalesce(F.col("v") / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0)).alias("share_volume"), "share_censored", F.when(F.col("o") > 0, 100 * (F.col("v") / F.col("o") - 1)).otherwise(0.0).alias("uplift_pct"))


def stockout_histogram(panel: DataFrame, bins: int = 10) -> DataFrame:
    rate = panel.groupBy("series_id").agg(F.avg(F.col("is_censored").cast("int")).alias("rate"))
    return rate.groupBy(F.least(F.floor(F.col("rate") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_series"))


def demand_distribution(panel: DataFrame, target: str = "demand_latent") -> DataFrame:
    """One row: moments, quantiles and the share of days without demand; the quantiles are null where there is no value."""
    own = written(panel.select(target))
    q = exact_quantiles(own, [], target, levels(0.5, 0.9, 0.99)).select("q")
    one = own.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.min(target).alias("least"), F.max(target).alias("most"), F.avg((F.col(target) <= 0).cast("int")).alias("zero_share")).join(F.broadcast(q), F.lit(True), "left")
    return one.select("mean", "std", "least", "most", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "zero_share", F.when(F.col("q")[0] > 0, F.col("q")[2] / F.col("q")[0]).alias("p99_over_median"))


def concentration(lines: DataFrame, value: str = "cost_policy", tops: Sequence[float] = (0.01, 0.05, 0.10, 0.20, 0.50)) -> DataFrame:
    """Share of the total that the top series hold. The least value among the top ones comes from exact selection, so
    no task ranks all series; of series with just that value as many count as there is room for."""
    each = lines.groupBy("series_id").agg(F.sum(value).alias("v")).filter(F.col("v").isNotNull())
    room = lambda n: F.array(*(F.ceil(F.lit(t) * n) for t in tops))
    least = exact_quantiles(each, [], "v", lambda n: F.transform(room(n), lambda m: (n - m).cast("double")))
    limits = least.select(F.explode(F.arrays_zip(F.array(*map(F.lit, tops)).alias("top"), room(F.col("n")).alias("m"), F.col("q").alias("t"))).alias("x")).select("x.*")
    above = F.col("v") > F.col("t")
    sums = each.crossJoin(F.broadcast(limits)).groupBy("top", "m", "t").agg(F.sum(F.when(above, F.col("v")).otherwise(0.0)).alias("s"), F.count_if(above).alias("n"), F.sum("v").alias("all"))
    return sums.select("top", ((F.col("s") + (F.col("m") - F.col("n")) * F.col("t")) / F.nullif(F.col("all"), F.lit(0.0))).alias("share"))


def axis_overlap(signals: DataFrame, axes: Sequence[str], top: int = 50) -> DataFrame:
    """(axis_a, axis_b, spearman, n_both, overlap): how alike two ways of looking at series are: the correlation of
    their ranks, ties at their mean, over the series that have both, and how many of the first `top` series by one are
    among the first by the other. Ranks come from ranges of values, so no task orders all series."""
    ranked, first = signals.select("series_id", *axes), None
    for a in axes:
        ranked = ranks(ranked, a, f"_r_{a}")
        own = signals.filter(F.col(a).isNotNull()).orderBy(F.desc(a), "series_id").limit(top).select("series_id", F.lit(a).alias("axis"))
        first = own if first is None else first.unionByName(own)
    ranked = written(ranked)
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    # The ranks of series that have both values: ranks of all would leave gaps where the other value is missing.
    whole = ranked.agg(*(F.count_if(F.col(a).isNull()).alias(a) for a in axes)).first()
    rows = None
    for a, b in pairs:
        both = ranked.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        if whole[a] or whole[b]:
            both = ranks(ranks(both.select("series_id", a, b), a, f"_r_{a}"), b, f"_r_{b}")
        one = both.agg(F.lit(a).alias("axis_a"), F.lit(b).alias("axis_b"), correlation(F.col(f"_r_{a}"), F.col(f"_r_{b}")).alias("spearman"), F.count(F.lit(1)).alias("n_both"))
        rows = one if rows is None else rows.unionByName(one)
    sets = first.groupBy("series_id").agg(F.collect_set("axis").alias("axes"))
    counts = sets.agg(*(F.count_if(F.array_contains("axes", a) & F.array_contains("axes", b)).alias(f"{a}|{b}") for a, b in pairs))
    long = counts.unpivot([], counts.columns, "pair", "n").select(F.split("pair", r"\|")[0].alias("axis_a"), F.split("pair", r"\|")[1].alias("axis_b"), (F.col("n") / F.lit(top)).alias("overlap"))
    return rows.join(F.broadcast(long), ["axis_a", "axis_b"])


def alert_totals(marked: DataFrame) -> DataFrame:
    """One row over all series: how many have a reason, how many several, and the volume of those with one."""
    flagged = F.col("n_reasons") > 0
    return marked.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(flagged).alias("n_flagged"),
        F.count_if(F.col("n_reasons") > 1).alias("n_several"),
        F.coalesce(F.avg(flagged.cast("int")), F.lit(0.0)).alias("share_flagged"),
        F.coalesce(F.sum(F.when(flagged, F.col("mean_demand"))) / F.nullif(F.sum("mean_demand"), F.lit(0.0)), F.lit(0.0)).alias("share_volume"),
    )


def missing_reasons(marked: DataFrame) -> list[str]:
    """Reasons that these signals can't tell, for want of forecasts or reorder lines."""
    return [r for r in REASONS if r not in marked.columns]


def chosen(rows: DataFrame, store_id: int | None = None, band: str | None = None, series: Sequence[str] | None = None) -> DataFrame:
    """Rows of a store, of a rotation band, of some series."""
    for c, wanted in (("store_id", store_id), ("rotation_band", band)):
        rows = rows.filter(F.col(c) == wanted) if wanted is not None else rows
    return rows.filter(F.col("series_id").isin(list(series))) if series is not None else rows


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int) -> DataFrame:
    """A page of the rows, each with the number of all of them (total); only that number and the page leave the tasks."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has a row at least and begins at one")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def alerts(marked: DataFrame, index: DataFrame, reason: str | None = None, store_id: int | None = None, band: str | None = None, series: Sequence[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the series with a reason, the most reasons and the largest demand first, with its total; index:
    (series_id, store_id, rotation_band)."""
    if reason is not None and reason not in marked.columns:
        raise ValueError(f"these signals can't tell {reason}")
    rows = marked.filter("n_reasons > 0").join(index.select("series_id", "store_id", "rotation_band"), "series_id", "left")
    rows = chosen(rows.filter(F.col(reason)) if reason else rows, store_id, band, series)
    return page(rows, (F.desc("n_reasons"), F.desc("mean_demand"), "series_id"), limit, offset)


#: Words of a search that stand for words of the labels.
SYNONYMS = {"shop": "store", "outlet": "store", "item": "product", "article": "product", "sku": "product", "group": "category"}


def catalogue_page(index: DataFrame, query: str = "", store_id: int | None = None, band: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the series whose id or label has every word of the query, or what it stands for, by id, with the total;
    index: the hierarchy and rotation_band of each series."""
    rows = chosen(labelled(index), store_id, band)
    text = F.lower(F.concat_ws(" ", "series_id", "label"))
    for word in query.lower().split():
        hit = F.contains(text, F.lit(word))
        for other in sorted({v for k, v in SYNONYMS.items() if word in k}):
            hit = hit | F.contains(text, F.lit(other))
        rows = rows.filter(hit)
    return page(rows, ("series_id",), limit, offset)


def labelled(index: DataFrame) -> DataFrame:
    parts = (F.concat(F.lit(f"{name} "), column) for name, column in (("store", "store_id"), ("category", "third_category_id"), ("product", "product_id")))
    return index.withColumn("label", F.concat_ws(" · ", *parts))


def catalogue_search(index: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Series whose id or label has every word of the query."""
    rows = labelled(index)
    text = F.lower(F.concat_ws(" ", "series_id", "label"))
    for word in query.lower().split():
        rows = rows.filter(F.contains(text, F.lit(word)))
    return rows.orderBy("series_id").offset(offset).limit(limit)
