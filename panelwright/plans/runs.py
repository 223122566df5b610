"""Catalogue queries as calls of the library on the shared views: what is fixed here is the fixture, not the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs, panels, portfolio, rolling, selection
from ..sources.files import pending_windows, read_windows, write_windows
from ..sources.store import shared_dir
from .fixtures import STEP, W
from .sql import Tables

HOLD, BURN, PERIODS = 21, 26, 52
LEAST_EDGE = 0.12
REPLICATES, BLOCK = 200, 10


def r6(c: Column | str) -> Column:
    """Rounded off the half steps, as the texts' ``@r``."""
    return F.round(F.col(c).cast("double") + 1e-9 if isinstance(c, str) else c.cast("double") + 1e-9, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def rolled(t: Tables) -> DataFrame:
    return rolling.roll(t.kept("panel"), t.rows(), W, STEP)


def _role(t: Tables, role: str) -> DataFrame:
    return t.kept("panel").filter(F.col("role") == role)


def _moments(t: Tables, lag: int) -> DataFrame:
    return rolling.pair_moments(t.kept("panel"), t.kept("panel"), t.rows(), W, STEP, lag)


def lagged(t: Tables) -> DataFrame:
    """(w, src, dst, rs, rd, rho): lag-1 correlations, kept for the run."""
    if "lagged" not in t.given():
        role = t.kept("panel").select("name", "role").distinct()
        of = lambda end, out: F.broadcast(role.withColumnsRenamed({"name": end, "role": out}))
        rho = _moments(t, 1).select("w", F.col("a").alias("src"), F.col("b").alias("dst"), rolling.correlation().alias("rho"))
        t.give("lagged", rho.join(of("src", "rs"), "src").join(of("dst", "rd"), "dst").select("w", "src", "dst", "rs", "rd", "rho"))
    return t.view("lagged")


def edges(t: Tables) -> DataFrame:
    return graphs.threshold(lagged(t).filter("src <> dst").withColumn("weight", F.round("rho", 6)), LEAST_EDGE)


def dag(t: Tables) -> DataFrame:
    if "dag" not in t.given():
        t.give("dag", edges(t).filter("src < dst").select("w", "src", "dst", "weight"))
    return t.view("dag")


def _windows(t: Tables) -> DataFrame:
    return t.spark.range(rolling.count_windows(t.rows(), W, STEP)).select(F.col("id").alias("w"))


def _scores(t: Tables) -> DataFrame:
    """(w, name, score, k): drivers by their absolute lag-1 correlations."""
    found = lagged(t).filter("rs = 'driver' and rd = 'asset'").groupBy("w", F.col("src").alias("name")).agg(r6(F.sum(F.abs("rho"))).alias("score"))
    return selection.top(found, 1 << 20)


def _cumulative(t: Tables) -> DataFrame:
    rho = selection.correlations(_role(t, "driver"), _role(t, "asset"), t.rows(), W, STEP)
    return selection.cumulative_scores(rho).withColumn("score", r6("score"))


def _p_values(t: Tables) -> DataFrame:
    drivers = rolled(t).filter("role = 'driver'").withColumn("key", F.substring("name", 2, 9).cast("long"))
    null = selection.null_scores(selection.shuffled(drivers, 19, ["w", "name"]), rolled(t).filter("role = 'asset'"))
    return rounded(selection.monte_carlo_p(_cumulative(t), null), "p")


def _rewards(t: Tables) -> DataFrame:
    """(w, reward): the Sharpe ratio of equal weights over the step after a window."""
    port = t.view("port").join(t.kept("cal"), "d")
    held = portfolio.holding(port, _windows(t).select((F.col("w") * STEP + W - 1).alias("r")), STEP)
    return held.groupBy(((F.col("reb") - (W - 1)) / STEP).cast("long").alias("w")).agg(portfolio.sharpe(F.col("g"), PERIODS).alias("reward"))


def _credits(t: Tables) -> DataFrame:
    chosen = _scores(t).filter("k <= 3").select("w", "name")
    s = lagged(t).filter("rs = 'driver' and rd = 'asset'").select("w", F.col("src").alias("name"), F.col("dst").alias("asset"), F.col("rho").alias("s")).join(chosen, ["w", "name"])
    n = t.view("names").count()
    weights = _windows(t).crossJoin(t.view("names").select(F.col("name").alias("asset"))).withColumn("weight", F.lit(1 / max(n, 1)))
    return portfolio.credit(weights, s, _rewards(t))


def _utility(t: Tables) -> DataFrame:
    return portfolio.carried_utility(_credits(t), _windows(t))


def _cap_weights(t: Tables) -> DataFrame:
    """(r, name, w): cap weights at every HOLD-th row."""
    marks = panels.every_nth(t.kept("cal"), HOLD, 0)
    return t.view("capw").join(marks, "d").select("r", "name", "w")


def _simple(t: Tables) -> DataFrame:
    return t.view("ret").filter("v is not null").join(t.kept("cal"), "d").select("r", "name", (F.exp("v") - 1).alias("v"))


def _backtest(t: Tables) -> tuple[DataFrame, DataFrame]:
    return portfolio.backtest(_cap_weights(t), _simple(t), HOLD, 5.0, PERIODS)


def _held(t: Tables) -> DataFrame:
    """(reb, d, name, v): holding periods of HOLD rows from row BURN on."""
    rows = t.view("ret").filter("v is not null").join(t.kept("cal"), "d")
    marks = panels.every_nth(t.kept("cal"), HOLD, BURN)
    return portfolio.holding(rows, marks, HOLD).withColumn("reb", ((F.col("reb") - BURN) / HOLD).cast("long"))


def _both(t: Tables) -> DataFrame:
    """(d, g, h): cap and equal weights side by side."""
    return t.view("capport").select("d", "g").join(t.view("port").select("d", F.col("g").alias("h")), "d")


def _asof(days: int):
    def run(t: Tables) -> DataFrame:
        monthly = t.kept("monthly")
        asked = t.kept("cal").select("d").crossJoin(monthly.select("name").distinct())
        return panels.asof(asked, monthly, "name", "v", "d", "m", days).select("d", "name", r6("v").alias("v"))

    return run


def _grid(t: Tables) -> DataFrame:
    return panels.spine(t.kept("days"), t.view("names"), t.kept("daily"))


def _checkpoint(t: Tables) -> DataFrame:
    """Windows that a store with the even ones' edges still lacks."""
    path = f"{shared_dir(t.spark)}/windows-{t.run_id}"
    write_windows(edges(t).filter("w % 2 = 0").select("w", "src", "dst", "weight"), path)
    return pending_windows(_windows(t), read_windows(t.spark, path, "src string, dst string, weight double, w long"))


def _bins(column: str, method: str, **options):
    def run(t: Tables) -> DataFrame:
        rows = t.base("lineitem")
        cuts = panels.cuts_by(rows, column, method, **options)
        return rows.groupBy(panels.bin_of(F.col(column).cast("double"), cuts).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    return run


def _regimes(t: Tables) -> DataFrame:
    volume = t.kept("px").groupBy("d").agg(F.sum("volume").alias("v"))
    mid = F.broadcast(volume.agg(F.percentile("v", F.lit(0.5)).alias("m")))
    return volume.crossJoin(mid).select("d", F.when(F.col("v") > F.col("m"), "busy").otherwise("calm").alias("regime"))


def _masks(t: Tables) -> DataFrame:
    port = t.kept("port").select("d", F.round("g", 9).alias("v"))
    found = portfolio.quantile_masks(port).withColumn("x", F.lit(True))
    low, high = (found.filter(F.col("regime") == k).select("d", F.col("x").alias(k)) for k in ("low", "high"))
    return port.select("d").join(low, "d", "left").join(high, "d", "left").na.fill(False, ["low", "high"])


def _graph_pair(t: Tables) -> DataFrame:
    rho = _moments(t, 0).filter("a < b").select("w", F.col("a").alias("src"), F.col("b").alias("dst"), F.round(rolling.correlation(), 6).alias("weight"))
    return graphs.compare(edges(t).select("w", "src", "dst", "weight"), graphs.threshold(rho, LEAST_EDGE))


def _moments_of_names(t: Tables) -> DataFrame:
    return rolled(t).groupBy("w", "name").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def _replicates(t: Tables) -> int:
    return rolling.count_windows(t.rows(), W, STEP)


def _names(t: Tables) -> int:
    return t.kept("panel").select("name").distinct().count()


def _whole(t: Tables) -> DataFrame:
    n = t.rows()
    found = rolling.pair_moments(t.kept("panel"), t.kept("panel"), n, n, n).filter("a < b and n >= 10")
    return found.select("a", "b", r6(rolling.correlation()).alias("rho"), "n")


_SMALL = "w", "src", "dst"
RUNS = {
    "log_return_panel": lambda t: rounded(panels.change(t.view("px"), "log"), "v"),
    "simple_return_panel": lambda t: rounded(panels.change(t.view("px"), "simple"), "v"),
    "first_difference": lambda t: rounded(panels.change(t.view("px"), "diff"), "v"),
    "level_passthrough": lambda t: rounded(panels.change(t.view("px"), "level"), "v"),
    "yoy_pct_monthly": lambda t: rounded(panels.year_over_year(t.kept("monthly"), "pct", when="m", value="v"), "yoy"),
    "yoy_diff_monthly": lambda t: rounded(panels.year_over_year(t.kept("monthly"), "diff", when="m", value="v"), "yoy"),
    "ffill_limit5": lambda t: rounded(panels.forward_fill(_grid(t), 5), "price"),
    "asof_within_5_rows": lambda t: rounded(panels.forward_fill(_grid(t), 4), "price"),
    "spine_join": lambda t: rounded(_grid(t), "price"),
    "asof_macro_daily": _asof(0),
    "asof_gap_lookup": _asof(-21),
    "asof_forward_leak": _asof(21),
    "derived_spread_ratio": lambda t: rounded(panels.spread_and_ratio(t.kept("px"), "A0", "A1"), "spread", "ratio"),
    "availability_gate": lambda t: rounded(panels.available(t.view("px"), "1997-01-01"), "price").select("d", "name", "price"),
    "backend_cascade": lambda t: rounded(panels.first_source([t.kept("px").filter("volume > 500"), t.kept("px")], ["d", "name"]), "price").select("d", "name", "price", "src"),
    "joint_drop_any": lambda t: rounded(panels.complete_dates(t.kept("daily"), t.view("names")), "price"),
    "joint_eligibility": lambda t: rounded(panels.eligibility(t.view("px"), t.kept("raw")), "price"),
    "eligible_in_window": lambda t: rolling.fully_observed(t.kept("daily").join(t.kept("days"), "d"), t.view("names"), t.rows("days"), 40, 20),
    "sparse_asset_drop": lambda t: panels.dense_series(t.kept("daily"), t.view("days")),
    "coverage_report": lambda t: rounded(panels.coverage(t.kept("daily"), t.view("names")), "coverage").select("d", "resolved", "coverage", "short"),
    "rolling_windows": lambda t: rolling.window_table(rolled(t)),
    "zscore_window": lambda t: rounded(rolling.window_zscore(rolled(t)), "z").select("w", "r", "name", "z"),
    "standardise_global": lambda t: rounded(panels.standardise(t.view("ret").filter("v is not null")), "z").select("d", "name", "z"),
    "rolling_cov": lambda t: _moments(t, 0).filter("a < b").select("w", "a", "b", r6(rolling.covariance()).alias("cov")),
    "rolling_corr": lambda t: _moments(t, 0).filter("a < b").select("w", "a", "b", r6(rolling.correlation()).alias("rho")),
    "pairwise_complete_corr": _whole,
    "lagged_design": lambda t: rounded(panels.lagged(t.view("panel"), [1, 2]), "lagged_v").select("r", "name", "k", "lagged_v"),
    "var_moments": lambda t: _moments(t, 1).select("w", "a", "b", r6(F.col("sxy") * 1000).alias("xy")),
    "realisation_cut": lambda t: panels.realisations(t.kept("daily"), t.view("days")),
    "chronological_split": lambda t: panels.chronological_split(t.view("panel")),
    "every_nth_row": lambda t: panels.every_nth(t.view("cal"), 13, BURN),
    "overlap_guard": lambda t: panels.overlap(t.view("ret"), t.view("dret")).withColumnsRenamed({"a": "asset", "b": "driver"}),
    "ticker_normalise": lambda t: t.base("supplier").select("s_name", panels.normal_ticker(F.replace("s_name", F.lit("#"), F.lit("."))).alias("ticker")).distinct(),
    "symbol_clean": lambda t: t.sql("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey").select(panels.clean_symbol(F.replace("s_name", F.lit("#"), F.lit("["))).alias("symbol"), "n_name").distinct(),
    "trailing_window": lambda t: rolling.trailing(t.view("panel"), t.rows(), W // 2, HOLD).groupBy("reb", "name").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"), F.count(F.lit(1)).alias("n")),
    "cumcorr_topk": lambda t: selection.top(_cumulative(t), 3).withColumn("k", F.col("k").cast("long")),
    "stage_a_scores": lambda t: rounded(selection.stage_a(lagged(t).filter("rs = 'driver' and rd = 'asset'").withColumn("weight", F.col("rho"))), "score"),
    "alpha_blend_pool": lambda t: rounded(selection.blend(_scores(t).select("w", "name", "score"), _utility(t).withColumn("w", F.col("w") + 1)), "blended"),
    "kneedle_k": lambda t: selection.knee(_scores(t).drop("k")),
    "mc_pvalues": _p_values,
    "bh_fdr": lambda t: selection.step_up(_p_values(t), 0.1),
    "selected_jaccard": lambda t: rounded(selection.selected_jaccard(_scores(t).filter("k <= 2")), "jaccard"),
    "checkpoint_resume": _checkpoint,
    "equal_weight_nav": lambda t: rounded(portfolio.wealth(t.view("port")), "g", "nav").select("d", "g", "nav"),
    "cap_weight_nav": lambda t: rounded(portfolio.wealth(t.view("capport")), "g", "nav").select("d", "g", "nav"),
    "holding_returns": lambda t: _held(t).groupBy("reb", "d").agg(r6(F.avg(F.exp("v") - 1)).alias("gross")),
    "holding_reward": lambda t: _held(t).groupBy("reb", "d").agg(F.avg(F.exp("v") - 1).alias("g")).groupBy("reb").agg(r6(portfolio.sharpe(F.col("g"), PERIODS)).alias("reward")),
    "turnover": lambda t: rounded(portfolio.turnover(_cap_weights(t)), "turnover"),
    "net_of_costs": lambda t: rounded(_backtest(t)[0], "gross", "net"),
    "backtest_summary": lambda t: rounded(_backtest(t)[1], "gross", "net", "turnover", "reward"),
    "performance_summary": lambda t: rounded(portfolio.performance(t.kept("port"), _cap_weights(t), periods=PERIODS), "sharpe", "sortino", "cagr", "vol", "downside", "cer_1", "cer_3", "cer_5", "mdd", "calmar", "hhi", "effective_n", "max_weight", "turnover"),
    "sortino": lambda t: t.view("port").agg(r6(portfolio.sortino(F.col("g"), PERIODS)).alias("sortino")),
    "certainty_equivalent": lambda t: t.kept("port").agg(*(portfolio.certainty_equivalent(F.col("g"), k, PERIODS).alias(f"c{k}") for k in (1, 3, 5))).select(F.explode(F.array(*(F.struct(F.lit(k).alias("gamma"), r6(f"c{k}").alias("cer")) for k in (1, 3, 5)))).alias("x")).select("x.*"),
    "max_drawdown": lambda t: portfolio.wealth(t.view("port")).agg(r6(F.min("fall")).alias("mdd")),
    "calmar": lambda t: portfolio.wealth(t.view("port")).agg(portfolio.growth(F.col("g"), PERIODS).alias("a"), F.min("fall").alias("m")).select(r6(portfolio.calmar(F.col("a"), F.col("m"))).alias("calmar")),
    "time_underwater": lambda t: portfolio.longest_underwater(portfolio.wealth(t.view("port"))),
    "hhi_effective_n": lambda t: t.view("capw").groupBy("d").agg(r6(portfolio.herfindahl(F.col("w"))).alias("hhi"), r6(portfolio.effective_number(F.col("w"))).alias("effective_n"), r6(F.max("w")).alias("max_weight")),
    "regime_masks": _masks,
    "regime_summary": lambda t: rounded(portfolio.by_regime(t.kept("port"), _regimes(t), {"sharpe": lambda g: portfolio.sharpe(g, PERIODS)}), "sharpe"),
    "stationary_bootstrap": lambda t: portfolio.resampled(t.kept("port"), ["g"], 40, BLOCK).groupBy("b").agg(r6(F.avg("g")).alias("mean")),
    "bootstrap_sharpe_ci": lambda t: rounded(portfolio.bootstrap_interval(t.kept("port"), lambda g: portfolio.sharpe(g, PERIODS), REPLICATES, BLOCK), "estimate", "lo", "hi"),
    "bootstrap_sharpe_difference": lambda t: rounded(portfolio.bootstrap_difference(_both(t), "g", "h", lambda g: portfolio.sharpe(g, PERIODS), REPLICATES, BLOCK), "estimate", "lo", "hi", "p"),
    "sharpe_difference": lambda t: _both(t).agg(r6(portfolio.sharpe(F.col("g"), PERIODS) - portfolio.sharpe(F.col("h"), PERIODS)).alias("diff")),
    "credit_attribution": lambda t: rounded(_credits(t), "influence", "credit"),
    "ema_utility": lambda t: rounded(_utility(t), "u"),
    "edge_threshold": lambda t: rounded(graphs.threshold(edges(t), 0.2), "weight").select(*_SMALL, "weight"),
    "graph_density": lambda t: rounded(graphs.density(edges(t), _names(t)), "density", "mean_weight"),
    "graph_distance": lambda t: rounded(graphs.frobenius(graphs.beside_previous(edges(t), _windows(t))), "dist"),
    "edge_jaccard": lambda t: rounded(graphs.edge_jaccard(graphs.beside_previous(edges(t), _windows(t))), "jaccard"),
    "graph_compare": lambda t: rounded(_graph_pair(t), "frobenius", "jaccard", "sign_agreement", "weight_corr"),
    "regime_change_flags": lambda t: graphs.flags(graphs.frobenius(graphs.beside_previous(lagged(t).withColumn("weight", F.col("rho")), _windows(t)))).select("w", "flagged"),
    "sector_flow": lambda t: rounded(graphs.sector_flow(edges(t), t.kept("sectors")), "flow"),
    "kendall_drift": lambda t: rounded(graphs.kendall(_scores(t)), "tau"),
    "edge_probability": lambda t: rounded(graphs.edge_probability(lagged(t).filter("src <> dst").withColumn("weight", F.col("rho")), _replicates(t), LEAST_EDGE), "prob"),
    "direction_counts": lambda t: graphs.direction_counts(edges(t), 3),
    "dag_counts": lambda t: graphs.dag_counts(graphs.threshold(edges(t), 0.2)),
    "common_edges": lambda t: graphs.common_edges(edges(t), 5),
    "total_effect_paths": lambda t: rounded(graphs.total_effects(dag(t)), "effect"),
    "total_effect_summary": lambda t: rounded(graphs.effect_summary(graphs.total_effects(dag(t)), _replicates(t)), "prob", "median"),
    "distance_from_roots": lambda t: graphs.depths(dag(t)),
    "markov_blanket": lambda t: graphs.markov_blanket(dag(t)),
    "shd_accuracy": lambda t: rounded(graphs.accuracy(edges(t).filter("src < dst or weight > 0.2"), dag(t).filter("w = 0"), _names(t)), "fdr", "tpr", "fpr", "precision"),
    "block_slice": lambda t: edges(t).groupBy("w", "rs", "rd").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.abs("weight"))).alias("total")),
    "path_probability": lambda t: rounded(graphs.path_summary(graphs.paths(dag(t), "A0", "D5"), _replicates(t)), "prob", "effect"),
    "path_total_effect": lambda t: rounded(graphs.paths(dag(t), "A0", "D5"), "effect"),
    "common_edge_across": lambda t: rounded(graphs.common_probability(edges(t), _windows(t).select("w", (F.col("w") % 3).alias("g"))), "prob"),
    "common_edge_per": lambda t: rounded(graphs.common_probability(edges(t), _windows(t).select("w", (F.col("w") % 3).alias("g"), F.floor(F.col("w") / 3).alias("i")), "per"), "prob"),
    "exogenous_and_sinks": lambda t: graphs.roles(dag(t)),
    "target_subgraph": lambda t: rounded(graphs.target_subgraph(graphs.threshold(edges(t), 0.25), "A0"), "weight").select(*_SMALL, "weight"),
    "intervention_effect": lambda t: rounded(graphs.interventions(graphs.total_effects(dag(t)), _moments_of_names(t)), "raised", "lowered"),
    "discretise_uniform": _bins("l_quantity", "uniform", n=4),
    "discretise_quantile": _bins("l_extendedprice", "percentiles", points=[0.333, 0.667]),
    "discretise_outlier": _bins("l_extendedprice", "outlier", share=0.05),
    "discretise_percentiles": _bins("l_extendedprice", "percentiles", points=[0.1, 0.5, 0.9]),
}
