"""Bayesian networks over tables: Spark counts rows into tables bounded by states; inference works on those."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import discretise, factors
from ..functions.factors import BayesNet, Factor

Edges = list[tuple[str, str]]
#: Candidate cuts of a supervised discretiser: quantiles of the column, so that the table of counts is bounded.
MAX_CUTS = 1000


def parents(edges: Edges, node: str) -> list[str]:
    return sorted(a for a, b in edges if b == node)


def fit_network(rows: DataFrame, edges: Edges, pseudo: float = 0.0, equivalent: float | None = None) -> BayesNet:
    """CPDs of every node from one grouping-sets aggregation; null states are an error.

    ``pseudo`` is added to each cell (1 is the K2 prior); ``equivalent`` spreads
    an equivalent sample size over a node's cells (BDeu) instead.
    """
    nodes = sorted({n for e in edges for n in e})
    families = {n: [*parents(edges, n), n] for n in nodes}
    sets = list(dict.fromkeys(tuple(f) for f in families.values()))
    flags = [F.grouping(n).alias(f"__g{i}") for i, n in enumerate(nodes)]
    got = rows.select(*nodes).groupingSets([list(s) for s in sets], *nodes).agg(F.count(F.lit(1)).alias("__n"), *flags)
    tables: dict[tuple, dict] = {s: {} for s in sets}
    states: dict[str, set] = {n: set() for n in nodes}
    for r in got.toLocalIterator():  # cells, bounded by the product of a family's states
        family = {n for i, n in enumerate(nodes) if not r[f"__g{i}"]}
        for s in sets:
            if set(s) == family:
                if any(r[n] is None for n in s):
                    raise ValueError(f"null state among {s}")
                tables[s][tuple(r[n] for n in s)] = r["__n"]
                for n in s:
                    states[n].add(r[n])
        if sum(map(len, tables.values())) > factors.MAX_CELLS:
            raise ValueError("too many states for exact CPDs")
    ordered = {n: sorted(v) for n, v in states.items()}
    position = {n: {s: i for i, s in enumerate(v)} for n, v in ordered.items()}
    cpds = {}
    for n, f in families.items():
        c = np.zeros([len(ordered[m]) for m in f])
        for key, count in tables[tuple(f)].items():
            c[tuple(position[m][s] for m, s in zip(f, key, strict=True))] = count
        cpds[n] = Factor(tuple(f), factors.normalise(c, equivalent / c.size if equivalent is not None and c.size else pseudo))
    return BayesNet(ordered, cpds)


def predict(rows: DataFrame, net: BayesNet, node: str) -> DataFrame:
    """Rows with ``<node>_prediction`` and ``<node>_probability``: the likeliest state given the other columns.

    Null or unknown evidence counts as unobserved; ties go to the first state.
    Inference runs once for each distinct evidence, in the tasks that hold it.
    """
    others = [n for n in net.states if n != node and n in rows.columns]
    kind = rows.schema[node].dataType.simpleString() if node in rows.columns else "string"
    label, prob = f"{node}_prediction", f"{node}_probability"
    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in others)
    distinct = rows.select(*others).distinct()

    def infer(batches):
        for pdf in batches:
            best, p = [], []
            for values in pdf[others].itertuples(index=False):
                seen = {n: v for n, v in zip(others, values, strict=True) if v in net.states[n]}
                try:
                    t = factors.query(net, [node], seen).table
                except ValueError:  # evidence that the network rules out says nothing
                    t = factors.query(net, [node]).table
                best.append(net.states[node][int(np.argmax(np.round(t, 12)))])
                p.append(float(t.max()))
            yield pdf.assign(**{label: best, prob: p})

    found = distinct.mapInPandas(infer, f"{fields}, `{label}` {kind}, `{prob}` double")
    renamed = found.select(*(F.col(n).alias(f"__k_{n}") for n in others), label, prob)
    on = [rows[n].eqNullSafe(renamed[f"__k_{n}"]) for n in others]
    return rows.join(renamed, on, "left").drop(*(f"__k_{n}" for n in others))


def sample(spark: SparkSession, net: BayesNet, n: int, seed: int = 0) -> DataFrame:
    """(id, nodes): rows drawn parents first, JVM-side; each node looks its cumulative row up by its parents' states."""
    out = spark.range(n)
    done: list[str] = []
    while len(done) < len(net.states):
        for k, node in enumerate(sorted(net.states)):
            f = net.cpds[node]
            if node in done or set(f.names) - {node} - set(done):
                continue
            flat = f.table.reshape(-1, f.table.shape[-1]).cumsum(1)
            flat[:, -1] = 1.0
            cdf = F.array(*(F.array(*(F.lit(float(p)) for p in row)) for row in flat))
            index = F.lit(0)
            for m, size in zip(f.names[:-1], f.table.shape[:-1], strict=True):
                index = index * size + F.col(f"__{m}")
            u = f"__u{k}"
            out = out.withColumn(u, F.rand(seed * 1009 + k)).withColumn("__row", F.get(cdf, index))
            out = out.withColumn(f"__{node}", F.expr(f"CAST(size(filter(__row, c -> c <= {u})) AS INT)")).drop(u, "__row")
            done.append(node)
    names = sorted(net.states)
    return out.select("id", *(F.get(F.array(*(F.lit(s) for s in net.states[m])), F.col(f"__{m}")).alias(m) for m in names))


def fit_latent(rows: DataFrame, edges: Edges, latent: str, states: int, seed: int = 0, prior: float = 0.1, rounds: int = 200) -> tuple[BayesNet, list[float]]:
    """EM for a node no column shows: one aggregation to distinct blanket rows, then rounds over those."""
    visible = [e for e in edges if latent not in e]
    children = [b for a, b in edges if a == latent]
    blanket = sorted(({a for a, b in edges if b == latent} | set(children) | {a for a, b in edges if b in children}) - {latent})
    counted = rows.dropna(subset=blanket).groupBy(*blanket).count()
    cells = []
    for r in counted.toLocalIterator():
        cells.append(tuple(r))
        if len(cells) > factors.MAX_CELLS:
            raise ValueError("too many states for exact EM")
    if not cells:
        raise ValueError("no complete rows")
    known = {n: sorted({c[i] for c in cells}) for i, n in enumerate(blanket)}
    at = np.array([[known[n].index(c[i]) for i, n in enumerate(blanket)] for c in cells])
    rng = np.random.default_rng(seed)
    all_states = known | {latent: list(range(states))}
    cpds = {}
    for node in [*blanket, latent]:
        pa = parents(edges, node)
        if node == latent or latent in pa:
            shape = [len(all_states[m]) for m in [*pa, node]]
            cpds[node] = Factor((*pa, node), rng.dirichlet(np.ones(shape[-1]) * 5, size=tuple(shape[:-1])))
    net, history = factors.fit_latent(BayesNet(all_states, cpds), latent, at, blanket, np.array([c[-1] for c in cells], float), rounds=rounds, prior=prior)
    rest = [e for e in visible if e[1] not in cpds]
    seen = fit_network(rows.dropna(subset=blanket), rest) if rest else BayesNet({}, {})
    free = [n for n in all_states if n not in net.cpds and n not in seen.cpds]
    for n in free:
        i = blanket.index(n)
        c = np.bincount(at[:, i], weights=[x[-1] for x in cells], minlength=len(known[n]))
        net.cpds[n] = Factor((n,), factors.normalise(c))
    return BayesNet(seen.states | all_states, {k: v for k, v in seen.cpds.items() if k not in net.cpds} | net.cpds), history


def supervised_cuts(rows: DataFrame, column: str, target: str, method: str = "mdlp", depth: int = 2) -> list[float]:
    """Split points of a column that tell the target's classes apart: ``mdlp`` or a Gini ``tree``.

    Rows are counted per class at each of at most MAX_CUTS quantile bins; a bin
    stands for its largest value.  A column with fewer distinct values keeps them all.
    """
    clean = rows.select(F.col(column).cast("double").alias("v"), F.col(target).alias("t")).dropna()
    edges = clean.agg(F.array_distinct(F.percentile_approx("v", [i / MAX_CUTS for i in range(1, MAX_CUTS + 1)], 100000)).alias("q")).first()["q"]
    if not edges:
        return []
    kind = clean.schema["t"].dataType.simpleString()

    def partial(batches):
        for pdf in batches:
            b = np.searchsorted(edges, pdf["v"].to_numpy())
            yield pdf.assign(b=b).groupby(["b", "t"]).size().rename("n").reset_index()

    got = clean.mapInPandas(partial, f"b long, t {kind}, n long").groupBy("b", "t").agg(F.sum("n").alias("count")).toPandas()
    table = got.pivot(index="b", columns="t", values="count").fillna(0).sort_index()
    tops = np.array([edges[min(int(b), len(edges) - 1)] for b in table.index], float)
    counts = table.to_numpy()
    return discretise.mdlp(tops, counts) if method == "mdlp" else discretise.tree_cuts(tops, counts, depth)


_EDGES: Edges = [("qty", "flag"), ("disc", "flag"), ("flag", "status")]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.when(F.col("l_quantity") < 17, 0).when(F.col("l_quantity") < 34, 1).otherwise(2).alias("qty"),
        F.when(F.col("l_discount") < 0.03, 0).when(F.col("l_discount") < 0.07, 1).otherwise(2).alias("disc"),
    )


def _tall(spark: SparkSession, found: dict[str, np.ndarray], net: BayesNet) -> DataFrame:
    rows = [(n, str(s), float(p)) for n in sorted(found) for s, p in zip(net.states[n], found[n], strict=True)]
    return spark.createDataFrame(rows, "node string, state string, p double")


def _marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = fit_network(_lineitem(spark, sf_dir), _EDGES)
    return _tall(spark, factors.marginals(net, {"status": net.states["status"][0]}), net)


def _after_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = fit_network(_lineitem(spark, sf_dir), _EDGES)
    return _tall(spark, factors.marginals(factors.intervene(net, "flag", {net.states["flag"][0]: 1.0})), net)


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir)
    found = predict(rows, fit_network(rows, _EDGES, pseudo=1.0), "flag")
    return found.groupBy("flag", "flag_prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("flag_probability").alias("mean_probability"))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, fit_network(_lineitem(spark, sf_dir), _EDGES), 10_000)


def _latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, _ = fit_latent(_lineitem(spark, sf_dir), [("z", "flag"), ("z", "status"), ("z", "qty")], "z", 2)
    return _tall(spark, factors.marginals(net), net)


def _cuts(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")))
        cuts = supervised_cuts(rows, "day", "l_linestatus", method)
        return spark.createDataFrame(pd.DataFrame({"k": range(len(cuts)), "cut": cuts}).astype({"k": "int64", "cut": "float64"}), "k long, cut double")

    return run


def queries() -> dict:
    return {"bn_marginals_given": _marginals, "bn_marginals_do": _after_do, "bn_predict_any": _predicted, "bn_draw": _sampled, "bn_em_latent": _latent, "discretise_mdlp": _cuts("mdlp"), "discretise_tree": _cuts("tree")}
