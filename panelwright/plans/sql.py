"""One text, two engines: queries are written once and rendered for Spark SQL or for the SQL oracle.

Only what the dialects spell differently is a macro: ``@name(a; b)``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import settle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

_MACROS = {
    "pct": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "days": ("CAST(datediff({1}, {0}) AS BIGINT)", "CAST(date_diff('day', {0}, {1}) AS BIGINT)"),
    "addd": ("date_add({0}, {1})", "CAST({0} + {1} * INTERVAL 1 DAY AS DATE)"),
    "known": ("last_value({0}) IGNORE NULLS", "last_value({0} IGNORE NULLS)"),
    "seq": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "each": ("posexplode({0}) AS (i, x)", "unnest(range(len({0}))) AS i, unnest({0}) AS x"),
    "list": ("concat_ws(',', array_sort(collect_list({0})))", "string_agg({0}, ',' ORDER BY {0})"),
    "idiv": ("CAST(floor({0} / {1}) AS BIGINT)", "CAST(floor({0} / {1}) AS BIGINT)"),
    # Rounded off the half steps, where engines differ in the last bit.
    "r": ("(round(CAST({0} AS DOUBLE) + 1e-9, 6) + 0e0)",) * 2,
    "corr": ("(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0e0))",) * 2,
    "n": ("CAST({0} AS BIGINT)",) * 2,
    "weekday": ("weekday({0})", "(isodow({0}) - 1)"),
}
_CALL = re.compile(r"@(\w+)\(")


def render(text: str, engine: int) -> str:
    """Expand macros, innermost arguments too; ``engine`` 0 is Spark."""
    while m := _CALL.search(text):
        depth, args, start = 1, [], m.end()
        i = start
        while depth:
            c = text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if (c == ";" and depth == 1) or depth == 0:
                args.append(text[start:i].strip())
                start = i + 1
            i += 1
        # An argument is an expression of its own, whatever stands around its place.
        text = text[: m.start()] + _MACROS[m[1]][engine].format(*(f"({a})" for a in args)) + text[i:]
    return text


def _uses(text: str, name: str) -> int:
    return len(re.findall(rf"\b(?:FROM|JOIN) {name}\b", text))


class Catalogue:
    """Named queries over common table expressions; a query brings along those it uses.

    ``oracle_views`` and ``oracle_texts`` replace views and whole queries for the
    SQL oracle, ``runs`` replaces texts for Spark by functions of ``Tables``.
    """

    def __init__(self, views: dict[str, str], texts: dict[str, str], oracle_views: dict[str, str] | None = None, oracle_texts: dict[str, str] | None = None, runs: dict | None = None):
        self.views, self.texts = views, texts
        self.oracle_views, self.oracle_texts, self.runs = oracle_views or {}, oracle_texts or {}, runs or {}

    def text(self, body: str, engine: int, given: frozenset[str] = frozenset()) -> str:
        """``body`` with the views it uses, but for those ``given`` as tables, rendered for an engine."""
        views = self.views | self.oracle_views if engine else self.views
        used, todo = [], [body]
        while todo:
            text = todo.pop()
            for v in views:
                if v not in used and _uses(text, v):
                    used.append(v)
                    todo += [] if v in given else [views[v]]
        recursive = "RECURSIVE " if "-- recursive" in body else ""
        body = body.replace("-- recursive", "").strip()
        views = views | {v: f"SELECT * FROM {{{v}}}" for v in given}
        heads = ",\n".join(f"{v} AS ({views[v].strip()})" for v in self._ordered(views, used))
        if body.upper().startswith("WITH "):
            body = body[5:]
            return render(f"WITH {recursive}" + (heads + ",\n" if heads else "") + body, engine)
        return render((f"WITH {recursive}" + heads + "\n" if heads else "") + body, engine)

    @staticmethod
    def _ordered(views: dict[str, str], used: list[str]) -> list[str]:
        out: list[str] = []
        while len(out) < len(used):
            out += [v for v in views if v in used and v not in out and not any(_uses(views[v], u) for u in used if u not in out and u != v)]
        return out

    def repeated(self, body: str) -> list[str]:
        """Views that the expanded query would compute more than once: those over base tables, and others from three times on."""
        times: dict[str, int] = {}

        def count(text: str, n: int) -> None:
            for v in self.views:
                if k := _uses(text, v):
                    times[v] = times.get(v, 0) + n * k
                    count(self.views[v], n * k)

        count(body, 1)
        return [v for v in self.views if times.get(v, 0) >= (2 if any(_uses(self.views[v], t) for t in TABLES) else 3)]

    def frame(self, tables: Tables, body: str) -> DataFrame:
        for v in self.repeated(body):
            tables.kept(v)
        given = tables.given()
        text = self.text(body, 0, frozenset(given))
        base = [t for t in TABLES if _uses(text, t)]
        for name in base:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return tables.spark.sql(text, **{t: tables.base(t) for t in base}, **{v: df for v, df in given.items() if f"{{{v}}}" in text})

    def run(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(self, spark, sf_dir)
        return self.runs[name](tables) if name in self.runs else self.frame(tables, self.texts[name])

    def queries(self) -> dict:
        return {name: (lambda spark, sf_dir, name=name: self.run(name, spark, sf_dir)) for name in [*self.texts, *(n for n in self.runs if n not in self.texts)]}

    def oracle_sql(self) -> dict[str, str]:
        return {name: self.text(body, 1) for name, body in (self.texts | self.oracle_texts).items()}


class Tables:
    """The shared views of one run; ``kept`` ones are computed once and written to the shared folder."""

    def __init__(self, catalogue: Catalogue, spark: SparkSession, sf_dir: str):
        self.catalogue, self.spark, self.sf_dir = catalogue, spark, sf_dir
        self.run_id = uuid.uuid4().hex
        self._base: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._base[name]

    def given(self) -> dict[str, DataFrame]:
        return dict(self._kept)

    def give(self, name: str, df: DataFrame) -> None:
        """``df`` in the place of a view, written to the shared folder."""
        self._kept[name] = settle(df, name)

    def rows(self, name: str = "cal") -> int:
        return self.view(name).count()

    def view(self, name: str) -> DataFrame:
        return self._kept[name] if name in self._kept else self.sql(f"SELECT * FROM {name}")

    def kept(self, name: str) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = settle(self.view(name), name)
        return self._kept[name]

    def sql(self, body: str) -> DataFrame:
        return self.catalogue.frame(self, body)
