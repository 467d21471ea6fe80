"""One entry point to all searches by the name of a system."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import dense, graph, ivf, late, lexical

# Parameters of the client's systems unless given.
DEFAULTS = {
    "fts": {"mode": "or", "ranking": "bm25c"},
    "graph": {"ef": 64, "beam": 16},
    "ivf": {"nprobe": 16, "rerank_k": 64, "rerank": True},
    "exact": {},
    "late": {"nprobe": 8, "rerank": 64},
    "snapshot": {},
}
#: Options of late searches by the type of their values; others in a list of options are ignored.
OPTIONS = {"k": int, "nprobe": int, "layout": str, "approx": str, "ndocs": int, "impute": int, "cross": int, "rerank": int, "tcs": float, "stoplist": float, "cprobe": int}


def parse_options(text: str | None) -> dict:
    """Options of "key=value" parts separated by blanks, commas or semicolons; what isn't known is ignored,
    a value that isn't a number counts as 0."""
    found = dict(part.split("=", 1) for part in re.split(r"[ ,;]+", text or "") if "=" in part)
    out: dict = {}
    for name in OPTIONS.keys() & found.keys():
        kind = OPTIONS[name]
        number = re.match(r"[+-]?\d+" if kind is int else r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", found[name])
        out[name] = found[name] if kind is str else kind(number[0]) if number else kind(0)
    return out


class SearchSession:
    """Registered tables and indexes by name; ``search`` picks one by name or by kind.

    Kinds: fts (documents or a TextIndex), exact (vectors), graph (a GraphIndex), ivf (an IvfIndex),
    late (coded tokens and centroids), snapshot (a Snapshot). Of several, an exact name goes first;
    "dense" prefers a graph.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.systems: dict[str, tuple[str, object]] = {}

    def register(self, name: str, kind: str, what: object) -> None:
        if kind not in DEFAULTS:
            raise ValueError(f"unknown kind {kind}")
        self.systems[name] = (kind, what)

    def resolve(self, system: str) -> str:
        if system in self.systems:
            return system
        kinds = ("graph", "ivf", "snapshot", "exact") if system == "dense" else (system,)
        for kind in kinds:
            for name, (own, _) in self.systems.items():
                if own == kind:
                    return name
        raise KeyError(f"no system {system}")

    def search(self, queries: DataFrame, system: str, k: int = 10, **parameters) -> DataFrame:
        kind, what = self.systems[self.resolve(system)]
        options = DEFAULTS[kind] | parameters
        if kind == "fts":
            return lexical.search(what, queries, k, **options)
        if kind == "exact":
            return dense.exact_search(what, queries, k, **options)
        if kind == "graph":
            return graph.search(what, queries, k, **options)
        if kind == "snapshot":
            return what.search(queries, k, **options)
        if kind == "ivf":
            return ivf.search(what, queries, k, **options)
        coded, centroids = what
        options = {n: bool(v) if n in ("impute", "cross") else v for n, v in options.items()}
        if options.pop("layout", "warp") == "plaid":
            options.pop("rerank", None)
            return late.plaid(coded, queries, centroids, k, **options)
        options.pop("approx", None), options.pop("ndocs", None)
        return late.warp(coded, queries, centroids, k, **options)


def register_functions(spark: SparkSession) -> None:
    """SQL functions for vectors: dot_product, l2_squared, cosine_distance."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_squared(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
