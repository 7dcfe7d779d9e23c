"""Whole jobs: the composed data flows an application would run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import capacity as C
from ..operators import outliers as O
from ..operators import patterns as P
from ..operators import telemetry as M
from ..operators import text as X
from ..session import materialize
from ..sources import metric_lines as L
from ..sources import records as R


def word_count_job(texts: DataFrame, text: str = "text") -> DataFrame:
    return X.word_count(X.tokenize(texts, text))


def pattern_job(lines: DataFrame, dictionary: DataFrame, threshold: int, text: str = "text") -> DataFrame:
    """Signed sentences (seq, ``+``/``-`` text) to maximal frequent patterns with their words."""
    signed = R.parse_signed(lines, text)
    baskets = P.basket_ids(X.basket_words(signed, "sentence", ["seq", "is_add"]), dictionary)
    frequent = P.frequent_patterns(P.net_baskets(baskets), threshold)
    return P.pattern_words(P.maximal_patterns(frequent), dictionary)


def outlier_job(lines: DataFrame, object_count: int, rows: Sequence[Sequence[float]], distance: float, min_neighbors: int, text: str = "text") -> DataFrame:
    """Object lines to one flag per object: outlier in any projection of its last position."""
    last = O.latest_objects(R.parse_object(lines, object_count, text))
    flags = O.outlier_snapshot(O.project_vectors(last, rows), distance, min_neighbors)
    return O.outlier_merge(flags, len(rows), ["seq", "id"])


def load_job(lines: DataFrame, cluster: DataFrame, interval_s: float, history: int = 4, strict: bool = True, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Timed report lines to the current and the historic load of each component.

    ``cluster(component, task)`` names the deployed tasks. Each report stays in
    force until its task reports again. Columns as in ``service_load`` plus ``cycle``.
    """
    reports = L.parse_window(lines, text, strict=strict).withColumnRenamed("time", "cycle")
    known = M.known_components(reports, cluster)
    filled = M.snapshot_ffill(known, ["component", "task", "type"])
    rows = M.measurements(filled, ["component", "task", "type", "cycle"])
    rolled = materialize(M.component_rollup(rows, ["cycle"]))
    tasks = cluster.groupBy("component").count().withColumnRenamed("count", "n_tasks")
    past = M.rolling_history(rolled, ["component", "type", "metric", "stream"], size=history)
    return C.service_load(rolled, tasks, interval_s, ("cycle",)), C.service_load(past, tasks, interval_s, ("cycle",))
