"""Approximate nearest neighbours with balanced posting lists and in-memory graphs over their centroids, on two levels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, table

TOP = 20
QUERY_STRIDE = 20
DRAWS = 1 << 30


@dataclass(frozen=True)
class AnnSettings:
    """Sizes and ratios of the index.

    There is a list for every ``list_size`` distinct vectors, however large the table. Lists lie in cells, about as
    many cells as lists in a cell, so the driver holds a number of centroids that grows with the square root of the
    table. Centroids of either level are fitted on about ``sample`` vectors each; every vector is indexed. A vector
    goes to its nearest cell, and in a cell to its nearest list; the ``boundary`` share of the vectors whose second
    cell (or list) is least farther than the first, as a ratio, goes to both. A query reads the lists within a ratio of its nearest list's
    distance. That ratio is the least with which ``probes`` calibration queries, held against all vectors,
    find a share of ``coverage`` of their true neighbours. ``part`` and ``block`` bound the vectors and queries of
    one task's group.
    """

    list_size: int = 100
    sample: int = 64
    rounds: int = 12
    boundary: float = 0.15
    degree: int = 16
    beam: int = 12
    probes: int = 256
    coverage: float = 0.94
    part: int = 16384
    block: int = 16384


def usable(vec: Column) -> Column:
    """True for a vector that takes part: not null, not zero, every component finite."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def lift(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Add a component that gives every vector the largest norm: nearest then means largest inner product."""
    rest = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.hstack((vectors, rest[:, None]))


def level(queries: np.ndarray, largest: float) -> np.ndarray:
    """Queries scaled to the largest norm, with a zero for the added component."""
    scaled = queries * (largest / np.linalg.norm(queries, axis=1))[:, None]
    return np.hstack((scaled, np.zeros((len(queries), 1))))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of clusters of similar size, and the sizes, in the order of the centroids' main direction.

    Lloyd rounds; after each, clusters of over 1.5 times the mean size give a second centre to the place of a
    cluster under half of it. Further rounds, few at most, do only that until no cluster is over twice the mean.
    """
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    mean = len(sample) / k
    for i in range(3 * rounds):
        near = np.concatenate([squared_distances(s, centroids).argmin(axis=1) for s in np.array_split(sample, -(-len(sample) // 4096))])
        sizes = np.bincount(near, minlength=k)
        if i >= rounds and sizes.max() <= 2 * mean:
            break
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        filled = sizes > 0
        centroids[filled] = sums[filled] / sizes[filled, None]
        if i == 3 * rounds - 1:
            break
        spare = np.argsort(sizes, kind="stable").tolist()
        for full in np.argsort(-sizes, kind="stable").tolist():
            if not spare or sizes[full] <= 1.5 * mean or full == spare[0] or sizes[full] < 2:
                break
            own = sample[near == full]
            along = (own - own.mean(axis=0)) @ rng.standard_normal(sample.shape[1])
            upper = along > np.median(along)
            if 0 < upper.sum() < len(own):
                place = spare.pop(0)
                centroids[full], centroids[place] = own[~upper].mean(axis=0), own[upper].mean(axis=0)
    middle = centroids - centroids.mean(axis=0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    return centroids[order], sizes[order]


class CentroidGraph:
    """Neighbour graph over centroids, walked best-first from a few entries for many queries at a time.

    Every part of the graph has an entry, as no walk from elsewhere reaches well separated clusters.
    """

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids
        n = len(centroids)
        near = np.vstack(
            [np.argsort(squared_distances(c, centroids), axis=1, kind="stable")[:, : degree + 1] for c in np.array_split(centroids, -(-n // 1024))]
        )
        linked = [set(row) - {i} for i, row in enumerate(near.tolist())]
        for i, row in enumerate(near.tolist()):
            for j in row:
                linked[j].add(i)
        linked = [s - {i} for i, s in enumerate(linked)]
        self.links = np.full((n, max(map(len, linked), default=0) or 1), -1)
        for i, s in enumerate(linked):
            self.links[i, : len(s)] = sorted(s)
        entries, reached = [], np.zeros(n, bool)
        for i in [*np.unique(np.linspace(0, n - 1, min(8, n)).astype(int)).tolist(), *range(n)]:
            if len(entries) < min(8, n) or not reached[i]:
                entries.append(i)
                todo = [i]
                while todo:
                    fresh = [j for j in linked[todo.pop()] if not reached[j]]
                    reached[fresh] = True
                    todo += fresh
                reached[i] = True
        self.entries = np.unique(entries)

    def search(self, queries: np.ndarray, ratio: float, beam: int, slack: float = 0.0) -> np.ndarray:
        """Distances from each query to the centroids that its walk has seen; infinite for all others.

        A walk goes on from the nearest centroid it has not left yet while that is among the ``beam`` nearest it
        has seen, or within ``ratio`` times the least distance plus ``slack``.
        """
        m, n = len(queries), len(self.centroids)
        d = np.full((m, n), np.inf)
        d[:, self.entries] = np.sqrt(squared_distances(queries, self.centroids[self.entries]))
        left = np.zeros((m, n), bool)
        active = np.arange(m)
        while len(active):
            ahead = np.where(left[active], np.inf, d[active])
            at = ahead.argmin(axis=1)
            here = ahead[np.arange(len(active)), at]
            seen = d[active]
            edge = ratio * seen.min(axis=1) + slack
            if n > beam:
                edge = np.maximum(edge, np.partition(seen, beam - 1, axis=1)[:, beam - 1])
            go = np.isfinite(here) & (here <= edge)
            active, at = active[go], at[go]
            left[active, at] = True
            row, col = np.nonzero(self.links[at] >= 0)
            row, node = active[row], self.links[at[row], col]
            fresh = np.isinf(d[row, node])
            row, node = row[fresh], node[fresh]
            apart = self.centroids[node] - queries[row]
            d[row, node] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        return d


def two_nearest(vectors: np.ndarray, graph: CentroidGraph, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest centroid of each vector, and how many times as far the second is."""
    lists, ratios = [], []
    for low in range(0, len(vectors), 1024):
        d = graph.search(vectors[low : low + 1024], 1.0, beam)
        if d.shape[1] == 1:
            d = np.hstack((d, np.full((len(d), 1), np.inf)))
        best = np.argpartition(d, 1, axis=1)[:, :2]
        near = np.take_along_axis(d, best, axis=1)
        swap = near[:, 0] > near[:, 1]
        best[swap], near[swap] = best[swap, ::-1], near[swap, ::-1]
        lists.append(best)
        ratios.append(near[:, 1] / np.maximum(near[:, 0], 1e-300))
    return np.concatenate(lists), np.concatenate(ratios)


def spread(lists: np.ndarray, ratios: np.ndarray, closure: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of the vector, centroid): the nearest of each vector, and the second if it is within the closure."""
    also = np.flatnonzero((ratios <= closure) & np.isfinite(ratios))
    return np.concatenate((np.arange(len(lists)), also)), np.concatenate((lists[:, 0], lists[also, 1]))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


@dataclass(frozen=True)
class Index:
    """Posting lists: ``posted`` has cell, list, shelf, v1, v2, vec and ids; ``fine`` has every list's centroid.

    A shelf is a run of a cell's lists with about ``part`` vectors. ``cells`` is the graph over the cells' centroids.
    """

    posted: DataFrame
    fine: DataFrame
    cells: Broadcast
    sizes: DataFrame
    largest: float
    count: int
    settings: AnnSettings


def build(distinct: DataFrame, largest: float, s: AnnSettings = AnnSettings()) -> Index:
    """The index of distinct vectors (v1, v2, vec, ids); v1 is a hash of the vector."""
    spark = distinct.sparkSession
    count = distinct.count()
    lists = -(-count // s.list_size)
    k = math.ceil(math.sqrt(lists))
    draw = F.pmod(F.xxhash64("v1"), F.lit(DRAWS)) / F.lit(float(DRAWS))
    share = s.sample * max(k, 16) / count

    def drawn(low: float) -> np.ndarray:
        some = distinct.where((draw >= low) & (draw < low + share)).select("v1", "vec").toPandas().sort_values("v1", kind="stable")
        if some.empty:
            some = distinct.select("v1", "vec").limit(s.sample).toPandas()
        return lift(stacked(some["vec"]), largest)

    centroids, _ = balanced_centroids(drawn(0.0), k, s.rounds)
    graph = CentroidGraph(centroids, s.degree)
    # Of other vectors than those that the centroids were fitted to, which lie too near them.
    closure = float(np.quantile(two_nearest(drawn(min(share, max(0.0, 1 - share))), graph, s.beam)[1], s.boundary, method="lower"))
    cells = spark.sparkContext.broadcast(graph)

    def into_cells(it):
        for pdf in it:
            if len(pdf):
                row, cell = spread(*two_nearest(lift(stacked(pdf["vec"]), largest), cells.value, s.beam), closure)
                yield pdf.iloc[row].assign(cell=cell.astype("int32"))[["cell", "v1", "v2", "vec", "ids"]]

    celled = cut(distinct.mapInPandas(into_cells, "cell int, v1 long, v2 long, vec array<double>, ids array<long>"))
    # One row for each cell: as many as the square root of the number of lists.
    held = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    sizes = spark.createDataFrame([(c, n, -(-n // s.part)) for c, n in held.items()], "cell int, n long, parts int")
    share = min(1.0, s.sample / s.list_size)
    redraw = F.pmod(F.xxhash64("v1", F.lit(1)), F.lit(DRAWS)) / F.lit(float(DRAWS))

    def fit(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v1", "v2"])
        fine, own = balanced_centroids(lift(stacked(pdf["vec"]), largest), -(-held[key[0]] // s.list_size), s.rounds)
        before = (np.cumsum(own) - own) * (held[key[0]] / max(1, own.sum()))
        return pd.DataFrame({"cell": key[0], "list": range(len(fine)), "shelf": (before // s.part).astype(int), "centroid": list(fine)})

    shape = "cell int, list int, shelf int, centroid array<double>"
    fine = cut(celled.where(redraw < share).select("cell", "v1", "v2", "vec").groupBy("cell").applyInPandas(fit, shape))
    missing = held.keys() - {r["cell"] for r in fine.select("cell").distinct().collect()}
    if missing:
        alone = spark.createDataFrame([(c, 0, 0, centroids[c].tolist()) for c in sorted(missing)], shape)
        fine = cut(fine.unionByName(alone))

    def post(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "list", "shelf", "v1", "v2", "vec", "ids"]
        if pdf.empty:
            return pd.DataFrame(columns=names)
        own = own.sort_values("list")
        near, ratios = two_nearest(lift(stacked(pdf["vec"]), largest), CentroidGraph(stacked(own["centroid"]), s.degree), s.beam)
        row, at = spread(near, ratios, float(np.quantile(ratios, s.boundary, method="lower")))
        return pdf.iloc[row].assign(list=own["list"].to_numpy()[at], shelf=own["shelf"].to_numpy()[at])[names]

    part = F.pmod(F.xxhash64("v1", F.lit(2)), F.col("parts")).cast("int").alias("part")
    left = celled.join(sizes, "cell").select("cell", part, "v1", "v2", "vec", "ids")
    right = fine.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "shelf", "centroid")
    posted = cut(
        left.groupBy("cell", "part")
        .cogroup(right.groupBy("cell", "part"))
        .applyInPandas(post, "cell int, list int, shelf int, v1 long, v2 long, vec array<double>, ids array<long>")
    )
    return Index(posted, fine, cells, sizes, largest, count, s)


def routes(index: Index, asked: DataFrame, cell_ratio: float, list_ratio: float, slack: float = 0.0) -> DataFrame:
    """v1, v2, vec, cell, shelf, lists and their distances d: the lists of each query in the cells within the ratio.

    Lists are those within ``list_ratio`` of the nearest list that the query has in any cell. ``slack`` is added to
    either reach; with a slack of twice the largest norm every list is read.
    """
    s, cells, largest = index.settings, index.cells, index.largest

    def into_cells(it):
        for pdf in it:
            for low in range(0, len(pdf), 1024):
                some = pdf.iloc[low : low + 1024]
                d = cells.value.search(level(stacked(some["vec"]), largest), cell_ratio, s.beam, slack)
                row, cell = np.nonzero(d <= cell_ratio * d.min(axis=1, keepdims=True) + slack)
                yield some.iloc[row].assign(cell=cell.astype("int32"))[["cell", "v1", "v2", "vec"]]

    celled = cut(asked.mapInPandas(into_cells, "cell int, v1 long, v2 long, vec array<double>"))
    loads = celled.groupBy("cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("v1", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    left = celled.join(loads, "cell").select("cell", block, "v1", "v2", "vec")
    right = index.fine.join(loads, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "shelf", "centroid")

    def route(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {"i": [], "shelf": [], "lists": [], "d": []}
        if len(pdf) and len(own):
            own = own.sort_values("list")
            names, shelves = own["list"].to_numpy(), own["shelf"].to_numpy()
            graph = CentroidGraph(stacked(own["centroid"]), s.degree)
            for low in range(0, len(pdf), 1024):
                d = graph.search(level(stacked(pdf["vec"].iloc[low : low + 1024]), largest), list_ratio, s.beam, slack)
                row, col = np.nonzero(d <= list_ratio * d.min(axis=1, keepdims=True) + slack)
                edges = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shelves[col], prepend=-1) != 0)).tolist()
                for a, b in zip(edges, [*edges[1:], len(row)]):
                    out["i"].append(low + row[a])
                    out["shelf"].append(shelves[col[a]])
                    out["lists"].append(names[col[a:b]].astype("int32"))
                    out["d"].append(d[row[a], col[a:b]])
        found = pdf.iloc[out.pop("i")][["cell", "v1", "v2", "vec"]].reset_index(drop=True)
        return found.assign(**out)[["cell", "shelf", "v1", "v2", "vec", "lists", "d"]]

    schema = "cell int, shelf int, v1 long, v2 long, vec array<double>, lists array<int>, d array<double>"
    routed = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(route, schema)
    nearest_list = F.min(F.array_min("d")).over(Window.partitionBy("v1", "v2"))
    pairs = F.filter(F.arrays_zip("lists", "d"), lambda x: x["d"] <= F.col("reach"))
    return (
        routed.withColumn("reach", nearest_list * list_ratio + slack)
        .withColumn("pairs", pairs)
        .where(F.size("pairs") > 0)
        .select("cell", "shelf", "v1", "v2", "vec", F.col("pairs.lists").alias("lists"), F.col("pairs.d").alias("d"))
    )


def calibrate(index: Index, asked: DataFrame, top: int) -> tuple[float, float]:
    """The ratios of cells and lists with which ``probes`` queries find ``coverage`` of their true neighbours.

    The probes are held against every posted vector; each task keeps the best of each probe it has met.
    """
    s, largest = index.settings, index.largest
    probes = asked.orderBy(F.xxhash64("v1", F.lit(4))).limit(s.probes).select("v1", "v2", "vec").toPandas()
    if probes.empty:
        return 1.0, 1.0
    raw = stacked(probes["vec"])
    own = probes["v1"].to_numpy()
    most = 4 * top  # a vector is in four lists at most

    def best(it):
        held = None
        for pdf in it:
            if not len(pdf):
                continue
            score = raw @ stacked(pdf["vec"]).T
            score[own[:, None] == pdf["v1"].to_numpy()[None, :]] = -np.inf
            keep = min(most, score.shape[1])
            at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            row = np.repeat(np.arange(len(raw)), keep)
            found = pdf.iloc[at.ravel()][["v1", "v2", "cell", "list"]].assign(probe=row, score=np.take_along_axis(score, at, axis=1).ravel())
            held = found if held is None else pd.concat([held, found])
            held = held.sort_values(["probe", "score"], ascending=[True, False], kind="stable").groupby("probe").head(most)
        if held is not None:
            yield held[held["score"] > -np.inf][["probe", "score", "v1", "v2", "cell", "list"]].astype({"probe": "int32"})

    found = index.posted.select("v1", "v2", "vec", "cell", "list").mapInPandas(best, "probe int, score double, v1 long, v2 long, cell int, list int")
    by_score = Window.partitionBy("probe").orderBy(F.desc("score"), "v1", "v2")
    true = found.withColumn("rank", F.dense_rank().over(by_score)).where(F.col("rank") <= top)
    places = true.join(index.fine.select("cell", "list", "centroid"), ["cell", "list"]).toPandas()
    if places.empty:
        return 1.0, 1.0
    asking = level(raw, largest)
    to_cells = np.sqrt(squared_distances(asking, index.cells.value.centroids))
    probe, tiny = places["probe"].to_numpy(), 1e-9 * largest
    of_cell = (to_cells[probe, places["cell"]] + tiny) / (to_cells.min(axis=1)[probe] + tiny)
    needed = places.assign(x=of_cell).groupby(["probe", "v1", "v2"])["x"].min()
    cell_ratio = float(max(1.0, np.quantile(needed, (1 + s.coverage) / 2, method="higher"))) * (1 + 1e-9)
    some = asked.sparkSession.createDataFrame(probes, "v1 long, v2 long, vec array<double>")
    least = routes(index, some, cell_ratio, 1.0).groupBy("v1", "v2").agg(F.min(F.array_min("d")).alias("least")).toPandas()
    nearest_list = probes.merge(least, on=["v1", "v2"], how="left")["least"].to_numpy()
    apart = np.linalg.norm(stacked(places["centroid"]) - asking[probe], axis=1)
    of_list = np.where(of_cell <= cell_ratio, (apart + tiny) / (nearest_list[probe] + tiny), np.inf)
    needed = places.assign(x=of_list).groupby(["probe", "v1", "v2"])["x"].min()
    return cell_ratio, float(max(1.0, np.quantile(needed, s.coverage, method="higher"))) * (1 + 1e-9)


def best_of(at: np.ndarray, ids: list, base: np.ndarray, rough: np.ndarray, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(minus score, id) of the k best ids, ties to smaller ids, an id once with its best score.

    ``rough`` are the scores as a matrix product gives them, whose last bits depend on a row's place; what comes
    near the k-th is scored again, each row in the same way.
    """
    want = 2 * k
    while True:
        keep = np.arange(len(rough))
        if len(rough) > want:
            edge = np.partition(rough, len(rough) - want)[len(rough) - want]
            keep = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
        scores = np.einsum("ij,j->i", base[at[keep]], query)
        pairs = sorted((-score, int(i)) for score, place in zip(scores.tolist(), at[keep].tolist()) for i in ids[place])
        first = {}
        for score, i in pairs:
            first.setdefault(i, score)
            if len(first) == k:
                break
        if len(first) == k or len(keep) == len(rough):
            return [(score, i) for i, score in first.items()]
        want *= 4


def best_rows(
    rough: np.ndarray, first: np.ndarray, single: np.ndarray, base: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``best_of`` finds for many queries at once (query, id, score), and the queries that need it after all.

    Those are queries whose near ones may tie beyond the 2 k looked at, or have several ids.
    """
    want = min(2 * k, rough.shape[1])
    at = np.argpartition(-rough, want - 1, axis=1)[:, :want]
    near = np.take_along_axis(rough, at, axis=1)
    ordered = -np.sort(-near, axis=1)
    here = near > -np.inf
    edge = ordered[:, min(k, want) - 1]
    tied = (want < rough.shape[1]) & np.isfinite(edge) & (ordered[:, -1] >= edge - 1e-9 * np.maximum(1.0, np.abs(edge)))
    again = tied | (here & ~single[at]).any(axis=1)
    row, col = np.nonzero(here & ~again[:, None])
    place = at[row, col]
    scores = np.einsum("ij,ij->i", base[place], queries[row])
    ids = first[place]
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    # A vector in two lists of the shelf is there twice, with equal scores.
    once = (np.diff(row, prepend=-1) != 0) | (np.diff(ids, prepend=0) != 0)
    row, ids, scores = row[once], ids[once], scores[once]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], ids[keep], scores[keep], np.flatnonzero(again)


def compared(routed: DataFrame, posted: DataFrame, keep: int, s: AnnSettings) -> DataFrame:
    """v1, v2, vec_id, score: the ``keep`` best of each query on each shelf, from its lists alone; null lists mean all."""
    loads = routed.groupBy("cell", "shelf").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("v1", F.lit(5)), F.col("blocks")).cast("int").alias("block")
    key = ["cell", "shelf", "block"]
    left = routed.join(loads, ["cell", "shelf"]).select("cell", "shelf", block, "v1", "v2", "vec", "lists").groupBy(*key)
    right = (
        posted.join(loads, ["cell", "shelf"])
        .select("cell", "shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec", "ids")
        .groupBy(*key)
    )

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"v1": [], "v2": [], "vec_id": [], "score": []}
        if len(asked) and len(held):
            held = held.sort_values("list", kind="stable")
            names, starts = np.unique(held["list"].to_numpy(), return_index=True)
            spans = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(held)])))
            ids, base, asking = held["ids"].tolist(), stacked(held["vec"]), stacked(asked["vec"])
            lists, v1, v2 = asked["lists"].tolist(), asked["v1"].to_numpy(), asked["v2"].to_numpy()
            first, single = np.array([x[0] for x in ids]), np.array([len(x) == 1 for x in ids])
            for low in range(0, len(asking), 256):
                some = asking[low : low + 256]
                rough = np.full((len(some), len(base)), -np.inf)
                wants: dict[int, list[int]] = {}
                for i, own in enumerate(lists[low : low + 256]):
                    for x in spans if own is None else own:
                        wants.setdefault(x, []).append(i)
                for x, rows in wants.items():
                    if x in spans:
                        a, b = spans[x]
                        rough[rows, a:b] = some[rows] @ base[a:b].T
                row, vec_id, score, slow = best_rows(rough, first, single, base, some, keep)
                for i in slow.tolist():
                    at = np.flatnonzero(rough[i] > -np.inf)
                    found = best_of(at, ids, base, rough[i][at], some[i], keep)
                    row = np.append(row, [i] * len(found)).astype(int)
                    vec_id, score = np.append(vec_id, [x for _, x in found]), np.append(score, [-x for x, _ in found])
                for name, values in zip(out, (v1[low + row], v2[low + row], vec_id, score)):
                    out[name].append(values)
        out = {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}
        return pd.DataFrame(out).astype({"v1": "int64", "v2": "int64", "vec_id": "int64", "score": "float64"})

    return left.cogroup(right).applyInPandas(compare, "v1 long, v2 long, vec_id long, score double")


def best_ids(found: DataFrame, keep: int) -> DataFrame:
    """v1, v2 and the ``keep`` best (score, vec_id) of each, an id once with its best score."""
    once = found.groupBy("v1", "v2", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")
    some = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return some.groupBy("v1", "v2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))


def prepared(vectors: DataFrame, queries: Column, id_col: str, vec_col: str) -> tuple[DataFrame, dict | None]:
    """Usable rows of the most frequent length with two hashes of the vector, and length, number and largest norm."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
    )
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("largest"))
    shape = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None:
        return rows, None
    return rows.where(F.size("vec") == shape["dim"]).select(
        "vec_id", "vec", "is_query", F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit("second"), "vec").alias("v2")
    ), shape.asDict()


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Each different vector once (v1, v2, vec) with the ``keep`` smallest ids that have it.

    Of rows with equal vectors, which tie in every score, no others can be among a query's best, so nothing is lost
    and a vector that a third of all rows share is one entry of one list.
    """
    by_id = Window.partitionBy("v1", "v2").orderBy("vec_id")
    some = rows.select("v1", "v2", "vec", "vec_id", F.dense_rank().over(by_id).alias("place")).where(F.col("place") <= keep)
    return some.groupBy("v1", "v2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def nearest(
    vectors: DataFrame,
    queries: Column,
    top: int = TOP,
    settings: AnnSettings = AnnSettings(),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``top`` rows with the largest inner product.

    Rows for which ``queries`` holds are queries; every other usable row is a candidate for them. Null, zero and
    non-finite vectors, null ids and vectors of another length than the most frequent one take no part. Rows that
    repeat an id count once, with their best score; a repeated query id with different vectors keeps the best of all.
    Scores are exact in double precision; ties go to the smaller id. Fewer candidates than ``top`` are all returned;
    an empty table gives no rows. Equal vectors are indexed and searched once and expanded at the end. A query whose
    lists hold too few vectors is held against all of them.
    """
    s, spark = settings, vectors.sparkSession
    rows, shape = prepared(vectors, queries, id_col, vec_col)
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(cut(distinct_vectors(rows, top + 1)), shape["largest"], s)
    askers = rows.where("is_query")
    asked = cut(askers.groupBy("v1", "v2").agg(F.first("vec").alias("vec")))
    routed = cut(routes(index, asked, *calibrate(index, asked, top)))
    best = cut(best_ids(compared(routed, index.posted, top + 1, s), top + 1))
    short = asked.join(best.where(F.size("best") > top), ["v1", "v2"], "left_anti")
    if index.count > s.list_size and not short.isEmpty():
        every = cut(routes(index, short, 1.0, 1.0, 2.01 * index.largest))
        best = best.join(short, ["v1", "v2"], "left_anti").unionByName(best_ids(compared(every, index.posted, top + 1, s), top + 1))
    askers = askers.select(F.col("vec_id").alias("query_id"), "v1", "v2").distinct()
    found = askers.join(best, ["v1", "v2"]).select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
    once = found.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STRIDE == 0)
