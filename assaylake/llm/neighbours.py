"""The k most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.cleaning import usable_vector
from assaylake.plans.joins import hot_keys, join_hot
from assaylake.plans.scratch import Scratch

#: Vectors of a posting list that the centroids are fitted for.
LIST_SIZE = 384
#: The centroids are fitted on at most so many vectors (and numbers) of the collection; all are indexed.
SAMPLE_ROWS, SAMPLE_NUMBERS = 200_000, 16_000_000
#: A sampled list has at least so many vectors, so there are at most SAMPLE_ROWS / LEAST_LIST centroids.
LEAST_LIST = 16
#: A vector is also stored in lists whose centroid is at most so many times as far as its nearest one,
REPLICA_RATIO = 1.25
#: and searches the lists up to this ratio.
SEARCH_RATIO = 2.0
#: Width of the search in the graph of centroids, and links of each.
BEAM, LINKS = 16, 16
#: A list of more vectors is searched by parts.
LONG_LIST = 4 * LIST_SIZE
_BLOCK = 1 << 22  # distances computed at once


def balanced_parts(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of parts of nearly equal size: each part is halved at the median of its longest direction."""
    parts, out = [np.arange(len(x))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        rows = rows[np.argsort(along, kind="stable")]
        parts += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def balanced_centroids(sample: np.ndarray, size: int) -> np.ndarray:
    """Means of balanced parts."""
    return np.array([sample[rows].mean(axis=0) for rows in balanced_parts(sample, size)]).reshape(-1, sample.shape[1])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, by differences (exact ties stay ties)."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids, the nearest others of each, and the few at which a search begins."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> "CentroidGraph":
        n = len(points)
        k = min(LINKS + 1, n)
        links = np.empty((n, k), np.int64)
        step = max(1, _BLOCK // max(n, 1))
        for i in range(0, n, step):
            links[i : i + step] = np.argpartition(_squared(points[i : i + step], points), k - 1, axis=1)[:, :k]
        entries = np.linspace(0, n - 1, min(n, max(BEAM, int(np.sqrt(n)) * 2))).astype(np.int64)
        return cls(points, links, np.unique(entries))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BEAM nearest centroids of each row and their squared distances, nearest first.

        A best-first search for all rows at once: the links of the best found so
        far are looked at until nothing better turns up.
        """
        width = min(BEAM, len(self.entries))
        start = _squared(x, self.points[self.entries])
        at = self.entries[np.argpartition(start, width - 1, axis=1)[:, :width]]
        best = np.sort(at, axis=1)
        rows = np.arange(len(x))[:, None]
        while True:
            found = np.sort(self.links[best].reshape(len(x), -1), axis=1)
            d = np.zeros(found.shape)
            for i in range(x.shape[1]):
                e = self.points[found, i] - x[:, i, None]
                d += e * e
            d[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
            pick = np.argpartition(d, width - 1, axis=1)[:, :width]
            new = np.sort(found[rows, pick], axis=1)
            if (new == best).all():
                order = np.argsort(d[rows, pick], axis=1, kind="stable")
                pick = pick[rows, order]
                return found[rows, pick], d[rows, pick]
            best = new


def _posting(graph: CentroidGraph, x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, stored, searched) of every list that a row is stored in or searches.

    ``sizes`` holds the number of vectors whose nearest list each one is. A row
    searches at least so many of its nearest lists that they hold ``least`` of
    them, whatever the ratio; if the width of the search doesn't hold as many, all
    centroids are taken in order of distance.
    """
    lists, d = graph.nearest(x)
    ratio = np.sqrt(d) / np.maximum(np.sqrt(d[:, :1]), 1e-300)
    ratio[:, 0] = 1.0
    usable = np.isfinite(d)
    ratio[~usable] = np.inf
    held = np.cumsum(np.where(usable, sizes[lists], 0), axis=1)
    searched = (ratio <= SEARCH_RATIO) | (usable & (held - np.where(usable, sizes[lists], 0) < least))
    stored = ratio <= REPLICA_RATIO
    # A list beside one that is already chosen and nearer to it than the vector is adds nothing.
    for j in range(1, lists.shape[1]):
        apart = ((graph.points[lists[:, :j]] - graph.points[lists[:, j, None]]) ** 2).sum(axis=2)
        stored[:, j] &= ~((apart < d[:, j, None]) & stored[:, :j]).any(axis=1)
    row, at = np.nonzero(searched | stored)
    out = [row, lists[row, at], stored[row, at], searched[row, at]]
    for r in np.flatnonzero(held[:, -1] < least):
        order = np.argsort(_squared(x[r : r + 1], graph.points)[0], kind="stable")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1
        more = np.setdiff1d(order[:enough], lists[r][searched[r]])
        out = [np.concatenate([a, b]) for a, b in zip(out, (np.full(len(more), r), more, np.zeros(len(more), bool), np.ones(len(more), bool)))]
    return tuple(out)


def _nearest_in(x: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``k`` nearest members of each row; at equal distance the earlier member.

    Everything at the k-th distance is looked at, so ties are never cut off by chance.
    """
    width = min(k, len(members))
    places, near = np.empty((len(x), width), np.int64), np.empty((len(x), width))
    step = max(1, _BLOCK // max(len(members), 1))
    for i in range(0, len(x), step):
        d = _squared(x[i : i + step], members)
        wide = min(width + 6, len(members))
        pick = np.sort(np.argpartition(d, wide - 1, axis=1)[:, :wide], axis=1)
        kept = np.take_along_axis(d, pick, axis=1)
        order = np.argsort(kept, axis=1, kind="stable")[:, :width]
        p, q = np.take_along_axis(pick, order, axis=1), np.take_along_axis(kept, order, axis=1)
        if wide < len(members):
            for r in np.flatnonzero(kept.max(axis=1) <= q[:, -1]):  # more of them may lie at the last distance
                p[r] = np.argsort(d[r], kind="stable")[:width]
                q[r] = d[r, p[r]]
        places[i : i + step], near[i : i + step] = p, q
    return places, near


def _search_list(k: int):
    """The ``k`` nearest stored vectors of each searching one, within a list.

    A list of more than LONG_LIST vectors, as there are in collections much larger
    than the sample, is itself cut into balanced parts. A row looks at the parts
    whose box can hold one of its ``k`` nearest, so nothing is lost by it.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid", kind="stable")
        ids, x = pdf["vid"].to_numpy(), np.stack(pdf["vec"].to_numpy())
        stored, searched = pdf["stored"].to_numpy(), np.flatnonzero(pdf["searched"].to_numpy())
        members, own = x[stored], ids[stored]
        if not len(members) or not len(searched):
            return pd.DataFrame(columns=["vid", "found", "dist"], dtype=object)
        if len(members) <= LONG_LIST:
            at, near = _nearest_in(x[searched], members, k)
            return pd.DataFrame({"vid": ids[searched], "found": list(own[at]), "dist": list(near)})
        parts = [np.sort(p) for p in balanced_parts(members, LIST_SIZE)]
        low, high = np.array([members[p].min(axis=0) for p in parts]), np.array([members[p].max(axis=0) for p in parts])
        sizes = np.array([len(p) for p in parts])
        vids, found, dist = [], [], []
        step = max(1, _BLOCK // len(parts))
        wanted: list[list[np.ndarray]] = [[] for _ in parts]
        for i in range(0, len(searched), step):
            q = x[searched[i : i + step]]
            least, most = np.zeros((len(q), len(parts))), np.zeros((len(q), len(parts)))
            for a in range(x.shape[1]):
                below, above = low[None, :, a] - q[:, a, None], q[:, a, None] - high[None, :, a]
                least += np.maximum(np.maximum(below, above), 0) ** 2
                most += np.maximum(-below, -above) ** 2
            order = np.argsort(most, axis=1)
            enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)  # so many parts hold k vectors, all within this bound
            bound = np.take_along_axis(most, np.take_along_axis(order, enough[:, None], axis=1), axis=1)
            row, part = np.nonzero(least <= bound * (1 + 1e-9))
            for p in np.unique(part):
                wanted[p].append(searched[i + row[part == p]])
        for p, rows in enumerate(wanted):
            if rows:
                rows = np.concatenate(rows)
                at, near = _nearest_in(x[rows], members[parts[p]], k)
                vids.append(ids[rows])
                found += list(own[parts[p]][at])
                dist += list(near)
        return pd.DataFrame({"vid": np.concatenate(vids), "found": found, "dist": dist})

    return search


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """(vid, vec, ids): each vector once; vid is its smallest id, ids its ``copies`` smallest ones.

    The window keeps so few rows a vector that a group of copies with a third of
    all rows is cut down in every task before anything is shuffled.
    """
    first = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= copies)
    grouped = kept.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("vid"), "vec", "ids")


def fit_centroids(vectors: DataFrame, n: int, dim: int) -> CentroidGraph:
    """Centroids of a sample of bounded size, drawn by a hash of the id."""
    most = min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim)
    share = min(1.0, most / max(n, 1))
    sample = vectors.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec")
    points = np.array([r.vec for r in sample.limit(2 * most).collect()], float).reshape(-1, dim)
    return CentroidGraph.build(balanced_centroids(points, max(LEAST_LIST, int(LIST_SIZE * share))) if len(points) else np.zeros((1, dim)))


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int, *, dim: int | None = None) -> DataFrame:
    """(id, neighbour, distance, rank): the ``k`` nearest other rows of each row (Euclidean).

    Rows with a null id, or without a vector of ``dim`` finite numbers (by default
    the most frequent length), are left out; of an id that occurs more than once
    the smallest vector counts. At equal distance the smaller id comes first. Rows
    with equal vectors are neighbours at distance 0; they are indexed once, with their k + 1 smallest ids, so any number of copies
    costs no pairs. With fewer than k other rows all of them come out; an empty
    table gives no rows.

    Posting lists: centroids of balanced parts of a bounded sample, kept in an
    in-memory graph; every vector is stored in its nearest list and, near a
    border, in further ones; it searches the lists whose centroid is at most
    SEARCH_RATIO times as far as the nearest, and always as many as hold k + 1
    vectors, so that min(k, other rows) neighbours come out for every row. Lists
    that outgrow the sample's centroids are cut into parts once more where they
    are searched. The answer is approximate; the tests and the README give the
    recall. Vectors of a list are compared in blocks.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable_vector("vec"))
    if dim is None:
        dim = rows.agg(F.mode(F.size("vec"), True).alias("d")).first().d or 1
    rows = scratch.save(rows.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec")), "rows")
    vectors = scratch.save(distinct_vectors(rows, k + 1), "vectors")
    n, total = vectors.count(), rows.count()
    id_type = df.schema[id_col].dataType.simpleString()
    graph = spark.sparkContext.broadcast(fit_centroids(vectors, n, dim))

    def coordinates(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(graph.value.points), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                counts += np.bincount(graph.value.nearest(coordinates(part))[0][:, 0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["list", "n"])

    sizes = np.zeros(len(graph.value.points), np.int64)
    for r in vectors.select("vid", "vec").mapInArrow(nearest, "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row a centroid
        sizes[r["list"]] = r["n"]
    held = spark.sparkContext.broadcast(sizes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                row, lists, stored, searched = _posting(graph.value, coordinates(part), held.value, k + 1)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *taken.columns, pa.array(stored), pa.array(searched)], names=["list", "vid", "vec", "stored", "searched"])

    posted = vectors.select("vid", "vec").mapInArrow(assign, f"list int, vid {id_type}, vec array<double>, stored boolean, searched boolean")
    hits = posted.groupBy("list").applyInPandas(_search_list(k + 1), f"vid {id_type}, found array<{id_type}>, dist array<double>")
    # Some lists' worth of k + 1 hits a vector: an array of bounded length.
    best = hits.groupBy("vid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("dist", "found"))))), 1, k + 1).alias("best"))
    if n == total:  # no copies: every row is its own vector
        ranked = best.select(F.col("vid").alias("id"), F.transform("best", lambda b: F.struct(b["dist"].alias("dist"), b["found"].alias("other"))).alias("near"))
    else:
        # A vector with copies is a neighbour with all of its smallest ids, and its answer that of all its rows.
        copies = vectors.where(F.size("ids") > 1).select(F.col("vid").alias("found"), "ids")
        exploded = best.select("vid", F.explode("best").alias("b")).select("vid", F.col("b.dist").alias("dist"), F.col("b.found").alias("found"))
        all_ids = exploded.join(copies, "found", "left").select("vid", "dist", F.explode(F.coalesce("ids", F.array("found"))).alias("other"))
        answers = all_ids.groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "other"))), 1, k + 1).alias("near"))
        per_vector = vectors.select("vid", "vec").join(answers, "vid").select("vec", "near")
        common = hot_keys(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), ["vec"], "n", total)
        ranked = join_hot(rows, per_vector, ["vec"], common, spread=F.col("id"))
    out = ranked.select("id", F.posexplode(F.slice(F.filter("near", lambda s: s["other"] != F.col("id")), 1, k)).alias("_p", "_n"))
    return out.select(F.col("id").alias(id_col), F.col("_n.other").alias("neighbour"), F.sqrt("_n.dist").alias("distance"), (F.col("_p") + 1).alias("rank"))
