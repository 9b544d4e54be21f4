"""Clusters of mutually similar records by reciprocal-nearest-neighbour average linkage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from assaylake.functions.cleaning import usable_vector
from assaylake.plans.joins import hot_keys, join_hot
from assaylake.plans.scratch import Scratch

#: Parts of the radius that make the side of a tile. The records of one tile are
#: one node of the graph, so a node has a bounded number of neighbours however
#: crowded the space is.
TILES = 8
#: The graph reaches this many times the radius; a pair at the radius then has similarity 1/2.
REACH = 2.0**0.5
THRESHOLD = 0.5
#: Side of a block in radii. A block is the unit of parallel work; as its nodes are tiles, their number is bounded.
BLOCK = 12
#: A neighbourhood is looked up by copies to 3^dim cells and 2^dim blocks.
MOST_DIMENSIONS = 3
#: Rows that a task takes up at once, besides those of one block.
CHUNK = 40_000
#: Each step of the exact check cuts a tile's sides into so many parts.
SPLIT = 4
#: Coordinates lie within so many tiles of 0; further away doubles couldn't tell tiles apart.
FURTHEST = 2.0**48


def _floor(x: Column, side: float) -> Column:
    return F.floor(x / F.lit(side))


def average_linkage(u: np.ndarray, v: np.ndarray, s: np.ndarray, n: np.ndarray, home: np.ndarray, mean: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges all mutual best pairs, round after round, and says what is left: (root, u, v, s).

    ``u < v`` are ends of edges, ``s`` the sums of similarities between them, ``n``
    sizes and ``mean`` positions, both brought up to date in place; what isn't
    there has similarity 0. In each round every node finds the neighbour of
    highest average similarity s / (n n'), ties going to the smaller pair, and all
    pairs that are each other's best and reach the threshold merge. Average
    linkage is reducible: no merge raises a similarity above the larger of the two
    it replaces, so the result is that of merging one best pair at a time.

    Only nodes with ``home`` are merged; all their edges must be there. The others
    may merge elsewhere at the same time, which can only lower what is known of
    them here, so a pair that is best now stays so. A home node whose best lies
    below the threshold can never merge again, and its edges are dropped.
    """
    root = np.arange(len(n))
    while len(u):
        average = s / (n[u] * n[v])
        rank = np.empty(len(u), np.int64)
        rank[np.lexsort((v, u, -average))] = np.arange(len(u))
        best = np.full(len(n), len(u))
        np.minimum.at(best, u, rank)
        np.minimum.at(best, v, rank)
        fit = average >= threshold
        reaches = np.zeros(len(n), bool)
        reaches[u[fit]] = reaches[v[fit]] = True
        mutual = fit & home[u] & home[v] & (best[u] == rank) & (best[v] == rank)
        live = (reaches | ~home)[u] & (reaches | ~home)[v]
        if not mutual.any():
            return root, u[live], v[live], s[live]
        a, b = u[mutual], v[mutual]
        share = (n[b] / (n[a] + n[b]))[:, None]
        mean[a] += share * (mean[b] - mean[a])
        n[a] += n[b]
        new = np.arange(len(n))
        new[b] = a
        root = new[root]
        x, y = new[u[live]], new[v[live]]
        apart = x != y
        key = np.minimum(x, y)[apart] * len(n) + np.maximum(x, y)[apart]
        keys, at = np.unique(key, return_inverse=True)
        u, v, s = keys // len(n), keys % len(n), np.bincount(at, s[live][apart], len(keys))
    return root, u, v, s


def _neighbour_pairs(run: np.ndarray, mean: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of one run whose cells of side ``reach`` touch, a part at a time; equal runs stand together."""
    if not len(run):
        return
    cell = np.floor(mean / reach).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    cell -= np.repeat(np.minimum.reduceat(cell, starts), np.diff(np.append(starts, len(run))), axis=0)
    span = cell.max(0) + 3  # a run is a block with its surroundings, so these are small numbers
    run = np.cumsum(np.concatenate([[False], run[1:] != run[:-1]]))
    weight = np.cumprod(np.concatenate([[1], span[:-1]]))
    code = run * int(np.prod(span)) + (cell + 1) @ weight
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    for shift in product((-1, 0, 1), repeat=mean.shape[1]):
        to = sorted_code + int(np.dot(shift, weight))
        low, high = np.searchsorted(sorted_code, to, "left"), np.searchsorted(sorted_code, to, "right")
        count = high - low
        for part in np.array_split(np.arange(len(order)), max(1, int(count.sum()) // 2_000_000)):
            c = count[part]
            i = np.repeat(part, c)
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[part], c)
            i, j = order[i], order[j]
            keep = i < j
            yield i[keep], j[keep]


def _whole_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of batches sorted by ``key``, in pieces of some CHUNK rows that never cut a run of equal keys."""
    waiting: list[pa.RecordBatch] = []
    held = 0

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        return {n: t.column(n).to_numpy(zero_copy_only=False) for n in t.column_names}

    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held < CHUNK:
            continue
        t = pa.Table.from_batches(waiting).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        for k in key:
            c = t.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield columns(t.slice(0, cut))
        waiting, held = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield columns(pa.Table.from_batches(waiting))


class Space:
    """Names and expressions of a number of dimensions: tiles t0, t1, ..., means m0, ..., boxes l0, h0, ..."""

    def __init__(self, radius: float, dim: int) -> None:
        if not 1 <= dim <= MOST_DIMENSIONS:
            raise ValueError(f"vectors of 1 to {MOST_DIMENSIONS} dimensions")
        self.radius, self.dim = radius, dim
        self.side = radius / TILES / max(1.0, dim**0.5 / 2**0.5)
        self.reach = REACH * radius
        self.block = BLOCK * radius

    def names(self, letter: str) -> list[str]:
        return [f"{letter}{i}" for i in range(self.dim)]

    def struct(self, letter: str, alias: str) -> Column:
        return F.struct(*[F.col(n).alias(f"x{i}") for i, n in enumerate(self.names(letter))]).alias(alias)

    def in_blocks(self, rows: DataFrame, low: list[Column], high: list[Column], offset: tuple[int, ...]) -> DataFrame:
        """``rows`` once for each block k0, k1, ... that the box from ``low`` to ``high`` meets, sorted by group and block."""
        for i, (a, b) in enumerate(zip(low, high)):
            moved = F.lit(offset[i] * self.block / 2)
            rows = rows.withColumn(f"k{i}", F.explode(F.array_distinct(F.array(_floor(a + moved, self.block), _floor(b + moved, self.block)))))
        keys = ["grp", *self.names("k")]
        return rows.repartition(*keys).sortWithinPartitions(*keys)

    def home(self, block: np.ndarray, mean: np.ndarray, offset: tuple[int, ...]) -> np.ndarray:
        """Whether a position lies in a block, by the same arithmetic as :meth:`in_blocks`."""
        moved = np.array(offset) * self.block / 2
        return (np.floor((mean + moved) / self.block).astype(np.int64) == block).all(1)


def _runs(c: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Numbers of the runs of equal keys in sorted columns."""
    new = np.zeros(len(c[keys[0]]), bool)
    for k in keys:
        new[1:] |= c[k][1:] != c[k][:-1]
    return np.cumsum(new)


def _stack(c: dict[str, np.ndarray], names: list[str], kind: type = float) -> np.ndarray:
    return np.stack([c[n].astype(kind) for n in names], 1)


class Blocks:
    """What a task does with whole blocks, as functions of Arrow batches."""

    def __init__(self, space: Space, grp_type: str) -> None:
        self.space = space
        names = space.names
        ints = ", ".join(f"{n} bigint" for letter in "abt" for n in names(letter))
        doubles = ", ".join(f"{n} double" for letter in "mlhp" for n in names(letter))
        self.ddl = f"kind int, grp {grp_type}, {ints}, x double, live boolean, {doubles}, n double"
        self.schema = to_arrow_schema(DataType.fromDDL(self.ddl))

    def _emit(self, c: dict, at: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray, x: np.ndarray, live: np.ndarray, mean: np.ndarray, extra: np.ndarray | None) -> pa.RecordBatch:
        d = self.space.dim
        none = pa.nulls(len(at), pa.float64())
        cols = [pa.array(np.full(len(at), kind, np.int32)), pa.array(c["grp"][at])]
        cols += [pa.array(m[:, i]) for m in (a, b, np.zeros_like(a)) for i in range(d)]
        cols += [pa.array(x.astype(float)), pa.array(live), *[pa.array(mean[:, i]) for i in range(d)]]
        cols += [none] * (3 * d + 1) if extra is None else [pa.array(extra[:, i]) for i in range(3 * d + 1)]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(cols, self.schema)], schema=self.schema)

    def first_round(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Graph and merges of blocks of nodes: kind 0 is the way of each node of the block, 1 and 2 are the edges left."""
        s, keys = self.space, ["grp", *self.space.names("k")]
        for c in _whole_runs(batches, keys):
            mean, var, n, tile, block = _stack(c, s.names("m")), c["var"].astype(float), c["n"].astype(float), _stack(c, s.names("t"), np.int64), _stack(c, s.names("k"), np.int64)
            runs = _runs(c, keys)
            order = np.lexsort((*tile.T[::-1], runs))  # nodes of a block by their tiles, which decides ties
            c = {k: v[order] for k, v in c.items()}
            mean, var, n, tile, block, runs = mean[order], var[order], n[order], tile[order], block[order], runs[order]
            home = s.home(block, mean, (0,) * s.dim)
            us, vs, ws = [], [], []
            for i, j in _neighbour_pairs(runs, mean, s.reach):
                keep = home[i] | home[j]
                i, j = i[keep], j[keep]
                w = 1 - (((mean[i] - mean[j]) ** 2).sum(1) + var[i] + var[j]) / s.reach**2
                on = w > 0
                us.append(i[on]), vs.append(j[on]), ws.append((w * n[i] * n[j])[on])
            size, centre = n.copy(), mean.copy()
            root, u, v, w = average_linkage(np.concatenate(us), np.concatenate(vs), np.concatenate(ws), size, home, centre)
            live = np.zeros(len(n), bool)
            live[u] = live[v] = True
            at = np.flatnonzero(home)
            extra = np.column_stack([*(_stack(c, s.names(letter)) for letter in "lhp"), n])
            yield self._emit(c, at, 0, tile[at], tile[root[at]], size[root[at]], live[root[at]], centre[root[at]], extra[at])
            yield from self._left_over(c, u, v, w, tile, tile, block, home, mean, (0,) * s.dim)

    def _left_over(self, c, u, v, w, new, old, block, home, mean, offset) -> Iterator[pa.RecordBatch]:
        """Edges that are left: within the block, and across its border if the far end lies in a later block."""
        s = self.space
        inside = home[u] & home[v]
        a, b = np.where(home[u], u, v), np.where(home[u], v, u)
        there = np.floor((mean[b] + np.array(offset) * s.block / 2) / s.block).astype(np.int64)
        later, tied = np.zeros(len(u), bool), np.ones(len(u), bool)
        for i in range(s.dim):
            later |= tied & (there[:, i] > block[a, i])
            tied &= there[:, i] == block[a, i]
        for kind, keep in ((1, inside), (2, ~inside & later)):
            at = a[keep]
            blank = np.zeros((len(at), s.dim))
            yield self._emit(c, at, kind, new[at], old[b[keep]], w[keep], np.ones(len(at), bool), blank, None)

    def later_round(self, offset: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for blocks of edges between live clusters."""
        s, keys = self.space, ["grp", *self.space.names("k")]
        for e in _whole_runs(batches, keys):
            m, runs, d = len(e["s"]), _runs(e, keys), s.dim
            ends = np.concatenate([_stack(e, s.names("a"), np.int64), _stack(e, s.names("b"), np.int64)])
            table = np.column_stack([np.concatenate([runs, runs]), ends])
            order = np.lexsort(table.T[::-1])
            new = np.ones(2 * m, bool)
            new[1:] = (table[order][1:] != table[order][:-1]).any(1)
            code = np.empty(2 * m, np.int64)
            code[order] = np.cumsum(new) - 1
            pick = order[new]  # one appearance of each node
            tile, row = ends[pick], pick % m
            n = np.concatenate([e["na"], e["nb"]]).astype(float)[pick]
            mean = np.concatenate([_stack(e, s.names("x")), _stack(e, s.names("y"))])[pick]
            block = _stack(e, s.names("k"), np.int64)[row]
            home = s.home(block, mean, offset)
            size, centre = n.copy(), mean.copy()
            u, v = np.minimum(code[:m], code[m:]), np.maximum(code[:m], code[m:])
            root, u, v, w = average_linkage(u, v, e["s"].astype(float), size, home, centre)
            live = np.zeros(len(n), bool)
            live[u] = live[v] = True
            c = {"grp": e["grp"][row]}
            at = np.flatnonzero(home)
            yield self._emit(c, at, 0, tile[at], tile[root[at]], size[root[at]], live[root[at]], centre[root[at]], None)
            yield from self._left_over(c, u, v, w, tile, tile, block, home, mean, offset)

    def judge(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of tiles (u*, v*), u of a small cluster c*, that break it or leave it in doubt."""
        s, keys = self.space, ["grp", *self.space.names("k")]
        eps, d, grp = s.radius, s.dim, self.schema.field("grp").type
        for c in _whole_runs(batches, keys):
            low, high, rep = (_stack(c, s.names(x)) for x in "lhp")
            tile, cluster, block, runs, small = _stack(c, s.names("t"), np.int64), _stack(c, s.names("c"), np.int64), _stack(c, s.names("k"), np.int64), _runs(c, keys), c["small"].astype(bool)
            home = s.home(block, rep, (0,) * d)
            # boxes within the radius have points within radius and one tile of each other
            for i, j in _neighbour_pairs(runs, rep, eps + 2 * s.side):
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                keep = home[i] & small[i]
                i, j = i[keep], j[keep]
                same, broken, doubt = _decide(low[i], high[i], rep[i], low[j], high[j], rep[j], (cluster[i] == cluster[j]).all(1), eps)
                at = np.flatnonzero(doubt | broken)
                cols = [pa.array(c["grp"][i[at]]).cast(grp)] + [pa.array(m[x[at], k]) for m, x in ((cluster, i), (tile, i), (tile, j)) for k in range(d)] + [pa.array(same[at]), pa.array(broken[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["grp", *s.names("c"), *s.names("u"), *s.names("v"), "same", "broken"])


class Clustering:
    """Records (id, grp, vec) divided into clusters of alike ones.

    Two records are alike when they are of one non-null group and at most
    ``radius`` apart. Records with a null id or group, or without a vector of
    ``dim`` finite numbers, belong to no cluster; of an id that occurs more than
    once the smallest (group, vector) counts. An empty table has no clusters.
    ``dim`` is 1 to 3: neighbourhoods are found on a grid. A coordinate beyond 2^48
    tiles is an error.

    The records of one group within a tile, whose diagonal is 0.18 radii, are one
    node from the beginning. Blocks of tiles with their surroundings are linked by
    one task each; pairs across the borders of blocks merge in later rounds, with
    blocks that are moved by half their side. A mutual best pair lies within the
    radius, so one of the 2^dim ways of moving has it inside a block, and a cycle
    of these without a merge is the end: there is no bound on the rounds.
    """

    def __init__(self, records: DataFrame, radius: float, dim: int) -> None:
        self.space = Space(radius, dim)
        self.scratch = Scratch(records.sparkSession, "clusters")
        usable = records.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & usable_vector("vec", dim))
        most = F.lit(self.space.side * FURTHEST)
        place = lambda x: F.when(F.abs(x) < most, x + F.lit(0.0)).otherwise(F.raise_error(F.lit("a vector is too far away for tiles of this radius")))
        single = usable.groupBy("id").agg(F.min(F.struct("grp", "vec")).alias("_r")).select("id", "_r.grp", *[place(F.col("_r.vec")[i]).alias(f"v{i}") for i in range(dim)])
        seen = Observation()
        self.records = self.scratch.save(single.observe(seen, F.count(F.lit(1)).alias("n")), "records")
        self.total = seen.get["n"]
        self.grp_type = single.schema["grp"].dataType.simpleString()
        self.blocks = Blocks(self.space, self.grp_type)
        self.nodes = self._link()

    # linkage

    def _tiles(self) -> list[Column]:
        return [_floor(F.col(v), self.space.side).alias(t) for v, t in zip(self.space.names("v"), self.space.names("t"))]

    def tile_nodes(self) -> DataFrame:
        """(grp, t*, n, m*, var, l*, h*, p*): the records of one group within one tile: number, mean, variance, box and one point.

        The sums are algebraic; a crowded tile is folded in every task before the
        shuffle. They are taken from the tile's corner, which keeps their digits.
        """
        s = self.space
        corner = [t * s.side for t in map(F.col, s.names("t"))]
        local = [F.col(v) - c for v, c in zip(s.names("v"), corner)]
        rows = self.records.select("grp", *self._tiles(), *s.names("v"))
        grouped = rows.select("grp", *s.names("t"), *s.names("v"), *[x.alias(f"_{i}") for i, x in enumerate(local)]).groupBy("grp", *s.names("t")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(*s.names("v"))).alias("_p"), *[F.sum(f"_{i}").alias(f"_s{i}") for i in range(s.dim)], F.sum(sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(s.dim)), F.lit(0.0))).alias("_q"),
            *[f(v).alias(f"{n}{i}") for i, v in enumerate(s.names("v")) for n, f in (("l", F.min), ("h", F.max))],
        )
        at = [F.col(f"_s{i}") / F.col("n") for i in range(s.dim)]
        var = F.greatest(F.col("_q") / F.col("n") - sum((a * a for a in at), F.lit(0.0)), F.lit(0.0))
        means = [(c + a).alias(m) for c, a, m in zip(corner, at, s.names("m"))]
        return grouped.select("grp", *s.names("t"), "n", *means, var.alias("var"), *s.names("l"), *s.names("h"), *[F.col(f"_p.{v}").alias(f"p{i}") for i, v in enumerate(s.names("v"))])

    def _link(self) -> DataFrame:
        """The nodes (grp, t*, l*, h*, p*, n) with the cluster c* each belongs to, named by its first tile."""
        s, scratch = self.space, self.scratch
        d, near = s.dim, F.lit(s.reach * (1 + 1e-9))
        nodes = self.tile_nodes()
        zero = (0,) * d
        placed = s.in_blocks(nodes, [F.col(m) - near for m in s.names("m")], [F.col(m) + near for m in s.names("m")], zero)
        first = scratch.save(placed.mapInArrow(self.blocks.first_round, self.blocks.ddl), "round0")
        labels = first.where("kind = 0").select("grp", *[F.col(f"a{i}").alias(f"t{i}") for i in range(d)], *[F.col(f"b{i}").alias(f"c{i}") for i in range(d)], F.col("x").alias("size"), "live", *s.names("m"), *s.names("l"), *s.names("h"), *s.names("p"), "n")
        moves = labels.where("live").select("grp", *s.names("t"), *[F.col(f"c{i}").alias(f"r{i}") for i in range(d)], "size", *s.names("m"))
        edges = self._joined_edges(first.where("kind > 0"), moves)
        seen = Observation()
        edges = scratch.save(edges.observe(seen, F.count(F.lit(1)).alias("n")), "edges0")
        merges: list[DataFrame] = []
        ways = list(product((0, 1), repeat=d))
        quiet, k, left = 0, 0, seen.get["n"]
        while left and quiet < len(ways):
            k += 1
            offset = ways[k % len(ways)]
            done = scratch.save(self._placed_edges(edges, offset).mapInArrow(partial(self.blocks.later_round, offset), self.blocks.ddl), f"round{k}")
            seen, moved = Observation(), Observation()
            step = done.where("kind = 0").select("grp", *[F.col(f"a{i}").alias(f"t{i}") for i in range(d)], *[F.col(f"b{i}").alias(f"r{i}") for i in range(d)], F.col("x").alias("size"), "live", *s.names("m"))
            changed = F.greatest(*[(F.col(f"t{i}") != F.col(f"r{i}")).cast("int") for i in range(d)], F.lit(0)) == 1
            fresh = self._joined_edges(done.where("kind > 0"), step.where("live").drop("live"))
            edges = scratch.save(fresh.observe(seen, F.count(F.lit(1)).alias("n")), f"edges{k}")
            merge = scratch.save(step.where(changed).select("grp", *s.names("t"), *s.names("r")).observe(moved, F.count(F.lit(1)).alias("n")), f"merge{k}")
            scratch.drop(f"edges{k - 1}")
            scratch.drop(f"round{k}")
            left = seen.get["n"]
            if moved.get["n"]:
                merges.append(merge)
                quiet = 0
            else:
                quiet += 1
        facts = ["grp", *s.names("t"), *s.names("l"), *s.names("h"), *s.names("p"), "n"]
        out = labels.select(*facts, *s.names("c"))
        for merge in merges:
            step = merge.select("grp", *[F.col(f"t{i}").alias(f"c{i}") for i in range(d)], *s.names("r"))
            out = out.join(step, ["grp", *s.names("c")], "left").select(*facts, *[F.coalesce(f"r{i}", f"c{i}").alias(f"c{i}") for i in range(d)])
        return scratch.save(out, "nodes") if merges else out

    def _joined_edges(self, left: DataFrame, moves: DataFrame) -> DataFrame:
        """Edges (grp, a*, b*, s, na, nb, x*, y*) of live clusters, their far ends brought up to date and equal ones summed.

        Edges within a block (kind 1) have both ends as they are now; of those
        that cross a border (kind 2) the far end is known by its name before the round.
        """
        s, d = self.space, self.space.dim
        a, b, r = s.names("a"), s.names("b"), s.names("r")
        inner = left.where("kind = 1").select("grp", *a, *b, F.col("x").alias("s"))
        far = moves.select("grp", *[F.col(t).alias(c) for t, c in zip(s.names("t"), b)], *r)
        cross = left.where("kind = 2").select("grp", *a, *b, F.col("x").alias("s")).join(far, ["grp", *b]).select("grp", *a, *[F.col(x).alias(y) for x, y in zip(r, b)], "s")
        both = inner.unionByName(cross).select("grp", s.struct("a", "u"), s.struct("b", "v"), "s")
        summed = both.groupBy("grp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("s").alias("s"))
        ends = moves.select("grp", s.struct("r", "_e"), "size", *s.names("m")).distinct()
        one = ends.select("grp", F.col("_e").alias("u"), F.col("size").alias("na"), *[F.col(f"m{i}").alias(f"x{i}") for i in range(d)])
        two = ends.select("grp", F.col("_e").alias("v"), F.col("size").alias("nb"), *[F.col(f"m{i}").alias(f"y{i}") for i in range(d)])
        rows = summed.join(one, ["grp", "u"]).join(two, ["grp", "v"])
        return rows.select("grp", *[F.col(f"u.x{i}").alias(f"a{i}") for i in range(d)], *[F.col(f"v.x{i}").alias(f"b{i}") for i in range(d)], "s", "na", "nb", *s.names("x"), *s.names("y"))

    def _placed_edges(self, edges: DataFrame, offset: tuple[int, ...]) -> DataFrame:
        """Every edge in the blocks of both its ends."""
        s = self.space
        at = lambda names: F.array(*[_floor(F.col(c) + F.lit(offset[i] * s.block / 2), s.block) for i, c in enumerate(names)])
        rows = edges.withColumn("_k", F.explode(F.array_distinct(F.array(at(s.names("x")), at(s.names("y"))))))
        keys = ["grp", *s.names("k")]
        return rows.withColumns({k: F.col("_k")[i] for i, k in enumerate(s.names("k"))}).drop("_k").repartition(*keys).sortWithinPartitions(*keys)

    # results

    def _with_tiles(self) -> DataFrame:
        return self.records.select("*", *self._tiles())

    def _hot_tiles(self) -> DataFrame:
        return hot_keys(self.nodes, ["grp", *self.space.names("t")], "n", self.total)

    def members(self) -> DataFrame:
        """(id, grp, v*, t*, c*) of every record: its vector, its tile and its cluster."""
        s = self.space
        names = self.nodes.select("grp", *s.names("t"), *s.names("c"))
        return join_hot(self._with_tiles(), names, ["grp", *s.names("t")], self._hot_tiles(), spread=F.col("id"))

    def describe(self, typical: int = 3) -> DataFrame:
        """(head_id, size, typical): each cluster by its smallest id, its size and its most typical ids.

        Typical are the records with the least mean squared distance to all of the
        cluster, that is those nearest to its mean; ties go to the smaller id.
        """
        s = self.space
        key = ["grp", *s.names("c")]
        rows = self.scratch.save(self.members(), "members")
        sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("head_id"), *[F.avg(v).alias(f"_a{i}") for i, v in enumerate(s.names("v"))])
        means = self.scratch.save(sums, "means")
        hot = hot_keys(means, key, "size", self.total)
        near = join_hot(rows, means, key, hot, spread=F.col("id"))
        gap = sum(((F.col(v) - F.col(f"_a{i}")) * (F.col(v) - F.col(f"_a{i}")) for i, v in enumerate(s.names("v"))), F.lit(0.0))
        order = Window.partitionBy(*key, "head_id", "size").orderBy("_d", "id")
        top = near.withColumn("_d", gap).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= typical)
        named = top.groupBy(*key, "head_id", "size").agg(F.sort_array(F.collect_list(F.struct("_r", "id"))).alias("_t"))
        return named.select("head_id", "size", F.col("_t.id").alias("typical"))

    def isolated_cliques(self, least: int = 3) -> DataFrame:
        """(head_id, id): clusters whose records are all alike and like no other record.

        Such a set always comes out of the linkage as one cluster: any average over
        its pairs reaches the threshold and no average with a record outside does.
        The check that follows is exact. Pairs of tiles decide most cases by their
        boxes or by one record each; where they can't, both tiles are cut into
        smaller ones, for clusters that are still possible, until none is in doubt.
        Points are boxes without extent, so this ends.
        """
        s, eps, d, scratch = self.space, self.space.radius, self.space.dim, self.scratch
        key = ["grp", *s.names("c")]
        width = [(F.max(h) - F.min(l)).alias(f"_w{i}") for i, (l, h) in enumerate(zip(s.names("l"), s.names("h")))]
        boxes = self.nodes.groupBy(*key).agg(F.sum("n").alias("_n"), *width)
        small = boxes.where((F.col("_n") >= least) & (F.greatest(*[F.col(f"_w{i}") for i in range(d)], F.lit(0.0)) <= eps)).select(*key, F.lit(True).alias("small"))
        marked = self.nodes.join(small, key, "left").withColumn("small", F.coalesce("small", F.lit(False)))
        margin = F.lit((eps + s.side) * (1 + 1e-6))
        placed = s.in_blocks(marked, [F.col(l) - margin for l in s.names("l")], [F.col(h) + margin for h in s.names("h")], (0,) * d)
        ends = ", ".join(f"{n} bigint" for letter in "cuv" for n in s.names(letter))
        judged = scratch.save(placed.mapInArrow(self.blocks.judge, f"grp {self.grp_type}, {ends}, same boolean, broken boolean"), "judged")
        gone = judged.where("broken").select(*key)
        doubtful = judged.where("not broken").join(gone.distinct(), key, "left_anti").drop("broken")
        gone = gone.unionByName(self._settle(doubtful)).distinct()
        kept = small.join(gone, key, "left_anti").select(*key)
        tiles = self.nodes.select("grp", *s.names("t"), *s.names("c")).join(kept, key, "left_semi")
        rows = scratch.save(join_hot(self._with_tiles().select("id", "grp", *s.names("t")), tiles, ["grp", *s.names("t")], self._hot_tiles(), spread=F.col("id")).select("id", *key), "kept")
        heads = rows.groupBy(*key).agg(F.min("id").alias("head_id"), F.count(F.lit(1)).alias("_n"))
        named = join_hot(rows, heads, key, hot_keys(heads, key, "_n", self.total), spread=F.col("id"))
        return named.where("id <> head_id").select("head_id", "id")

    def _settle(self, doubtful: DataFrame) -> DataFrame:
        """(grp, c*) of the clusters that a pair among the doubtful tiles breaks, by ever smaller parts of the tiles.

        A part is known by its place in a grid whose cells divide those of the one before.
        """
        s, scratch, d = self.space, self.scratch, self.space.dim
        key = ["grp", *s.names("c")]
        cells = lambda side: F.array(*[_floor(F.col(v), side) for v in s.names("v")])
        ends = lambda f: F.array(*[f(v) for v in s.names("v")])
        total = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x * x))
        gap = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
        out = doubtful.select(*key).limit(0)
        seen = Observation()
        pairs = doubtful.select(*key, "same", F.array(*s.names("u")).alias("u"), F.array(*s.names("v")).alias("v"))
        pairs = scratch.save(pairs.observe(seen, F.count(F.lit(1)).alias("n")), "doubt0")
        k, side = 0, s.side
        while seen.get["n"]:
            k += 1
            wanted = pairs.select("grp", F.col("u").alias("_c")).union(pairs.select("grp", "v")).distinct()
            inside = self.records.withColumn("_c", cells(side)).join(wanted, ["grp", "_c"], "left_semi")
            side /= SPLIT
            parts = inside.groupBy("grp", "_c", cells(side).alias("f")).agg(F.min(F.array(*s.names("v"))).alias("p"), ends(F.min).alias("l"), ends(F.max).alias("h"))
            parts = scratch.save(parts, f"parts{k}")
            one, two = (parts.select("grp", F.col("_c").alias(end), F.struct("f", "p", "l", "h").alias(name)) for end, name in (("u", "a"), ("v", "b")))
            met = pairs.join(one, ["grp", "u"]).join(two, ["grp", "v"])
            least = total(F.zip_with(gap(F.col("a.l"), F.col("b.h")), gap(F.col("b.l"), F.col("a.h")), lambda x, y: F.greatest(x, y, F.lit(0.0))))
            most = total(F.zip_with(gap(F.col("a.h"), F.col("b.l")), gap(F.col("b.h"), F.col("a.l")), lambda x, y: F.greatest(x, y)))
            far = total(gap(F.col("a.p"), F.col("b.p")))
            points = (F.col("a.l") == F.col("a.h")) & (F.col("b.l") == F.col("b.h"))
            slack = F.lit(s.radius * 1e-9)
            doubt = ~points & F.when(F.col("same"), most > s.radius - slack).otherwise(least <= s.radius + slack)
            broken = F.when(F.col("same"), far > s.radius).otherwise(far <= s.radius)
            judged = met.select(*key, "same", F.col("a.f").alias("u"), F.col("b.f").alias("v"), broken.alias("broken"), doubt.alias("doubt"))
            judged = scratch.save(judged.where("broken or doubt"), f"judged{k}")
            bad = judged.where("broken").select(*key).distinct()
            out = out.unionByName(bad)
            seen = Observation()
            pairs = scratch.save(judged.where("not broken").join(bad, key, "left_anti").select(*pairs.columns).observe(seen, F.count(F.lit(1)).alias("n")), f"doubt{k}")
        return out


def _decide(low_a, high_a, rep_a, low_b, high_b, rep_b, same, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(same, broken, doubt) of pairs of boxes with one point each: is any pair of points too far apart, or not far enough?

    The bounds are rounded differently from the distance itself, hence the margin.
    """
    dist = lambda x: np.sqrt((x * x).sum(1))
    far = dist(rep_a - rep_b)
    least = dist(np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0))
    most = dist(np.maximum(high_a - low_b, high_b - low_a))
    broken = np.where(same, far > eps, far <= eps)
    doubt = ~broken & np.where(same, most > eps * (1 - 1e-9), least <= eps * (1 + 1e-9))
    return same, broken, doubt
