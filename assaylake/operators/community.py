"""Communities of a graph: detection, hierarchy, density, quality."""

from __future__ import annotations

import warnings
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from assaylake.plans.scratch import Scratch

MAX_ROUNDS = 100


def connected_components(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component), the component named by its smallest id.

    Alternating large-star and small-star rounds: each node's neighbourhood is
    reduced to its minimum, which needs about log n rounds of aggregates on any
    graph and never collects a component.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    links = scratch.save(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links0")
    last = None
    for k in range(1, max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_low.select("u", F.col("m").alias("v")))
        seen = Observation()
        new = small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        links = scratch.save(new, f"links{k}")
        scratch.drop(f"links{k - 1}")
        state = (seen.get["n"], seen.get["h"])
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"the components still change after {max_rounds - 1} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(nodes: DataFrame, edges: DataFrame, *, min_samples: int, core: DataFrame | None = None, min_size: int = 0) -> DataFrame:
    """(id, cluster): components over core nodes (degree >= min_samples); null for all others and small clusters."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= min_samples).select("id")
    cores = degree if core is None else degree.join(core.select("id"), "id", "left_semi")
    a, b = cores.select(F.col("id").alias("src")), cores.select(F.col("id").alias("dst"))
    inner = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    parts = connected_components(cores, inner)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_size).select("component")
    kept = parts.join(sizes, "component", "left_semi").select("id", F.col("component").alias("cluster"))
    return nodes.select("id").join(kept, "id", "left")


def label_propagation(nodes: DataFrame, edges: DataFrame, *, rounds: int = 20) -> DataFrame:
    """(id, community): synchronous weighted label propagation with a stay-put bonus; ties go to the smaller label.

    Labels of some graphs never come to rest; after ``rounds`` rounds a warning says so.
    """
    scratch = Scratch(nodes.sparkSession, "propagation")
    labels = scratch.save(nodes.select("id", F.col("id").alias("community")), "labels0")
    strength = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    for k in range(1, rounds + 1):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "community"), "dst").select("src", "community", "weight")
        stay = labels.join(strength, labels["id"] == strength["src"]).select("src", "community", (F.col("_all") * 0.1).alias("weight"))
        best = votes.unionByName(stay).groupBy("src", "community").agg(F.sum("weight").alias("w")).groupBy("src").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "community")).alias("b"))
        seen = Observation()
        new = labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("b.community", "community").alias("community"), (F.coalesce("b.community", "community") != F.col("community")).alias("moved"))
        labels = scratch.save(new.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")), f"labels{k}").select("id", "community")
        if not seen.get["moved"]:
            return labels
    warnings.warn(f"labels still move after {rounds} rounds", stacklevel=2)
    return labels


def _local_moves(n: int, indptr: np.ndarray, indices: np.ndarray, weights: np.ndarray, part: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Moves nodes to the neighbouring community of largest modularity gain until none moves."""
    strength = np.bincount(np.repeat(np.arange(n), np.diff(indptr)), weights, n)
    total = strength.sum()
    mass = np.bincount(part, strength, n)
    queue, waiting = deque(rng.permutation(n).tolist()), np.ones(n, bool)
    while queue:
        i = queue.popleft()
        waiting[i] = False
        near, w = indices[indptr[i] : indptr[i + 1]], weights[indptr[i] : indptr[i + 1]]
        own = part[i]
        to: dict[int, float] = {own: 0.0}
        for j, x in zip(near, w):
            if j != i:
                to[part[j]] = to.get(part[j], 0.0) + x
        mass[own] -= strength[i]
        gain = {c: x - resolution * strength[i] * mass[c] / total for c, x in to.items()}
        best = max(sorted(gain), key=lambda c: gain[c])
        if gain[best] <= gain[own] + 1e-12:
            best = own
        mass[best] += strength[i]
        if best != own:
            part[i] = best
            for j in near:
                if part[j] != best and not waiting[j]:
                    waiting[j] = True
                    queue.append(int(j))
    return part


def _refined(n: int, indptr: np.ndarray, indices: np.ndarray, weights: np.ndarray, part: np.ndarray, resolution: float, beta: float, rng: np.random.Generator) -> np.ndarray:
    """Parts within communities, grown from single nodes by random merges that don't lower the modularity.

    Only nodes and parts that are well connected to the rest of their community
    take part. A part is chosen with a chance that grows with its gain, the more
    sharply the smaller ``beta`` is.
    """
    strength = np.bincount(np.repeat(np.arange(n), np.diff(indptr)), weights, n)
    total = strength.sum()
    size = np.bincount(part, strength, n)  # strength of the communities
    fine, mass, alone = np.arange(n), strength.copy(), np.ones(n, bool)
    rows = np.repeat(np.arange(n), np.diff(indptr))
    inner = (part[rows] == part[indices]) & (rows != indices)
    outward = np.bincount(rows[inner], weights[inner], n)  # weight from a part to the rest of its community
    fits = lambda c, k: outward[c] >= resolution * mass[c] * (size[k] - mass[c]) / total
    for i in rng.permutation(n).tolist():
        k = part[i]
        if not alone[i] or not fits(i, k):
            continue
        to: dict[int, float] = {}
        for j, x in zip(indices[indptr[i] : indptr[i + 1]], weights[indptr[i] : indptr[i + 1]]):
            if j != i and part[j] == k:
                to[fine[j]] = to.get(fine[j], 0.0) + x
        names = [c for c in sorted(to) if c != i and fits(c, k)]
        gain = np.array([0.0, *(to[c] - resolution * strength[i] * mass[c] / total for c in names)])
        able = gain >= 0
        chance = np.where(able, np.exp(np.minimum((gain - gain.max()) / beta, 0)), 0.0)
        c = [i, *names][rng.choice(len(gain), p=chance / chance.sum())]
        if c != i:
            fine[i], alone[i], alone[c] = c, False, False
            mass[c] += strength[i]
            outward[c] += outward[i] - 2 * to[c]
            mass[i] = 0.0
    return fine


def _solutions(nodes: DataFrame, edges: DataFrame, runs: list[tuple], limit: int, solve) -> DataFrame:
    """(sample, id, community): ``solve(n, src, dst, weight, run)`` for each of ``runs`` in a task of its own."""
    from assaylake.operators.graph import undirected

    pairs = undirected(edges)
    if pairs.count() > limit:
        raise ValueError(f"more than {limit} edges; use label_propagation")
    kind = nodes.schema["id"].dataType.simpleString()

    def run(key, ids: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(ids["id"].to_numpy())
        pdf = pdf[pdf["src"].isin(names) & pdf["dst"].isin(names)].sort_values(["src", "dst"])
        part = solve(len(names), np.searchsorted(names, pdf["src"].to_numpy()), np.searchsorted(names, pdf["dst"].to_numpy()), pdf["weight"].to_numpy(float), runs[key[0]])
        return pd.DataFrame({"sample": np.int32(key[0]), "id": names, "community": part})

    each = lambda df: df.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1)))).groupBy("_s")
    return each(nodes.select("id").distinct()).cogroup(each(pairs)).applyInPandas(run, f"sample int, id {kind}, community int")


def leiden(nodes: DataFrame, edges: DataFrame, *, resolution: float = 1.0, random_seed: int = 0, iterations: int = 2, beta: float = 0.01, limit: int = 50_000_000) -> DataFrame:
    """(id, community): modularity communities by the Leiden method, numbered by decreasing size.

    ``edges`` is (src, dst, weight); the larger weight of both directions counts.
    ``beta`` is the randomness of the refinement. The optimisation runs in one task
    over the aggregated graph, as the order of moves matters; a graph of more than
    ``limit`` edges is refused, and :func:`label_propagation` is the distributed
    alternative. Equal seeds give equal results.
    """
    run = lambda n, a, b, w, r: communities(n, a, b, w, resolution, random_seed, iterations, beta)
    return _solutions(nodes, edges, [()], limit, run).select("id", "community")


def _stacked(solutions: DataFrame) -> DataFrame:
    """(id, codes ARRAY<INT>), one code a sample."""
    return solutions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sample", "community")))["community"].alias("codes"))


def leiden_matrix(nodes: DataFrame, edges: DataFrame, resolution: float | list[float], sample_n: int | None = None, *, beta: float | list[float] = 0.03, random_seed: int = 0, iterations: int = 2, limit: int = 50_000_000) -> DataFrame:
    """(id, codes ARRAY<INT>): repeated Leiden communities, one run a sample, seeds counted up from ``random_seed``.

    Without ``sample_n`` there are as many runs as the list of resolutions (or of
    betas) is long. Runs are independent tasks.
    """
    if sample_n is None:
        if not isinstance(resolution, list) and not isinstance(beta, list):
            raise ValueError("give sample_n, or a list of resolutions or betas")
        sample_n = len(resolution if isinstance(resolution, list) else beta)
    of = lambda x, i: x[i] if isinstance(x, list) else x
    runs = [(of(resolution, i), random_seed + i, of(beta, i)) for i in range(sample_n)]
    return _stacked(_solutions(nodes, edges, runs, limit, lambda n, a, b, w, r: communities(n, a, b, w, r[0], r[1], iterations, r[2])))


def random_neighbourhood_matrix(nodes: DataFrame, edges: DataFrame, n_clusters: int | list[int], sample_n: int, *, random_seed: int = 0, limit: int = 50_000_000) -> DataFrame:
    """(id, codes ARRAY<INT>): repeated random partitions into connected neighbourhoods, as :func:`leiden_matrix` stacks them."""
    runs = [(n_clusters[i] if isinstance(n_clusters, list) else n_clusters, random_seed + i) for i in range(sample_n)]
    return _stacked(_solutions(nodes, edges.withColumn("weight", F.lit(1.0)), runs, limit, lambda n, a, b, w, r: random_neighbourhoods(n, a, b, r[0], r[1])))


def communities(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float, seed: int, iterations: int, beta: float = 0.01) -> np.ndarray:
    """Local moves, refinement and aggregation of the refined parts, repeated; numbered by decreasing size."""
    rng = np.random.default_rng(seed)
    part = np.arange(n)
    for _ in range(iterations):
        members, a, b, w, size = np.arange(n), np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight]), n
        start = part.copy()
        while True:
            order = np.argsort(a, kind="stable")
            indptr = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=size))])
            moved = _local_moves(size, indptr, b[order], w[order], np.unique(start, return_inverse=True)[1].copy(), resolution, rng)
            part = moved[members]
            codes, compact = np.unique(_refined(size, indptr, b[order], w[order], moved, resolution, beta, rng), return_inverse=True)
            if len(codes) == size:
                break
            start = np.zeros(len(codes), np.int64)
            start[compact] = moved
            members, size = compact[members], len(codes)
            key = compact[a].astype(np.int64) * size + compact[b]
            uniq, inv = np.unique(key, return_inverse=True)
            a, b, w = uniq // size, uniq % size, np.bincount(inv, w)
        part = np.unique(_connected_parts(n, np.concatenate([src, dst]), np.concatenate([dst, src]), part), return_inverse=True)[1]
    sizes = np.bincount(part)
    rank = np.empty(len(sizes), int)
    rank[np.lexsort((np.arange(len(sizes)), -sizes))] = np.arange(len(sizes))
    return rank[part].astype("int32")


def _connected_parts(n: int, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Connected components within communities, by pointer jumping on minimum labels."""
    inside = part[a] == part[b]
    a, b = a[inside], b[inside]
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def modularity(edges: DataFrame, memberships: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """(modularity) of a partition (id, community) of an undirected graph given in both directions."""
    m = edges.agg(F.sum("weight")).scalar()
    a, b = memberships.select(F.col("id").alias("src"), F.col("community").alias("ca")), memberships.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("_in"), F.sum("weight").alias("_all"))
    return inner.agg(F.sum(F.col("_in") / m - resolution * (F.col("_all") / m) * (F.col("_all") / m)).alias("modularity"))


def contract(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """(ca, cb, n_edges), ca <= cb: undirected edges within and between communities."""
    a, b = memberships.select(F.col("id").alias("src"), F.col("community").alias("_a")), memberships.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(a, "src").join(b, "dst").groupBy(F.least("_a", "_b").alias("ca"), F.greatest("_a", "_b").alias("cb")).agg(F.count(F.lit(1)).alias("n_edges"))


def community_hierarchy(sizes: dict, links: dict) -> tuple[list[tuple[int, int, float, int]], list]:
    """Linkage and leaf order of communities; both inputs are as small as the number of communities squared.

    ``sizes`` maps a community to its cells, ``links`` an unordered pair to its
    edges. The pair of highest density E / (size a + size b) merges first (the
    first pair in order at a tie); its height is the inverse density. The leaf
    order places the larger links close to each other.
    """
    names = sorted(sizes)
    if len(names) < 3:
        raise ValueError("a hierarchy needs more than two communities")
    e = {}
    for (a, b), n in links.items():
        i, j = sorted((names.index(a), names.index(b)))
        if i != j:
            e[i, j] = e.get((i, j), 0) + n
    leaf_e, size, leaves, children, active = dict(e), [sizes[n] for n in names], [1] * len(names), {}, list(range(len(names)))
    linkage = []
    while len(active) > 1:
        density = lambda p: e.get(p, 0) / (size[p[0]] + size[p[1]])
        pairs = [(i, j) for x, i in enumerate(active) for j in active[x + 1 :]]
        i, j = max(pairs, key=density)
        d, new = density((i, j)), len(size)
        linkage.append((i, j, 1 / d if d else float("inf"), leaves[i] + leaves[j]))
        size.append(size[i] + size[j])
        leaves.append(leaves[i] + leaves[j])
        children[new] = (i, j)
        active = [k for k in active if k not in (i, j)]
        for k in active:
            e[k, new] = e.get((min(i, k), max(i, k)), 0) + e.get((min(j, k), max(j, k)), 0)
        active.append(new)

    def under(c: int) -> list[int]:
        return [c] if c not in children else under(children[c][0]) + under(children[c][1])

    def rho(a: int, b: int) -> float:
        x, y = under(a), under(b)
        return sum(leaf_e.get((min(p, q), max(p, q)), 0) for p in x for q in y) / (size[a] + size[b])

    root = len(size) - 1
    at, queue = {root: 0}, deque([root])
    while queue:
        node = queue.popleft()
        if node not in children:
            continue
        c0, c1 = children[node]
        x = at.pop(node)
        best = None
        for trial in ({c0: x, c1: x + leaves[c0]}, {c0: x + leaves[c1], c1: x}):
            seen = at | trial
            centre = {c: p + leaves[c] / 2 for c, p in seen.items()}
            score = sum(rho(a, b) / abs(centre[a] - centre[b]) for i, a in enumerate(seen) for b in list(seen)[i + 1 :])
            if best is None or score > best[0]:
                best = (score, trial)
        at |= best[1]
        queue.extend([c0, c1] if leaves[c0] < leaves[c1] else [c1, c0])
    order = [names[c] for c, _ in sorted(at.items(), key=lambda kv: kv[1])]
    return linkage, order


def community_tree(edges: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hierarchy of communities: (step, a, b, height, n_leaves) and (community, position).

    Clusters of ``linkage`` are numbered as communities are in order, merged ones
    from their number on. The driver sees one number for each pair of communities.
    """
    spark = edges.sparkSession
    kind = memberships.schema["community"].dataType.simpleString()
    named = memberships.where(F.col("community").isNotNull())
    sizes = {r.community: r.n for r in named.groupBy("community").agg(F.count(F.lit(1)).alias("n")).collect()}
    links = {(r.ca, r.cb): r.n_edges for r in contract(edges, named).where("ca <> cb").collect()}
    linkage, order = community_hierarchy(sizes, links)
    steps = spark.createDataFrame([(k, a, b, float(h), n) for k, (a, b, h, n) in enumerate(linkage)], "step int, a int, b int, height double, n_leaves int")
    return steps, spark.createDataFrame([(c, i) for i, c in enumerate(order)], f"community {kind}, position int")


def silhouettes(points: DataFrame, *, block_rows: int = 8_192) -> DataFrame:
    """(id, cluster, silhouette) from mean Euclidean distances; points is (id, vec, cluster), with labels of any type.

    Every block of points is compared with every other one inside an Arrow
    function, which returns one sum per point and cluster. A point alone in its
    cluster has silhouette 0.
    """
    from assaylake.operators.graph import _compare, euclidean

    labelled = points.where("cluster is not null")
    codes = labelled.select("cluster").distinct().select("cluster", F.xxhash64("cluster").alias("_h"))
    order = Window.orderBy("_h", "cluster")  # one row a cluster
    codes = codes.withColumn("_code", F.row_number().over(order).cast("double")).drop("_h")
    labelled = labelled.join(codes, "cluster")
    packed = labelled.select("id", F.concat(F.col("vec").cast("array<double>"), F.array("_code")).alias("vec"))

    def sums(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame(columns=["id", "other", "total"], dtype=object)
        x, y = np.stack(q["q_vec"].to_numpy()), np.stack(b["b_vec"].to_numpy())
        codes, inv = np.unique(y[:, -1], return_inverse=True)
        hot = np.eye(len(codes))[inv]
        d = np.vstack([euclidean(x[i : i + 256, :-1], y[:, :-1]) @ hot for i in range(0, len(x), 256)])
        return pd.DataFrame({"id": np.repeat(q["q_id"].to_numpy(), len(codes)), "other": np.tile(codes, len(x)), "total": d.ravel()})

    kind = points.schema["id"].dataType.simpleString()
    s = _compare(packed, packed, block_rows, sums, f"id {kind}, other double, total double").groupBy("id", "other").agg(F.sum("total").alias("total"))
    n = labelled.groupBy(F.col("_code").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    rows = s.join(n, "other").join(labelled.select("id", "cluster", "_code"), "id")
    own = F.col("other") == F.col("_code")
    ab = rows.groupBy("id", "cluster").agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return ab.select("id", "cluster", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def assortativity(edges: DataFrame, active: DataFrame) -> DataFrame:
    """(assortativity) of the subgraph of active nodes, from the remaining-degree distribution.

    Edges are taken in both directions once; q(k) is (k + 1) P(k + 1) over the
    support of P, renormalised.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    inner = both.join(active.select(F.col("id").alias("src")), "src", "left_semi").join(active.select(F.col("id").alias("dst")), "dst", "left_semi")
    degree = active.select("id").join(inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").na.fill(0, ["d"])
    p = degree.groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = p.agg(F.sum("c")).scalar()
    p = p.select(F.col("d").alias("k"), (F.col("c") / total).alias("p"))
    shifted = p.select((F.col("k") - 1).alias("k"), (F.col("k") * F.col("p")).alias("q"))
    q = p.join(shifted, "k", "left").select("k", "p", F.coalesce("q", F.lit(0.0)).alias("q"))
    qs = q.agg(F.sum("q")).scalar()
    q = q.select("k", F.try_divide(F.col("q"), qs).alias("q"))
    moments = q.agg(F.sum(F.col("k") * F.col("q")).alias("m"), F.sum(F.col("k") * F.col("k") * F.col("q")).alias("m2"))
    dq = degree.join(q, degree["d"] == q["k"]).select("id", "q")
    s = inner.join(dq.select(F.col("id").alias("src"), F.col("q").alias("qa")), "src").join(dq.select(F.col("id").alias("dst"), F.col("q").alias("qb")), "dst").agg(F.coalesce(F.sum(F.col("qa") * F.col("qb")), F.lit(0.0)).alias("s"))
    return moments.select(F.try_divide(s.scalar() - F.col("m") * F.col("m"), F.col("m2") - F.col("m") * F.col("m")).alias("assortativity"))


def random_neighbourhoods(n: int, src: np.ndarray, dst: np.ndarray, n_clusters: int, seed: int) -> np.ndarray:
    """Balanced partition by breadth-first growth from random seeds."""
    rng = np.random.default_rng(seed)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].append(b)
        near[b].append(a)
    part = np.full(n, -1)
    queues = [deque([s]) for s in rng.permutation(n)[:n_clusters].tolist()]
    free = deque(rng.permutation(n).tolist())
    left = n
    while left:
        for c, q in enumerate(queues):
            while q and part[q[0]] >= 0:
                q.popleft()
            if not q:
                while free and part[free[0]] >= 0:
                    free.popleft()
                if not free:
                    break
                q.append(free[0])
            i = q.popleft()
            part[i] = c
            left -= 1
            q.extend(j for j in near[i] if part[j] < 0)
            if not left:
                break
    return part.astype("int32")
