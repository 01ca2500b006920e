"""The k most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample by splitting clusters of equal size
again and again. A vector near a border is a member of several lists; as a
query it looks into the lists whose centroids are nearly as close as the
closest. How nearly is a distance ratio that is calibrated on the sample for a
wanted recall. Centroids are found by a walk over their neighbour graph, held
in memory. Neighbouring lists form groups of bounded size, each a task of
matrix products, so that a vector is sent once to each group and not to each
list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sizing import broadcast_if_small, durable, written

#: Lists for n vectors: LISTS_PER_ROOT times the root of n, with at least PER_LIST vectors each.
LISTS_PER_ROOT, PER_LIST = 6.0, 24
#: Vectors in the sample for each list, and such of them at most as the ratio is calibrated by.
SAMPLED, CALIBRATED = 24, 1_500
#: Share of the sample's nearest pairs that the lists must hold.
RECALL = 0.94
#: Lists that a vector is a member of, at most, and how much farther than the nearest their centroids may be.
REPLICAS, REPLICA_RATIO = 2, 1.2
#: A list is left out if another chosen list is nearer to it than the vector by this factor.
CROWDED = 1.0
#: Lists that the walk gives for a vector; a query looks into those of them that the ratio leaves.
WIDTH = 96
#: Members and queries of one task, at most about so many, and scores that it makes at once.
MEMBER_BLOCK, QUERY_BLOCK, SCORES = 20_000, 16_384, 1_000_000
#: Candidates are scored again in double precision: so many beyond k, and all within what single precision may be off.
SPARE, ROUNDING = 1, 1e-5
#: Neighbours of a centroid in the graph, centroids from which a step of the walk goes on, steps, and vectors that walk together.
DEGREE, BEAM, STEPS, TOGETHER = 24, 12, 3, 128


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _pack(rows) -> list[bytes]:
    return [np.asarray(x, np.float32).tobytes() for x in rows]


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def _far(close: np.ndarray) -> np.ndarray:
    """Distances of unit vectors by their cosines."""
    return np.sqrt(np.maximum(0, 2 - 2 * close))


def fit_centroids(x: np.ndarray, lists: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, sizes) of about ``lists`` clusters of nearly equal size, close clusters one after the other."""
    rng = np.random.default_rng(seed)
    leaf = max(1.0, len(x) / lists)
    out: list[np.ndarray] = []
    held: list[int] = []
    stack = [x]
    while stack:
        part = stack.pop()
        ways = int(min(8, round(len(part) / leaf)))
        if ways < 2:
            out.append(_unit(part.mean(0, keepdims=True))[0])
            held.append(len(part))
            continue
        centres = part[rng.choice(len(part), ways, replace=False)]
        for _ in range(6):
            close = part @ centres.T
            # Each centre takes its share of the vectors that prefer it most over their next choice.
            own = close.argmax(1)
            room = -(-len(part) * 5 // (ways * 4))
            for c in range(ways):
                mine = np.flatnonzero(own == c)
                if len(mine) > room:
                    rest = close[mine].copy()
                    rest[:, c] = -2
                    spare = mine[np.argsort(close[mine, c] - rest.max(1), kind="stable")[: len(mine) - room]]
                    close[spare, c] = -2
                    own[spare] = close[spare].argmax(1)
            centres = _unit(np.stack([part[own == c].mean(0) if (own == c).any() else part[rng.integers(len(part))] for c in range(ways)]))
        sizes = np.bincount(own, minlength=ways)
        if sizes.max() == len(part):  # vectors that can't be told apart
            out.append(centres[own[0]])
            held.append(len(part))
            continue
        stack += [part[own == c] for c in range(ways) if sizes[c]]
    return np.stack(out).astype(np.float32), np.array(held, np.int32)


def neighbour_graph(centroids: np.ndarray, block: int = 1_024) -> np.ndarray:
    """Numbers of the DEGREE nearest other centroids of each, worked out in blocks."""
    degree = min(DEGREE, len(centroids) - 1)
    near = np.zeros((len(centroids), degree), np.int32)
    for s in range(0, len(centroids) if degree else 0, block):
        close = centroids[s : s + block] @ centroids.T
        close[np.arange(len(close)), np.arange(s, s + len(close))] = -2
        near[s : s + block] = np.argpartition(-close, degree - 1, axis=1)[:, :degree]
    return near


class Lists:
    """Posting lists by their centroids: which lists a vector is a member of, and which it looks into.

    radius: the middle distance of vectors from their nearest centroid. Ratios
    are taken of it for vectors that lie nearer to a centroid, so that one that
    is itself a centroid has neighbouring lists too. sizes: vectors that each
    list was fitted on; a query looks into the nearest lists at any ratio until
    they have ``least`` of them, so that it finds enough neighbours.
    """

    def __init__(self, centroids: np.ndarray, near: np.ndarray, sizes: np.ndarray, least: int, radius: float = 0.0, ratio: float = 1.0):
        self.c, self.near, self.sizes, self.least, self.radius, self.ratio = centroids, near, sizes, least, radius, ratio
        n = len(centroids)
        self.hubs = np.unique(np.linspace(0, n - 1, min(n, 8 + int(2 * n**0.5))).astype(int))

    def search(self, x: np.ndarray, want: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of centroids, distances), the nearest ``want`` first; unit vectors that enter at one hub walk together."""
        want = min(want, len(self.c))
        at, close = np.empty((len(x), want), np.int32), np.empty((len(x), want), np.float32)
        to_hubs = x @ self.c[self.hubs].T
        order = np.argsort(to_hubs.argmax(1), kind="stable")
        for s in range(0, len(x), TOGETHER):
            rows = order[s : s + TOGETHER]
            at[rows], close[rows] = self._walk(x[rows], to_hubs[rows], want)
        return at, _far(close)

    def _walk(self, x: np.ndarray, to_hubs: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        entry = min(4, len(self.hubs))
        held = self.hubs[np.unique(np.argpartition(-to_hubs, entry - 1, axis=1)[:, :entry])]
        seen, left = np.zeros(len(self.c), bool), np.zeros(len(self.c), bool)
        seen[held] = True
        close = x @ self.c[held].T
        step = 0
        while step < STEPS or len(held) < want:
            beam = min(BEAM, len(held))
            front = np.unique(held[np.argpartition(-close, beam - 1, axis=1)[:, :beam]])
            front = front[~left[front]] if step < STEPS else np.flatnonzero(seen & ~left)
            left[front] = True
            new = np.unique(self.near[front])
            new = new[~seen[new]]
            if not len(new):
                if len(held) >= want or seen.all():
                    break
                new = np.flatnonzero(~seen)[:want] if not len(front) else new  # a part of the graph without a way in
            seen[new] = True
            held = np.concatenate([held, new])
            close = np.hstack([close, x @ self.c[new].T])
            step += 1
        best = np.argpartition(-close, want - 1, axis=1)[:, :want]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(close, best, 1), axis=1, kind="stable"), 1)
        return held[best], np.take_along_axis(close, best, 1)

    def members(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Mask of the lists that vectors are members of."""
        front = min(REPLICAS + 4, at.shape[1])
        mask = far <= REPLICA_RATIO * np.maximum(far[:, :1], self.radius)
        mask[:, 0], mask[:, front:] = True, False
        # No copy in a list that is nearer to a list already chosen than to the vector.
        own = self.c[at[:, :front]]
        between = _far(own @ own.transpose(0, 2, 1))
        for j in range(1, front):
            mask[:, j] &= ~(mask[:, :j] & (between[:, j, :j] * CROWDED <= far[:, j : j + 1])).any(1)
        return mask & (np.cumsum(mask, axis=1) <= REPLICAS)

    def needed(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The ratio from which a query looks into each list, 0 for those that it always does."""
        sizes = self.sizes[at]
        return np.where(np.cumsum(sizes, axis=1) - sizes < self.least, 0, far / np.maximum(np.maximum(far[:, :1], self.radius), 1e-6))

    def queries(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Mask of the lists that queries look into."""
        return self.needed(at, far) <= self.ratio

    def calibrate(self, x: np.ndarray, asks: int, k: int, recall: float) -> None:
        """Sets radius and ratio so that the first ``asks`` of the unit vectors x find this share of their ``k`` nearest among x."""
        best = np.empty((asks, k), int)
        for s in range(0, asks, 256):
            close = x[s : min(s + 256, asks)] @ x.T
            close[np.arange(len(close)), np.arange(s, s + len(close))] = -2
            best[s : s + 256] = np.argpartition(-close, k - 1, axis=1)[:, :k]
        used, at_used = np.unique(best, return_inverse=True)
        own, far = self.search(x[:asks])
        self.radius = float(np.median(far[:, 0]))
        homes = np.full((len(used), min(REPLICAS + 4, own.shape[1])), -1)
        for s in range(0, len(used), 4_096):
            lists, off = self.search(x[used[s : s + 4_096]])
            homes[s : s + 4_096] = np.where(self.members(lists, off), lists, -1)[:, : homes.shape[1]]
        needed, at_used = self.needed(own, far), at_used.reshape(best.shape)
        wanted = np.empty(best.shape)
        for i in range(asks):
            spot = np.full(len(self.c), np.inf)
            spot[own[i]] = needed[i]
            wanted[i] = np.where(homes[at_used[i]] >= 0, spot[homes[at_used[i]]], np.inf).min(1)
        wanted = np.sort(wanted, axis=None)
        self.ratio = float(min(wanted[int(np.ceil(recall * wanted.size)) - 1], needed.max())) + 1e-6


def fit_lists(x: np.ndarray, lists: int, n: int, k: int, recall: float = RECALL, seed: int = 1) -> Lists:
    """Lists fitted on a sample x of n vectors.

    They are calibrated by pairs as near in the sample as the ``k`` nearest are
    among all, of vectors that were fitted on in the same share as all are.
    """
    x = np.unique(_unit(x.astype(np.float32)), axis=0)
    x = x[np.random.default_rng(seed).permutation(len(x))]
    asks = min(CALIBRATED, len(x))
    aside = int(asks * max(0.0, 1 - len(x) / n))
    centroids, sizes = fit_centroids(x[aside:], lists, seed)
    found = Lists(centroids, neighbour_graph(centroids), sizes, 2 * (k + 1))
    near = min(max(1, round(k * len(x) / n)), len(x) - 1)
    if len(centroids) > 1 and near:
        found.calibrate(x, asks, near, recall)
    return found


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) without null keys, and with vectors of ``dim`` finite numbers that aren't all zero; one vector for each id."""
    slim = vectors.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists("v", lambda x: x != 0)
    return slim.where((F.size("v") == dim) & F.col("id").isNotNull()).where(good).groupBy("id").agg(F.min("v").alias("v"))


def _with_members(base: DataFrame, k: int) -> DataFrame:
    """(id, v, member): of equal vectors only the ``k`` + 1 smallest ids are members."""
    hashed = base.withColumn("h", F.xxhash64("v"))
    crowds = durable(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h"))
    if crowds.isEmpty():
        return base.withColumn("member", F.lit(True))
    crowds = broadcast_if_small(crowds)
    ranked = hashed.join(crowds, "h", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id")))
    first = ranked.where(F.col("r") <= k + 1).select("id", F.lit(True).alias("member"))  # planned as a limit by group ahead of the shuffle
    many = hashed.join(crowds, "h", "left_semi").join(first, "id", "left").select("id", "v", F.coalesce("member", F.lit(False)).alias("member"))
    return many.unionByName(hashed.join(crowds, "h", "left_anti").select("id", "v", F.lit(True).alias("member")))


def _by_list(packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists, places, starts): the lists that rows name, and where in ``places`` the rows of each begin."""
    counts = packed.map(len).to_numpy() // 4
    lists = np.frombuffer(b"".join(packed), np.int32)
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(lists, kind="stable")
    names, starts = np.unique(lists[order], return_index=True)
    return names, rows[order], np.append(starts, len(order))


def _candidates(members: pd.DataFrame, queries: pd.DataFrame, m32: np.ndarray, q32: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) numbers, by query and falling score: at least the ``keep`` best of each query in its lists, ties included.

    A list's ``keep``-th best score is a bound that none of a query's best is
    under, so what is held of a list is what reaches the bounds of the lists so
    far; what doesn't reach the last bound is dropped at the end.
    """
    homes, who = _by_list(members["lists"]), _by_list(queries["lists"])
    bound = np.full(len(queries), -2, np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in zip(*np.intersect1d(homes[0], who[0], return_indices=True)[1:]):
        mine, own = homes[1][homes[2][i] : homes[2][i + 1]], who[1][who[2][j] : who[2][j + 1]]
        step = max(1, SCORES // len(mine))
        for s in range(0, len(own), step):
            some = own[s : s + step]
            scores = q32[some] @ m32[mine].T
            if len(mine) >= keep:
                bound[some] = np.maximum(bound[some], np.partition(scores, len(mine) - keep, axis=1)[:, len(mine) - keep] - ROUNDING)
            rows, cols = np.nonzero(scores >= bound[some][:, None])
            held.append((some[rows], mine[cols], scores[rows, cols]))
    if not held:
        return np.zeros(0, int), np.zeros(0, int)
    q, m, score = (np.concatenate(x) for x in zip(*held))
    good = score >= bound[q]
    q, m, score = q[good], m[good], score[good]
    first = np.unique(q * len(members) + m, return_index=True)[1]  # a member may be met in several lists
    q, m, score = q[first], m[first], score[first]
    order = np.lexsort((-score, q))
    q, m, score = q[order], m[order], score[order]
    last = np.searchsorted(q, np.arange(len(queries))) + keep - 1
    full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(len(queries)))
    bound[full] = score[last[full]] - ROUNDING
    good = score >= bound[q]
    return q[good], m[good]


def _within_group(k: int, dim: int):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        members, queries = rows[~asks].sort_values("id"), rows[asks]
        if members.empty or queries.empty:
            return pd.DataFrame({"id": [], "near": [], "cosine": []})
        m64, q64 = (_unit(_unpack(x["v"], dim).astype(np.float64)) for x in (members, queries))
        ids, names = members["id"].to_numpy(), queries["id"].to_numpy()
        q, m = _candidates(members, queries, m64.astype(np.float32), q64.astype(np.float32), k + 1 + SPARE)
        exact = np.concatenate([np.einsum("bd,bd->b", q64[q[s : s + 50_000]], m64[m[s : s + 50_000]]) for s in range(0, len(q), 50_000)] or [np.zeros(0)])
        exact = np.round(exact, 12)
        order = np.lexsort((m, -exact, q))
        q, m, exact = q[order], m[order], exact[order]
        other = m != pd.Index(ids).get_indexer(names)[q]
        q, m, exact = q[other], m[other], exact[other]
        starts = np.searchsorted(q, np.arange(len(names) + 1))
        near, ends = ids[m], np.minimum(starts[1:], starts[:-1] + k)
        parts = [(s, e) for s, e in zip(starts[:-1].tolist(), ends.tolist())]
        return pd.DataFrame({"id": names, "near": [near[s:e].tolist() for s, e in parts], "cosine": [exact[s:e].tolist() for s, e in parts]})

    return run


def fitted(base: DataFrame, n: int, k: int, dim: int, lists: int | None = None, recall: float = RECALL) -> Lists:
    """Lists for the ``n`` vectors of ``base``, fitted on a sample of about SAMPLED a list in one task."""
    lists = lists or int(max(1, min(LISTS_PER_ROOT * n**0.5, n / PER_LIST)))
    share = min(1.0, SAMPLED * lists / n)
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)) < int(share * 1_000_000_007))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = [np.stack(b["v"].to_list()).astype(np.float32) for b in batches if len(b)]
        if x:
            x = np.concatenate(x)
            x = x[np.lexsort(x.T)]  # the same lists, however rows arrive
            own = fit_lists(x, lists, n, k, recall)
            yield pd.DataFrame({"c": _pack(own.c), "near": [row.tobytes() for row in own.near], "size": own.sizes, "radius": own.radius, "ratio": own.ratio})

    found = sample.select("v").repartition(1).mapInPandas(fit, "c binary, near binary, size int, radius double, ratio double").collect()  # a row for each list
    if not found:
        return Lists(np.eye(1, dim, dtype=np.float32), np.zeros((1, 0), np.int32), np.zeros(1, np.int32), 1)
    near = np.frombuffer(b"".join(r["near"] for r in found), np.int32).reshape(len(found), -1)
    return Lists(_unpack([r["c"] for r in found], dim), near, np.array([r["size"] for r in found]), 2 * (k + 1), found[0]["radius"], found[0]["ratio"])


def nearest(vectors: DataFrame, key: str = "id", vector: str = "embedding", k: int = 10, dim: int = 64, lists: int | None = None, recall: float = RECALL) -> DataFrame:
    """(id, neighbour, cosine, place): the ``k`` most similar other ids of every usable vector.

    Null, short, long, all-zero vectors and such with a null, NaN or infinity
    take no part; repeated ids count once. Ties go to the smaller id. Of vectors
    that are the same, only the k + 1 smallest ids need be members, so a crowd
    of copies makes no list long; all of them get their neighbours. Fewer than
    two usable vectors give no rows. The lists are fitted on a sample that grows
    with the root of the number of vectors; every vector is indexed and is a
    query. ``recall`` is the share of nearest pairs that the lists are
    calibrated for.
    """
    spark = vectors.sparkSession
    base = written(usable(vectors, key, vector, dim))
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, place int")
    index = fitted(base, n, k, dim, lists, recall)
    shared = spark.sparkContext.broadcast((index.c, index.near, index.sizes, index.least, index.radius, index.ratio))
    total = len(index.c)
    # Lists by number are close to each other; so many of them have about MEMBER_BLOCK members.
    per_group = max(1, int(MEMBER_BLOCK * total / (REPLICAS * n)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lists(*shared.value)
        for batch in batches:
            raw = np.stack(batch["v"].to_list()).astype(np.float32)
            at, far = own.search(_unit(raw))
            masks = (own.members(at, far) & batch["member"].to_numpy()[:, None], own.queries(at, far))
            packed, ids = np.array(_pack(raw), object), batch["id"].to_numpy()
            for asks, mask in enumerate(masks):
                rows, cols = np.nonzero(mask)
                chosen = at[rows, cols]
                order = np.lexsort((chosen, rows))
                rows, chosen = rows[order], chosen[order]
                group = chosen // per_group
                first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (group[1:] != group[:-1])][: len(rows)])
                data, ends = chosen.tobytes(), np.append(first[1:], len(rows))
                yield pd.DataFrame({"group": group[first], "asks": bool(asks), "id": ids[rows[first]], "v": packed[rows[first]], "lists": [data[4 * s : 4 * e] for s, e in zip(first.tolist(), ends.tolist())]})

    placed = written(_with_members(base, k).mapInPandas(assign, "group int, asks boolean, id string, v binary, lists binary"))
    sizes = placed.groupBy("group").agg(F.count_if(~F.col("asks")).alias("m"), F.count_if("asks").alias("q"))
    blocks = sizes.select("group", F.ceil(F.col("m") / (2 * MEMBER_BLOCK)).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb"))
    spread = placed.join(F.broadcast(blocks), "group")  # a row for each group, fewer than lists
    mb, qb = F.greatest("mb", F.lit(1)), F.greatest("qb", F.lit(1))
    # Each block of members meets each block of queries of its group.
    own = F.xxhash64("id", F.lit(3))
    a = F.when(F.col("asks"), F.sequence(F.lit(0), mb - 1)).otherwise(F.array(F.pmod(own, mb).cast("int")))
    b = F.when(F.col("asks"), F.array(F.pmod(own, qb).cast("int"))).otherwise(F.sequence(F.lit(0), qb - 1))
    tasks = spread.select("group", F.explode(a).alias("a"), b.alias("b"), "asks", "id", "v", "lists").withColumn("b", F.explode("b"))
    parts = tasks.groupBy("group", "a", "b").applyInPandas(_within_group(k, dim), "id string, near array<string>, cosine array<double>")
    pairs = F.arrays_zip(F.transform("cosine", lambda c: -c).alias("less"), F.col("near"))
    merged = parts.groupBy("id").agg(F.flatten(F.collect_list(pairs)).alias("all"))
    best = merged.select("id", F.posexplode(F.slice(F.array_sort(F.array_distinct("all")), 1, k)).alias("place", "x"))
    return best.select("id", F.col("x.near").alias("neighbour"), (-F.col("x.less")).alias("cosine"), (F.col("place") + 1).alias("place"))


def close_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the other's neighbours, with at least this cosine."""
    near = neighbours.where(F.col("cosine") >= least)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
