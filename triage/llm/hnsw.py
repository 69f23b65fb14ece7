"""Near-duplicate vectors through hierarchical navigable small-world graphs per shard.

Vectors are compared only under equal labels. Equal vectors become one node with a weight. A
label's nodes are cut into shards of at most about ``shard_size``; each shard builds a graph and
writes it as one row. Every shard is queried with its own block of nodes and those of the shards behind
it, each pair (shard, block) in a task of its own that holds one graph and one block, sorted by node;
a link between two shards counts at both ends. Walks are in single precision and in
lockstep for many queries. The beam is doubled until audits at the threshold find everything they look for,
and a query whose whole beam is above the threshold is repeated with a wider one. Links are verified by cosine in double precision. A task gives per node the weight of its links
and a spanning forest of them, never the pairs.

Defined results: a vector that is null, has length or norm zero, or holds a null or non-finite
component links with nothing, nor does one with a null label or id; vectors of different
lengths are not compared. Repeated rows and copies link like any others.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.components import components
from triage.llm.tables import Table, ship

#: Neighbours a new node chooses, places of a list, and places left when a full list is thinned out.
M, PLACES, THINNED = 12, 32, 20
BUILD_BEAM, BATCH, SMALL = 48, 256, 64
#: Numbers (queries x nodes or vectors x dimensions) worked on at once.
CELLS = 1 << 23


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

    Nodes of upper layers come first, so a layer is a number of nodes and a table of neighbours.
    Batches of nodes are placed by beams over the nodes before them and by their likeness to each other.
    """

    def __init__(self, unit: np.ndarray, seed: int = 1):
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        levels = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(M)).astype(int)
        #: The row of ``unit`` each node stands for.
        self.rows = np.argsort(-levels, kind="stable")
        self.vectors = np.ascontiguousarray(unit[self.rows], dtype=np.float32)
        sizes = [int((levels >= k).sum()) for k in range(levels.max(initial=0) + 1)]
        #: Neighbours by layer, the smallest first; layers of at most SMALL nodes but one are left out.
        self.layers: list[np.ndarray] = []
        upper = [m for m in sizes[1:] if m > SMALL]
        for m in [*reversed(upper), n]:
            self._grow(m)
        if n:
            self._join_islands()

    def _starts(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """Nodes to start from below ``layers``."""
        top = min(len(self.vectors), SMALL)
        at = np.argsort(-(q @ self.vectors[:top].T), axis=1)[:, :4]
        for table in layers:
            at = self._beam(table, q, at, 4)[0]
        return at

    def _beam(self, table: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the nodes nearest to it that a beam of ``width`` reaches, best first (-1: none), with cosines."""
        count, size = len(q), len(table)
        step = max(4, width // 16)
        seen = np.zeros((count, size + 1), dtype=bool)  # the last place stands for no node
        seen[:, size] = True
        ids = np.full((count, width), -1, dtype=np.int64)
        sims = np.full((count, width), -np.inf, dtype=np.float32)
        fresh = np.zeros((count, width), dtype=bool)

        def take(rows: np.ndarray, found: np.ndarray) -> None:
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            known = seen[rows[:, None], found]
            found = np.where(known, -1, found)
            keep = ~known.all(axis=0)
            found = found[:, keep]
            at, col = np.nonzero(found >= 0)
            own = found[at, col]
            seen[rows[at], own] = True
            s = np.full(found.shape, -np.inf, dtype=np.float32)
            s[at, col] = np.einsum("nd,nd->n", self.vectors[own], q[rows[at]])
            every, all_s = np.concatenate([ids[rows], found], axis=1), np.concatenate([sims[rows], s], axis=1)
            new = np.concatenate([fresh[rows], found >= 0], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            ids[rows] = np.take_along_axis(every, order, axis=1)
            sims[rows] = np.take_along_axis(all_s, order, axis=1)
            fresh[rows] = np.take_along_axis(new, order, axis=1)

        rows = np.arange(count)
        take(rows, starts.astype(np.int64))
        while len(rows := np.flatnonzero(fresh.any(axis=1))):
            at = np.argsort(~fresh[rows], axis=1, kind="stable")[:, :step]
            good = np.take_along_axis(fresh[rows], at, axis=1)
            nodes = np.where(good, np.take_along_axis(ids[rows], at, axis=1), -1)
            fresh[rows[:, None], at] = False
            found = np.where(nodes[..., None] >= 0, table[nodes], -1).reshape(len(rows), -1)
            take(rows, found.astype(np.int64))
        return ids, sims

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, best first, those nearer to the node than to the ones chosen before; then the best others."""
        v = self.vectors[ids]
        between = v @ v.transpose(0, 2, 1)
        free = ids >= 0
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)
        row = np.arange(len(ids))
        out = np.full((len(ids), most), -1, dtype=np.int32)
        for k in range(most):
            open_ = free & (closest < sims)
            apart = open_.any(axis=1)
            pick = np.where(apart, open_.argmax(axis=1), free.argmax(axis=1))
            good = free[row, pick]
            if not good.any():
                break
            out[good, k] = ids[row[good], pick[good]]
            free[row, pick] = False
            closest = np.where(apart[:, None], np.maximum(closest, between[row, pick]), closest)
        return out

    def _grow(self, size: int) -> None:
        """Add a layer of the first ``size`` nodes below those there are."""
        table = np.full((size, PLACES), -1, dtype=np.int32)
        above, upper = self.layers, len(self.layers[-1]) if self.layers else 0
        a = 0
        while a < size:
            b = min(size, a + (SMALL if a == 0 else min(BATCH, a)))
            q = self.vectors[a:b]
            within = q @ q.T
            np.fill_diagonal(within, -np.inf)
            near = np.argsort(-within, axis=1)[:, : 2 * M]
            ids, sims = near + a, np.take_along_axis(within, near, axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            if a:
                # Nodes of upper layers may not be placed here yet: those start from the first ones.
                starts = self._starts(q, above) if a >= upper else np.tile(np.arange(4), (b - a, 1))
                far, far_sims = self._beam(table[:a], q, np.where(starts < a, starts, -1), BUILD_BEAM)
                ids, sims = np.concatenate([far, ids], axis=1), np.concatenate([far_sims, sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            table[a:b, :M] = self._choose(ids, sims, M)
            self._link_back(table, a, b)
            a = b
        self.layers.append(table)

    def _link_back(self, table: np.ndarray, a: int, b: int) -> None:
        """Give the neighbours of the nodes from a to b a way back."""
        node, col = np.nonzero(table[a:b, :M] >= 0)
        node = node + a
        other = table[node, col].astype(np.int64)
        sims = np.einsum("nd,nd->n", self.vectors[node], self.vectors[other])
        order = np.lexsort((-sims, other))
        node, other = node[order], other[order]
        first = np.concatenate([[True], other[1:] != other[:-1]])
        rank = np.arange(len(other)) - np.maximum.accumulate(np.where(first, np.arange(len(other)), 0))
        keep = rank < THINNED
        node, other, rank = node[keep], other[keep], rank[keep]
        targets, place = np.unique(other, return_inverse=True)
        extra = np.full((len(targets), int(rank.max(initial=0)) + 1), -1, dtype=np.int64)
        extra[place, rank] = node
        # A way back that is there already is left out.
        own = table[targets].astype(np.int64)
        extra[(extra[:, :, None] == own[:, None, :]).any(axis=2)] = -1
        ids = np.concatenate([own, extra], axis=1)
        ids = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)
        count = (ids >= 0).sum(axis=1)
        fits = count <= PLACES
        table[targets[fits]] = ids[fits, :PLACES]
        for part in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // BATCH))):
            if len(part):
                over, t = ids[part], targets[part]
                s = np.einsum("ncd,nd->nc", self.vectors[over], self.vectors[t])
                s = np.where(over >= 0, s, -np.inf)
                order = np.argsort(-s, axis=1, kind="stable")
                over, s = np.take_along_axis(over, order, axis=1), np.take_along_axis(s, order, axis=1)
                table[t] = -1
                table[t, :THINNED] = self._choose(over, s, THINNED)

    def _join_islands(self) -> None:
        """Link nodes that thinning has cut off to the nearest that can be reached."""
        table, n = self.layers[-1], len(self.vectors)
        seen = np.zeros(n, dtype=bool)

        def flood(front: np.ndarray) -> None:
            while len(front):
                seen[front] = True
                front = np.unique(table[front])
                front = front[front >= 0]
                front = front[~seen[front]]

        flood(np.array([0]))
        for i in np.flatnonzero(~seen).tolist():
            if seen[i]:
                continue
            near = self.search(self.vectors[i : i + 1], BUILD_BEAM)[0][0]
            near = near[(near >= 0)]
            near = near[seen[near]]
            near = near if len(near) else np.array([0])
            room = (table[near] < 0).any(axis=1)
            if not room.any():
                table = self.layers[-1] = np.hstack([table, np.full((n, 4), -1, dtype=np.int32)])
                room[0] = True
            x = int(near[int(room.argmax())])
            table[x, int((table[x] < 0).argmax())] = i
            flood(np.array([i]))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the nodes that a beam of ``width`` finds, best first (-1: none), and their cosines."""
        n = len(self.vectors)
        if width >= n:  # every node
            sims = q @ self.vectors.T
            order = np.argsort(-sims, axis=1)
            return order, np.take_along_axis(sims, order, axis=1)
        return self._beam(self.layers[-1], q, self._starts(q, self.layers[:-1]), width)


def links_above(
    graph: Graph, raw: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries' places, rows of ``raw``) of all pairs at a cosine of ``threshold`` or more, some queries at a time.

    ``raw`` holds the vectors of the graph's rows. The beam of all queries is doubled until two audits pass:
    nodes drawn from the shard and turned away to a cosine of exactly the threshold are all found, and so
    is every link that brute force finds for queries spread over the block. A query whose whole beam is that
    near is repeated with a wider one.
    """
    n = len(raw)
    norms, asked = np.linalg.norm(raw, axis=1), np.linalg.norm(queries, axis=1)
    unit = (queries / asked[:, None]).astype(np.float32)
    slack = np.float32(threshold - 1e-5)

    def exact(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether pairs reach the threshold, in double precision."""
        cos = np.einsum("nd,nd->n", queries[at], raw[rows]) / (asked[at] * norms[rows])
        out = cos >= threshold
        # So near to it the sums are formed once more without rounding between the steps.
        for k in np.flatnonzero(np.abs(cos - threshold) <= 1e-12):
            v, q = raw[rows[k]], queries[at[k]]
            out[k] = math.fsum(v * q) / math.sqrt(math.fsum(v * v) * math.fsum(q * q)) >= threshold
        return out

    def find(at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = min(width, n)
        lot = max(1, CELLS // max(n, 32 * width))
        for k in range(0, len(at), lot):
            part = at[k : k + lot]
            ids, sims = graph.search(unit[part], width)
            whole = (sims[:, -1] >= slack) & (width < n)
            row, col = np.nonzero((sims >= slack) & ~whole[:, None])
            places, rows = part[row], graph.rows[ids[row, col]]
            good = exact(places, rows)
            yield places[good], rows[good]
            if whole.any():
                yield from find(part[whole], 4 * width)

    def passes(width: int) -> bool:
        ids, _ = graph.search(turned, width)
        if not (ids == drawn[:, None]).any(axis=1).all():
            return False
        pairs = {p for places, rows in find(picked, width) for p in zip(places.tolist(), rows.tolist(), strict=True)}
        return wanted <= pairs

    drawn = np.unique(np.linspace(0, n - 1, min(audit, n)).astype(int))
    rng = np.random.default_rng(n)
    v = graph.vectors[drawn].astype(np.float64)
    away = rng.normal(size=v.shape)
    away -= (away * v).sum(1, keepdims=True) * v
    length = np.linalg.norm(away, axis=1, keepdims=True)
    turned = (threshold * v + math.sqrt(max(0.0, 1 - threshold**2)) * away / np.maximum(length, 1e-12)).astype(np.float32)
    picked = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    row, col = np.nonzero(unit[picked] @ graph.vectors.T >= slack)
    places, rows = picked[row], graph.rows[col]
    good = exact(places, rows)
    wanted = set(zip(places[good].tolist(), rows[good].tolist(), strict=True))
    while beam < n and not passes(beam):
        beam *= 2
    yield from find(np.arange(len(queries)), beam)


def _raw(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in rows])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _comparable() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (norm > 0)
    )


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, shard_size: int = 8192, beam: int = 32, audit: int = 64
) -> tuple[DataFrame, list[Table]]:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label").withColumn(
        "group", F.when(_comparable(), F.struct("label", F.size("embedding").alias("size")))
    )
    nodes = Table(
        rows.filter("group is not null")
        .groupBy("group", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")),
        "vectors",
    )
    sizes = nodes.df.groupBy("group").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    sharded = Table(
        nodes.df.join(sizes, "group").withColumn("shard", F.pmod(F.xxhash64("embedding", "node"), "shards").cast("int")),
        "shards",
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        raw = _raw(pdf["embedding"])
        blob = pickle.dumps((Graph(_unit(raw)), raw, pdf["node"].to_numpy(), pdf["weight"].to_numpy()))
        return pd.DataFrame({"key": pdf["key"][:1], "shard": pdf["shard"][:1], "shards": pdf["shards"][:1], "graph": [blob]})

    keyed = sharded.df.withColumn("key", F.to_json("group"))
    graphs = Table(
        keyed.select("key", "shard", "shards", "node", "weight", "embedding")
        .groupBy("key", "shard")
        .applyInPandas(build, "key string, shard int, shards int, graph binary"),
        "graphs",
    )

    def query(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        right = right.sort_values("node", ignore_index=True)
        graph, raw, nodes, weights = pickle.loads(left["graph"].iloc[0])  # written by build
        asked, asked_weights = right["node"].to_numpy(), right["weight"].to_numpy()
        own = left["shard"].iloc[0] == right["block"].iloc[0]
        links, back = np.zeros(len(asked), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for places, rows in links_above(graph, raw, _raw(right["embedding"]), threshold, beam, audit):
            other = asked[places] != nodes[rows]  # a node's link with itself is counted by its weight
            places, rows = places[other], rows[other]
            np.add.at(links, places, weights[rows])
            if not own:  # the pair is looked at from this side only
                np.add.at(back, rows, asked_weights[places])
            for q, x in zip(asked[places].tolist(), nodes[rows].tolist(), strict=True):
                a, b = root(q), root(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(q, n, root(q)) for q, n in zip(asked.tolist(), links.tolist(), strict=True)]
        if not own:
            out += [(x, n, root(x)) for x, n in zip(nodes.tolist(), back.tolist(), strict=True) if n]
        return pd.DataFrame(out, columns=["node", "links", "root"])

    # Cosine is symmetric: a shard is queried with its own block and those after it.
    index = graphs.df.select("key", "shard", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("block"), "graph")
    blocks = keyed.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"),
        F.col("shard").alias("block"),
        "node",
        "weight",
        "embedding",
    )
    unit = ["key", "shard", "block"]
    answers = Table(
        index.groupBy(*unit).cogroup(blocks.groupBy(*unit)).applyInPandas(query, "node long, links long, root long"),
        "answers",
    )
    found = components(answers.df.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = answers.df.groupBy("node").agg(F.sum("links").alias("links"))
    # The rows of one node link with each other.
    result = Table(
        sharded.df.select("group", "embedding", "node", "weight")
        .join(counted, "node")
        .join(found.df.withColumnRenamed("id", "node"), "node", "left")
        .select(
            F.col("group").alias("_g"),
            F.col("embedding").alias("_e"),
            (F.col("links") + F.col("weight") - 1).alias("_links"),
            F.coalesce("component", "node").alias("_component"),
        ),
        "vector-classes",
    )
    for t in (nodes, sharded, graphs, answers, found):
        t.drop()
    out = rows.join(result.df, (F.col("group") == F.col("_g")) & (F.col("embedding") == F.col("_e")), "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), [result]
