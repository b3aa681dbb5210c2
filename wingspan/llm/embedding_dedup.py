"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are compared only with those of the same label (not null) and length, by cosine in double precision. Equal
vectors form one class, found by grouping, so a vector that a third of all rows hold is one node of the graph.

Index. All classes of a label and length are one cluster at first. A cluster over twice ``shard_rows`` is cut around
centroids, which a task fits by k-means on about ``fit_rows`` of its rows (at most ``branch`` centroids, so fits are
bounded), and so on level by level until every cluster is small; centroids meet their rows by shuffle, never on the
driver. A class goes to its nearest cluster (its home) and, from there, to at most ``overlap - 1`` others, the nearest
borders first, if the border is at most ``margin`` away; a copy goes to its nearest cluster only. So a class stands in at
most 1 + ``overlap - 1`` shards for each level. Centroids nearer to each other than a link reaches are made one: a crowd
of near copies is not cut by them. What they can't cut (or ``most_levels`` could not) is cut into chunks of
``chunk_rows`` by hash, and every pair of its chunks is a shard, as its classes may all be linked. In each shard, every node's nearest candidates are pruned robustly:
the nearest stays, candidates nearer to it than to the node (by the factor ``alpha``) go, and so on up to ``degree``
edges; a node that few edges lead to is added to the lists of its nearest neighbours, so that a walk can come to it. The
lists of a class from all its shards are united: one flat graph.

Search. Each class is searched in the cluster it is nearest to (in all shards of that cluster, if it is cut): a greedy
walk with a beam from the shard's medoid and from the class's own node, then the range is expanded: nodes within reach
are walked on from until none is new. Pairs found are verified at the threshold; a class gets the count of the vectors it
is linked with, and forest edges go to the components. No pairs are returned, so a large group costs no rows.

Audit. At most about ``audit_rows`` classes, chosen by hash, are held against all classes by brute force, in blocks; if
fewer than ``least_recall`` of their links were found, in all or in the mean of the classes, the call fails.

Cases: a vector that is null, empty or zero, or holds null or non-finite components, and one with a null label, links
with nothing: no links, its own component. A null vec_id is passed on and counts for a component's smallest id only if
there is no other. Rows that repeat vec_id and vector link with each other like any equal vectors. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import components, cut, sorted_groups

SHARD = ["cluster", "i", "j"]
#: Rows that are placed together, between centroids.
SALT_ROWS = 8192


def _unit(parts: list[bytes] | np.ndarray) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes_of(vectors: DataFrame) -> DataFrame:
    """(node, space, vec, low, n): a row for each distinct comparable vector; space tells label and length."""
    value = F.col("embedding").cast("array<double>")
    fine = (
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", value.alias("embedding")).filter(F.coalesce(fine, F.lit(False)))
    held = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    space = F.concat_ws("/", F.size("embedding"), F.col("label").cast("string"))
    return held.select(F.monotonically_increasing_id().alias("node"), space.alias("space"), "label", "embedding", "low", "n")


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly taken first centres."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def thinned(c: np.ndarray, threshold: float) -> np.ndarray:
    """The centroids, less those that are as near as a link to one before them."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < threshold:
            kept.append(i)
    return c[kept]


def _fitted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for g in sorted_groups(batches, ["cluster"]):
        x = _unit(g["vec"])
        c = _centroids(x, min(int(g["want"][0]), len(x)))
        c = thinned(c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None], threshold)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g["cluster"][:1], pa.string()), pa.array(g["size"][:1], pa.int64()), pa.array([len(c)], pa.int64()),
             pa.array([c.astype("<f8").tobytes()], pa.binary())],
            ["of", "size", "k", "centres"],
        )


def clusters_of(x: np.ndarray, c: np.ndarray, margin: float, overlap: int) -> np.ndarray:
    """For each row of x (unit vectors) its nearest cluster, then others by their border's distance; -1 beyond ``margin``."""
    apart = np.sqrt(np.maximum(1e-18, 2 - 2 * c @ c.T))
    sim = x @ c.T
    home = np.argmax(sim, axis=1)
    border = (sim[np.arange(len(x)), home][:, None] - sim) / apart[home]
    border[np.arange(len(x)), home] = -np.inf
    near = np.argsort(border, axis=1, kind="stable")[:, :overlap]
    return np.where(np.take_along_axis(border, near, 1) <= margin, near, -1)


def _placed(batches: Iterator[pa.RecordBatch], margin: float, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ["cluster", "home", "node", "n", "vec"]
    for g in sorted_groups(batches, ["cluster", "salt"], least=2):
        # the first row holds the centroids, their number as its n
        c, x = np.frombuffer(g["vec"][0], "<f8").reshape(int(g["n"][0]), -1), _unit(g["vec"][1:])
        near = clusters_of(x, c, margin, overlap)
        was_home = g["home"][1:].astype(bool)
        near[~was_home, 1:] = -1
        who, rank = np.nonzero(near >= 0)
        old = g["cluster"][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{k}|{old}" for k in near[who, rank].tolist()], pa.string()), pa.array(was_home[who] & (rank == 0)),
             pa.array(g["node"][1:][who], pa.int64()), pa.array(g["n"][1:][who], pa.int64()), pa.array(g["vec"][1:][who], pa.binary())], names,
        )


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = pa.array([np.array(v, "<f8").tobytes() for v in batch.column(3).to_pylist()], pa.binary())
        home = pa.array(np.ones(batch.num_rows, bool))
        yield pa.RecordBatch.from_arrays([batch.column(0), home, batch.column(1), batch.column(2), vec], ["cluster", "home", "node", "n", "vec"])


MEMBER = "cluster string, home boolean, node long, n long, vec binary"


def clusters(
    classes: DataFrame, threshold: float, shard_rows: int, overlap: int, margin: float, branch: int, fit_rows: int, most_levels: int
) -> DataFrame:
    """(cluster, home, node, n, vec): every class in its clusters; those over twice ``shard_rows`` can't be cut."""
    members = cut(classes.select("space", "node", "n", "embedding").mapInArrow(_raw, MEMBER))
    whole: list[DataFrame] = []
    for _ in range(most_levels):
        sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
        large = cut(sizes.filter(F.col("size") > 2 * shard_rows).withColumnRenamed("cluster", "of"))
        if large.isEmpty():
            break
        # written out before they part: the rows that stay, those that are placed anew and the fits are each read from it
        known = cut(members.join(large, F.col("cluster") == F.col("of"), "left").drop("of"))
        some = known.filter(F.pmod(F.xxhash64("vec"), F.col("size")) < fit_rows)
        want = F.least(F.lit(branch), F.ceil(overlap * F.col("size") / shard_rows)).cast("long")
        some = some.select("cluster", "size", want.alias("want"), "vec").repartition("cluster").sortWithinPartitions("cluster", "vec")
        fits = cut(some.mapInArrow(partial(_fitted, threshold=threshold), "of string, size long, k long, centres binary").filter("k > 1"))
        split = cut(known.join(fits.select("of", "k"), F.col("cluster") == F.col("of"), "left").drop("of"))
        whole.append(split.filter(F.col("k").isNull()).select("cluster", "home", "node", "n", "vec"))
        salts = F.ceil(F.col("size") / SALT_ROWS).cast("long")
        rows = split.filter(F.col("k").isNotNull()).select(
            "cluster", F.pmod(F.xxhash64("vec"), salts).alias("salt"), F.lit(1).alias("kind"), "home", "node", "n", "vec"
        )
        heads = fits.select(
            F.col("of").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
            F.lit(False).alias("home"), F.lit(-1).cast("long").alias("node"), F.col("k").alias("n"), F.col("centres").alias("vec"),
        )
        both = rows.unionByName(heads).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "kind", "node")
        members = cut(both.drop("kind").mapInArrow(partial(_placed, margin=margin, overlap=overlap), MEMBER))
    for done in whole:
        members = members.unionByName(done)
    return members


def shards(members: DataFrame, shard_rows: int, chunk_rows: int) -> DataFrame:
    """(cluster, i, j, chunk, home, node, n, vec): the members of every shard."""
    large = members.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") > max(2 * shard_rows, 2 * chunk_rows))
    large = large.select("cluster", F.ceil(F.col("size") / chunk_rows).cast("int").alias("chunks"))
    placed = members.join(large, "cluster", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return placed.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "home", "node", "n", "vec")


def robust_prune(x: np.ndarray, degree: int, candidates: int, alpha: float) -> list[np.ndarray]:
    """For each row of x (unit vectors), the rows that its robustly pruned edges lead to."""
    m = len(x)
    if m < 2:
        return [np.zeros(0, np.int64)] * m
    take = min(candidates, m - 1)
    near = np.empty((m, take), np.int64)
    for at in range(0, m, 1024):
        sim = x[at : at + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -np.inf
        part = np.argpartition(-sim, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
        near[at : at + 1024] = np.take_along_axis(part, order, 1)
    away = lambda a, b: np.sqrt(np.maximum(0, 2 - 2 * np.einsum("...d,...d->...", a, b)))
    edges: list[np.ndarray] = []
    for at in range(0, m, 256):
        c = near[at : at + 256]
        cx = x[c]
        far = away(cx, x[at : at + len(c), None])
        live, rows = np.ones(c.shape, bool), np.arange(len(c))
        chosen = np.full((len(c), degree), -1)
        for k in range(min(degree, take)):
            some = live.any(axis=1)
            if not some.any():
                break
            first = np.argmax(live, axis=1)
            chosen[some, k] = c[rows, first][some]
            live &= alpha * away(cx, cx[rows, first][:, None]) > far
            live[rows, first] = False
        edges += [e[e >= 0] for e in chosen]
    return edges


def with_back_edges(edges: list[np.ndarray], least: int = 4) -> list[np.ndarray]:
    """The same lists, with every node that fewer than ``least`` edges lead to added to its own nearest neighbours' lists."""
    found = np.bincount(np.concatenate(edges).astype(np.int64), minlength=len(edges))
    more: dict[int, list[int]] = {}
    for i in np.flatnonzero(found < least).tolist():
        for j in edges[i][:least].tolist():
            more.setdefault(j, []).append(i)
    return [np.unique(np.r_[e, more[i]]).astype(np.int64) if i in more else e for i, e in enumerate(edges)]


def _edges(batches: Iterator[pa.RecordBatch], degree: int, candidates: int, alpha: float) -> Iterator[pa.RecordBatch]:
    for g in sorted_groups(batches, SHARD, least=2):
        found = with_back_edges(robust_prune(_unit(g["vec"]), degree, candidates, alpha))
        for at in range(0, len(found), 2048):
            lists = [g["node"][e] for e in found[at : at + 2048]]
            yield pa.RecordBatch.from_arrays([pa.array(g["node"][at : at + 2048]), pa.array(lists, pa.list_(pa.int64()))], ["node", "edges"])


def range_search(x: np.ndarray, edges: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in queries, row of x) at a similarity of ``threshold`` or more that the graph leads to.

    All queries walk together. Nodes down to ``threshold - slack`` are walked on from, those from the threshold count.
    """
    m, q = len(x), len(queries)
    width = max(1, max(map(len, edges)))
    out = np.full((m, width), -1)
    for i, e in enumerate(edges):
        out[i, : len(e)] = e
    seen = np.zeros((q, m), bool)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    reach: list[tuple[np.ndarray, np.ndarray]] = []

    def look(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that are new, with their similarity; those in range are noted."""
        flat = np.unique(who * m + at)
        who, at = flat // m, flat % m
        new = ~seen[who, at]
        who, at = who[new], at[new]
        seen[who, at] = True
        sim = np.empty(len(who))
        for b in range(0, len(who), 65_536):
            sim[b : b + 65_536] = np.einsum("ij,ij->i", x[queries[who[b : b + 65_536]]], x[at[b : b + 65_536]])
        near = sim >= threshold - slack
        reach.append((who[near], at[near]))
        hit = sim >= threshold
        hits.append((who[hit], at[hit]))
        return who, at, sim

    def beyond(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = out[at]
        who = np.broadcast_to(who[:, None], to.shape)[to >= 0]
        return who, to[to >= 0]

    nodes, sims = np.full((q, beam), -1), np.full((q, beam), -np.inf)
    walked = np.ones((q, beam), bool)
    who, at, sim = look(np.r_[np.arange(q), np.arange(q)], np.r_[np.full(q, medoid), queries])
    while True:
        if len(who):  # the new nodes meet the beam
            order = np.lexsort((-sim, who))
            who, at, sim = who[order], at[order], sim[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < beam
            more_n, more_s = np.full((q, beam), -1), np.full((q, beam), -np.inf)
            more_n[who[keep], place[keep]], more_s[who[keep], place[keep]] = at[keep], sim[keep]
            both_n, both_s = np.hstack([nodes, more_n]), np.hstack([sims, more_s])
            both_w = np.hstack([walked, more_n < 0])
            best = np.argsort(-both_s, axis=1, kind="stable")[:, :beam]
            nodes, sims, walked = (np.take_along_axis(v, best, 1) for v in (both_n, both_s, both_w))
        open_ = np.flatnonzero(~walked.all(axis=1))
        if not len(open_):
            break
        first = np.argmax(~walked[open_], axis=1)
        walked[open_, first] = True
        who, at, sim = look(*beyond(open_, nodes[open_, first]))
    while reach:
        who, at = (np.concatenate(v) for v in zip(*reach, strict=True))
        reach.clear()
        for b in range(0, len(who), 16_384):
            look(*beyond(who[b : b + 16_384], at[b : b + 16_384]))
        if not any(len(w) for w, _ in reach):
            break
    who, at = (np.concatenate(v) for v in zip(*hits, strict=True))
    return who, at


def _search(batches: Iterator[pa.RecordBatch], threshold: float, beam: int, slack: float) -> Iterator[pa.RecordBatch]:
    names = ["node", "links", "tied"]
    for g in sorted_groups(batches, SHARD, least=2):
        x, nodes = _unit(g["vec"]), g["node"]
        order = np.argsort(nodes)
        edges = []
        for to in g["edges"]:
            at = order[np.minimum(np.searchsorted(nodes, to, sorter=order), len(nodes) - 1)]
            edges.append(at[nodes[at] == to])
        apart = g["i"][0] != g["j"][0]
        label = np.arange(len(nodes))
        links = np.zeros(len(nodes), np.int64)
        home = np.flatnonzero(g["home"].astype(bool))
        for b in range(0, len(home), 2048):
            queries = home[b : b + 2048]
            who, at = range_search(x, edges, queries, threshold, beam, slack)
            own = queries[who]
            fit = (g["chunk"][own] != g["chunk"][at]) if apart else own != at
            own, at = own[fit], at[fit]
            np.add.at(links, own, g["n"][at])
            by = np.argsort(own, kind="stable")
            own, at = own[by], at[by]
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, int)
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                old = np.unique(np.r_[label[own[a]], label[at[a:z]]])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        told = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[told]), pa.array(links[told]), pa.array(nodes[label[told]])], names)


def _audited(batches: Iterator[pa.RecordBatch], queries: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[pa.RecordBatch]:
    found: dict[int, int] = {}
    for batch in batches:
        space, nodes, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        raw = batch.column(3).to_pylist()
        for s, (ids, q) in queries.items():
            if len(own := np.flatnonzero(space == s)):
                near = q @ _unit([np.array(raw[i], "<f8").tobytes() for i in own]).T >= threshold
                near &= ids[:, None] != nodes[own][None]
                for i, total in zip(ids.tolist(), (near * n[own]).sum(axis=1).tolist(), strict=True):
                    found[i] = found.get(i, 0) + total
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["node", "links"])


def audit_recall(classes: DataFrame, found: DataFrame, threshold: float, audit_rows: int) -> float:
    """The share of the links of some classes, chosen by hash, that the search found; brute force is the measure.

    Taken over all their links and as the mean over classes with a link; the lesser counts.
    """
    total = classes.count()
    share = min(1.0, audit_rows / max(total, 1))
    chosen = classes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    by_space: dict[str, list] = {}
    for r in chosen.select("space", "node", "embedding").orderBy(F.xxhash64("node")).limit(2 * audit_rows).collect():
        by_space.setdefault(r.space, []).append((r.node, np.array(r.embedding, "<f8").tobytes()))
    queries = {s: (np.array([i for i, _ in v]), _unit([b for _, b in v])) for s, v in by_space.items()}
    ids = [i for own, _ in queries.values() for i in own.tolist()]
    if not ids:
        return 1.0
    truth = classes.select("space", "node", "n", "embedding").mapInArrow(partial(_audited, queries=queries, threshold=threshold), "node long, links long")
    truth = truth.groupBy("node").agg(F.sum("links").alias("links"))
    got = {r.node: r.links for r in found.filter(F.col("node").isin(ids)).select("node", "links").collect()}
    want = {r.node: r.links for r in truth.collect()}
    shares = [(min(got.get(i, 0), n), n) for i, n in want.items() if n]
    if not shares:
        return 1.0
    return min(sum(g for g, _ in shares) / sum(n for _, n in shares), sum(g / n for g, n in shares) / len(shares))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    shard_rows: int = 400,
    overlap: int = 3,
    margin: float = 0.1,
    degree: int = 16,
    candidates: int = 48,
    alpha: float = 1.2,
    beam: int = 8,
    slack: float = 0.04,
    branch: int = 64,
    fit_rows: int = 2048,
    most_levels: int = 8,
    chunk_rows: int = 1000,
    audit_rows: int = 400,
    least_recall: float = 0.9,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (columns vec_id, embedding, label)."""
    classes = cut(classes_of(vectors))
    members = cut(shards(clusters(classes, threshold, shard_rows, overlap, margin, branch, fit_rows, most_levels), shard_rows, chunk_rows))
    spread = members.repartition(*SHARD).sortWithinPartitions(*SHARD, "node")
    graph = spread.select(*SHARD, "node", "vec").mapInArrow(
        partial(_edges, degree=degree, candidates=candidates, alpha=alpha), "node long, edges array<long>"
    )
    graph = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    whole = members.join(graph, "node", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<long>")))
    whole = whole.repartition(*SHARD).sortWithinPartitions(*SHARD, "node")
    walked = whole.select(*SHARD, "chunk", "home", "node", "n", "vec", "edges").mapInArrow(
        partial(_search, threshold=threshold, beam=beam, slack=slack), "node long, links long, tied long"
    )
    walked = cut(walked)
    links = cut(walked.groupBy("node").agg(F.sum("links").alias("links")))
    if (recall := audit_recall(classes, links, threshold, audit_rows)) < least_recall:
        raise RuntimeError(f"the graph found {recall:.3f} of the audited links; raise overlap, margin, degree or beam")
    tied = components(walked.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    rooted = classes.join(tied, "node").select("node", "low", "root")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_node = rooted.join(lows, "root").select("node", "component")
    told = classes.join(of_node, "node", "left").join(links, "node", "left").select(
        F.col("label").alias("own_label"), F.col("embedding").alias("own_embedding"), "n", F.coalesce("component", "low").alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.join(told, (F.col("label") == F.col("own_label")) & (F.col("embedding") == F.col("own_embedding")), "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    rows = rows.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).alias("n_links"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
