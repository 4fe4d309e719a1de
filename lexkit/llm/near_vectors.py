"""Operator 8, embedding near-dedup: NN-descent.

Vectors are compared inside their label.  Equal vectors are collapsed to one
representative with a count first, so a vector shared by thousands of rows is
one node.

1. Start.  Along a few random directions the nodes of a label are sorted by
   their projection (range partitions, so a large label is spread); neighbours
   in that order fill the first neighbour lists of K entries.
2. Descent.  Every node gathers its neighbours and up to K nodes that list it;
   these meet each other (neighbours of neighbours), pairs with a new member
   only, and offer themselves to each other's lists.  A hub gathers 2 K nodes
   at most, and pairs are compared in matrix products over many nodes at once.
   Rounds go on until no link of the wanted nearness is new.
3. Links.  Pairs of at least the threshold, checked in double precision, join
   nodes to components.  A list without a non-link is saturated: its node may
   have more links, also to other components.  Saturated nodes are covered by
   cells (a centre and its members within the threshold's angle); cells of two
   components that the triangle inequality does not keep apart are compared
   member by member, and a link joins the components.
4. Count.  The members of a component are compared in blocks, which counts the
   links of every node without emitting them.
5. Audit.  The true links of one node of up to 256 components and of 256 nodes
   without links are counted by brute force over all nodes.  If the mean recall
   per node is below the wanted one in either sample, K doubles and the descent
   goes on; past 16 K the cells of all nodes, not of the saturated ones alone,
   are compared, which is exact.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and rows without label or id, link with nothing (0 links, their own component, a
null one without an id, kept); vectors of different lengths never link, each
length is compared by itself; a single row has 0 links; rows
repeating an id count as copies when their vectors are equal; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.common import components
from lexkit.llm.vectortable import cosine_pairs, lists, matrix, unit, usable
from lexkit.session import discard, materialize, shuffle_partitions, written

THRESHOLD = 0.98
K = 8
DIRECTIONS = 4
REACH = 4               # neighbours taken on one side of the sorted order
ROUNDS = 8
BLOCK_ROWS = 512
AUDIT_NODES = 256
RECALL = 0.995
SLACK = 1e-5            # single-precision margin before the exact check
ANGLE = float(np.arccos(THRESHOLD))
MARGIN = 1e-6           # of angles
SEED = 5
EDGE = "src bigint, dst bigint, sim float"


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim.astype(np.float32))], ["src", "dst", "sim"])


def first_lists(nodes: DataFrame, d: int) -> DataFrame:
    """Edges between nodes of a label that are close along a random direction."""
    directions = np.random.default_rng(SEED).normal(size=(d, DIRECTIONS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = matrix(b.column("u"), np.float32) @ directions
                for j in range(DIRECTIONS):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), b.column("label"), b.column("u"), pa.array(np.full(b.num_rows, j, np.int32)),
                         pa.array(p[:, j])], ["id", "label", "u", "direction", "p"])

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            fresh = 0 if held is None else len(held)
            t = t if held is None else pa.concat_tables([held, t])
            u, ids = matrix(t.column("u"), np.float32), t.column("id").to_numpy()
            group = t.column("label").to_numpy().astype(np.int64) * DIRECTIONS + t.column("direction").to_numpy()
            for step in range(1, REACH + 1):
                at = np.arange(max(fresh, step), len(t))
                at = at[group[at] == group[at - step]]
                sim = (u[at] * u[at - step]).sum(1)
                yield _edges(np.concatenate([ids[at], ids[at - step]]), np.concatenate([ids[at - step], ids[at]]),
                             np.concatenate([sim, sim]))
            held = t.slice(max(0, len(t) - REACH)).combine_chunks()

    label = nodes.schema["label"].dataType.simpleString()
    n = shuffle_partitions(nodes.sparkSession)
    spread = nodes.select("id", "label", "u").mapInArrow(
        project, f"id bigint, label {label}, u array<float>, direction int, p double")
    return (spread.repartitionByRange(n, "direction", "label", "p", "id")
                  .sortWithinPartitions("direction", "label", "p", "id").mapInArrow(pair_up, EDGE))


def keep_best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of every node; ``new``: not in the old list."""
    best = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return (edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
                 .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k))


def local_join(t: pa.Table) -> pa.Table:
    """Members of many nodes' neighbourhoods meet: (u, id, v, new, worst, link)
    rows give the pairs that improve a member's list, and pairs of linked
    nodes that the node itself does not connect."""
    hub = t.column("hub").to_numpy()
    order = np.argsort(hub, kind="stable")
    hub = hub[order]
    first = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
    size = np.diff(np.append(first, len(hub)))
    row = np.repeat(np.arange(len(first)), size)
    col = np.arange(len(hub)) - np.repeat(first, size)
    m, x = int(size.max()), matrix(t.column("u"), np.float32)[order]

    def grid(a: np.ndarray, empty) -> np.ndarray:
        out = np.full((len(first), m), empty, a.dtype)
        out[row, col] = a
        return out

    ids = grid(t.column("id").to_numpy()[order], -1)
    there = grid(np.ones(len(hub), bool), False)
    new = grid(t.column("new").to_numpy(zero_copy_only=False)[order].astype(bool), False)
    worst = grid(t.column("worst").to_numpy()[order], np.float32(2))
    linked = grid(t.column("sim").to_numpy()[order] >= THRESHOLD, False)
    out = []
    step = max(1, 4_000_000 // (m * max(m, x.shape[1])))
    for a in range(0, len(first), step):
        s = slice(a, a + step)
        v = np.zeros((min(step, len(first) - a), m, x.shape[1]), np.float32)
        inside = (row >= a) & (row < a + step)
        v[row[inside] - a, col[inside]] = x[inside]
        sim = np.matmul(v, v.transpose(0, 2, 1))
        ok = there[s, :, None] & there[s, None, :] & (new[s, :, None] | new[s, None, :])
        ok &= ids[s, :, None] != ids[s, None, :]
        better = sim > worst[s, :, None]
        apart = (sim >= THRESHOLD - SLACK) & ~(linked[s, :, None] & linked[s, None, :])
        g, i, j = np.nonzero(ok & (better | apart))
        out.append((ids[s][g, i], ids[s][g, j], sim[g, i, j]))
    src, dst, sim = (np.concatenate(c) for c in zip(*out, strict=True))
    # one offer per pair is enough
    pair = np.lexsort((dst, src))
    once = np.ones(len(pair), bool)
    once[1:] = (src[pair][1:] != src[pair][:-1]) | (dst[pair][1:] != dst[pair][:-1])
    pair = pair[once]
    return pa.table({"src": src[pair], "dst": dst[pair], "sim": sim[pair].astype(np.float32)})


def descend(nodes: DataFrame, graph: DataFrame, k: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of neighbours-of-neighbours joins: (lists, links found so far)."""
    spark = nodes.sparkSession
    near = F.col("sim") >= THRESHOLD - SLACK
    graph, graph_path = written(graph)
    links, links_path = written(graph.filter(near).select("src", "dst"))
    count = links.count()
    for _ in range(ROUNDS):
        back = (graph.select(F.col("dst").alias("hub"), F.col("src").alias("id"), "sim", "new")
                .withColumn("place", F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("hub", "id"))))
                .filter(F.col("place") <= k).drop("place"))
        met = (graph.select(F.col("src").alias("hub"), F.col("dst").alias("id"), "sim", "new").unionByName(back)
               .groupBy("hub", "id").agg(F.max("sim").alias("sim"), F.max("new").alias("new")))
        worst = graph.groupBy(F.col("src").alias("id")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        met = (met.join(nodes.select("id", "u").join(worst, "id", "left").fillna(-2.0, ["worst"]), "id")
                  .withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(buckets))))
        offers, offers_path = written(met.groupBy("bucket").applyInArrow(local_join, EDGE))
        fresh, path = written(keep_best(graph.select("src", "dst", "sim").withColumn("new", F.lit(False))
                                        .unionByName(offers.withColumn("new", F.lit(True))), k))
        found, found_path = written(links.unionByName(offers.filter(near).select("src", "dst")).distinct())
        discard(spark, graph_path, offers_path, links_path)
        graph, graph_path, links, links_path = fresh, path, found, found_path
        before, count = count, links.count()
        if count == before or graph.filter("new").isEmpty():
            break
    return graph, links


def checked(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links whose cosine in double precision reaches the threshold: (a, b)."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = cosine_pairs(matrix(b.column("va")), matrix(b.column("vb"))) >= THRESHOLD
                yield b.select(["a", "b"]).filter(pa.array(ok))

    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    v = nodes.select("id", "vector")
    return (pairs.join(v.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a")
                 .join(v.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")
                 .mapInArrow(exact, "a bigint, b bigint"))


def _reaches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = unit(a) @ unit(b).T
    out = s >= THRESHOLD
    for i, j in zip(*np.nonzero(np.abs(s - THRESHOLD) < 1e-12), strict=True):
        out[i, j] = cosine_pairs(a[i:i + 1], b[j:j + 1])[0] >= THRESHOLD
    return out


def _block_links(t: pa.Table) -> pa.Table:
    """Links (weighted by copies) between the members of components or of two
    blocks of one component."""
    comp, ids = t.column("component").to_numpy(), t.column("id").to_numpy()
    order = np.lexsort((ids, comp))
    comp, ids, copies = comp[order], ids[order], t.column("copies").to_numpy()[order]
    block, v = t.column("block").to_numpy()[order], matrix(t.column("vector"))[order]
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    n = np.zeros(len(ids), np.int64)
    if i == j:
        border = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
        for a, b in zip(border[:-1], border[1:], strict=True):
            near = _reaches(v[a:b], v[a:b])
            np.fill_diagonal(near, False)
            n[a:b] = near @ copies[a:b]
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = _reaches(v[left], v[right])
        n[left], n[right] = near @ copies[right], near.T @ copies[left]
    return pa.table({"id": ids, "n": n})


def count_links(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, n): links of every node to other nodes of its component."""
    spark = nodes.sparkSession
    size = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    m = (comp.join(size, "component").join(nodes.select("id", "vector", "copies"), "id")
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    small = m.filter("blocks = 1").withColumn("key", F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_partitions(spark)))) \
             .withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    large = m.filter("blocks > 1").withColumn("key", F.col("component")) \
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    return (small.unionByName(large).withColumn("large", F.col("blocks") > 1)
            .groupBy("large", "key", "i", "j").applyInArrow(_block_links, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")))


def _cells(t: pa.Table) -> pa.Table:
    """Cells of components or of one block of a component: the first node left
    is a centre and takes all nodes within the threshold's angle."""
    comp, ids = t.column("component").to_numpy(), t.column("id").to_numpy()
    order = np.lexsort((ids, comp))
    comp, ids, u = comp[order], ids[order], unit(matrix(t.column("vector"))[order])
    cell, angle = ids.copy(), np.zeros(len(ids))
    border = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
    for a, b in zip(border[:-1], border[1:], strict=True):
        left = np.arange(a, b)
        while len(left) > 1:
            far = np.arccos(np.clip(u[left] @ u[left[0]], -1, 1))
            far[0] = 0
            taken = far <= ANGLE
            cell[left[taken]], angle[left[taken]] = ids[left[0]], far[taken]
            left = left[~taken]
    return pa.table({"cell": cell, "id": ids, "angle": angle})


def _near_cells(t: pa.Table) -> pa.Table:
    """Cells of different components, of one or two blocks, that may hold a
    link; ``sure``: their centres are linked."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    block, v = t.column("block").to_numpy(), matrix(t.column("vector"))
    cell, comp, radius = (t.column(c).to_numpy() for c in ("cell", "component", "radius"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    apart = np.arccos(np.clip(unit(v[left]) @ unit(v[right]).T, -1, 1))
    near = apart <= radius[left][:, None] + radius[right][None] + ANGLE + MARGIN
    near &= comp[left][:, None] < comp[right][None] if i == j else comp[left][:, None] != comp[right][None]
    x, y = np.nonzero(near)
    x, y = left[x], right[y]
    swap = comp[x] > comp[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    sure = cosine_pairs(v[x], v[y]) >= THRESHOLD
    return pa.table({"a": cell[x], "b": cell[y], "ca": comp[x], "cb": comp[y], "sure": sure})


def _meeting(t: pa.Table) -> pa.Table:
    """One link of every pair of cells (a, b) that has any."""
    a, b, side, ids = (t.column(c).to_numpy() for c in ("a", "b", "side", "id"))
    order = np.lexsort((ids, side, b, a))
    a, b, side, ids, v = a[order], b[order], side[order], ids[order], matrix(t.column("vector"))[order]
    border = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
    src, dst = [], []
    for x, z in zip(border[:-1], border[1:], strict=True):
        y = x + int((side[x:z] == 0).sum())
        near = _reaches(v[x:y], v[y:z])
        if near.any():
            i, j = np.unravel_index(int(near.argmax()), near.shape)
            src.append(ids[x + i])
            dst.append(ids[y + j])
    return pa.table({"a": pa.array(src, pa.int64()), "b": pa.array(dst, pa.int64())})


def saturated(graph: DataFrame) -> DataFrame:
    """(id): nodes whose list holds no non-link."""
    return graph.groupBy(F.col("src").alias("id")).agg(F.min("sim").alias("worst")).filter(
        F.col("worst") >= THRESHOLD - SLACK).select("id")


def cross_links(nodes: DataFrame, comp: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b): at least one link between any two components that have links
    between their ``chosen`` nodes (a node without component is its own)."""
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "a bigint, b bigint")
    m = (nodes.select("id", "label", "vector").join(chosen, "id", "left_semi").join(comp, "id", "left")
              .withColumn("component", F.coalesce("component", "id")))
    several = m.groupBy("label").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    m = materialize(m.join(several, "label", "left_semi"))
    if m.isEmpty():
        return none
    size = m.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    part = m.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    key = F.when(F.col("blocks") > 1, F.col("component")).otherwise(
        F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_partitions(spark))))
    member = materialize(part.withColumn("large", F.col("blocks") > 1).withColumn("key", key)
                             .select("large", "key", "block", "component", "id", "vector")
                             .groupBy("large", "key", "block").applyInArrow(_cells, "cell bigint, id bigint, angle double"))
    cell = (member.groupBy("cell").agg(F.max("angle").alias("radius"))
                  .join(m.withColumnRenamed("id", "cell"), "cell"))
    size = cell.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    near = materialize(cell.join(size, "label").withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
                           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                           .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
                           .select("label", "i", "j", "block", "cell", "component", "radius", "vector")
                           .groupBy("label", "i", "j")
                           .applyInArrow(_near_cells, "a bigint, b bigint, ca bigint, cb bigint, sure boolean"))
    sure = near.filter("sure")
    open_ = materialize(near.filter("not sure").join(sure.select("ca", "cb").distinct(), ["ca", "cb"], "left_anti"))
    links = sure.select("a", "b")
    pairs = open_.count()
    if pairs:
        ends = (open_.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("cell"))
                .unionByName(open_.select("a", "b", F.lit(1).alias("side"), F.col("b").alias("cell"))))
        buckets = max(4 * shuffle_partitions(spark), pairs // 50)
        links = links.unionByName(
            ends.join(member.select("cell", "id"), "cell").join(m.select("id", "vector"), "id")
                .withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))
                .select("bucket", "a", "b", "side", "id", "vector")
                .groupBy("bucket").applyInArrow(_meeting, "a bigint, b bigint"))
    return materialize(links)


def audit_sample(nodes: DataFrame, comp: DataFrame, count: int = AUDIT_NODES) -> DataFrame:
    """(id, linked): one node of up to ``count`` components, and as many nodes
    without links."""
    by = F.xxhash64(F.lit(SEED), "id")
    linked = comp.groupBy("component").agg(F.min_by("id", by).alias("id")).select("id", F.lit(True).alias("linked"))
    alone = nodes.select("id").join(comp, "id", "left_anti").select("id", F.lit(False).alias("linked"))
    return linked.orderBy(by).limit(count).unionByName(alone.orderBy(by).limit(count))


def true_links(nodes: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, truth): links of the sampled nodes, by brute force over all nodes."""
    sample = nodes.join(F.broadcast(sample), "id").select("id", "label", "vector").toArrow()
    ids, labels, v = sample.column("id").to_numpy(), sample.column("label").to_numpy(), matrix(sample.column("vector"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = labels[:, None] == b.column("label").to_numpy()[None]
                near = _reaches(v, matrix(b.column("vector"))) & same
                near &= ids[:, None] != b.column("id").to_numpy()[None]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ b.column("copies").to_numpy())], ["id", "n"])

    return (nodes.select("id", "label", "vector", "copies").mapInArrow(compare, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("truth")))


def enough_found(nodes: DataFrame, comp: DataFrame, linked: DataFrame) -> bool:
    """Do the sampled nodes that have links find the wanted part of them, each
    node counting the same, both in components and outside?"""
    sample = materialize(audit_sample(nodes, comp))
    recall = (true_links(nodes, sample).filter("truth > 0").join(sample, "id").join(linked, "id", "left")
              .groupBy("linked").agg(F.avg(F.least(F.coalesce("n", F.lit(0)), "truth") / F.col("truth")).alias("recall")))
    return all(r["recall"] >= RECALL for r in recall.collect())


def joined(nodes: DataFrame, links: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) over the links and those between components'
    ``chosen`` nodes, and the links (id, n) of their members."""
    comp = components(links)
    more = cross_links(nodes, comp, chosen)
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return comp, materialize(count_links(nodes, comp))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 k: int = K) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept."""
    member, seen = None, None
    for rows in usable(vectors, key, vector, F.col(label).cast("bigint").alias("label")):
        rows = materialize(rows.filter("label IS NOT NULL").withColumnRenamed(key, "id"))
        part = _linked_rows(rows, k)
        member = part if member is None else member.unionByName(part)
        seen = rows.select("id") if seen is None else seen.unionByName(rows.select("id"))
    # a null id meets no other: such a row links with nothing and is kept
    rest = (vectors.select(F.col(key).cast("bigint").alias("id"))
            .join(seen.distinct(), "id", "left_anti")
            .select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return member.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id",
                                           F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked_rows(rows: DataFrame, k: int) -> DataFrame:
    """(id, n_links, component_id) of vectors of one length (id, label, vector)."""
    spark = rows.sparkSession
    nodes = rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def add_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("u", lists(unit(matrix(b.column("vector"))).astype(np.float32)))

    nodes = materialize(nodes.mapInArrow(add_unit, "label bigint, vector array<double>, id bigint, copies bigint, u array<float>"))
    head = nodes.first()
    comp = spark.createDataFrame([], "id bigint, component bigint")
    linked = spark.createDataFrame([], "id bigint, n bigint")
    if head is not None:
        buckets = max(4 * shuffle_partitions(spark), nodes.count() // 1000)
        graph = keep_best(first_lists(nodes, len(head["vector"])).withColumn("new", F.lit(True)), k)
        while True:
            graph, links = descend(nodes, graph, k, buckets)
            exact = materialize(checked(links, nodes))
            comp, linked = joined(nodes, exact, saturated(graph))
            if enough_found(nodes, comp, linked):
                break
            if k > 16 * K:
                comp, linked = joined(nodes, exact, nodes.select("id"))
                break
            k *= 2
            graph = graph.withColumn("new", F.lit(True))
    node = (nodes.select(F.col("label").alias("l"), F.col("vector").alias("v"), F.col("id").alias("node"), "copies")
            .join(comp.withColumnRenamed("id", "node"), "node", "left").join(linked.withColumnRenamed("id", "node"), "node", "left")
            .withColumn("component", F.coalesce("component", "node")).withColumn("n", F.coalesce("n", F.lit(0))))
    return (rows.join(node, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")))
            .select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id")))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
