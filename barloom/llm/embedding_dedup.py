"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has a codebook of
its own (k-means), and pairs of codewords form a grid of cells. A vector lies in
one cell and looks into the nearest cells, in the order of the multi-sequence
traversal: by the sum of its halves' distances to their codewords. How many
cells: as many as reach the target recall on probes, sample vectors whose links
are found by brute force against all vectors. It is reached in each quarter of
the similarities, over links, over probes and over groups of linked probes
alike, so one large tight group doesn't hide what looser pairs need. `probes`
are taken at first, more until `GROUPS` groups have links or the sample ends; if
it ends sooner and isn't the whole table, pairs made at the bar have to be found
as well. Every other probe is left out of that choice: recall is measured on
these (on made pairs, where no probe has a link), twice as many cells are
visited until it is at least `RECALL`, all of them if need be, and it is logged
and given in `report`. What is found is verified by cosine in double precision.

Codebooks grow with the square root of the number of vectors, so that a cell's
expected size stays the same; they are fitted on `sample` vectors, those whose
ids hash lowest, or 8 for each codeword if that is more. A cell of more than
`CHUNK` vectors is split, and so are those who look into it, so no task gets
more than a chunk of each; results of a task are counts and a component's root
for each vector, not pairs. Equal vectors are one, with their number.

Only vectors of one width can be compared: each width is searched for itself,
those of at most `CHUNK` vectors without a grid. Vectors that are null, zero, or
hold null or non-finite numbers link with nothing; nor do rows whose vec_id is
null. Rows that repeat a vec_id and its vector are one vector for links, and
each gets the result. An empty table gives an empty one.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.graph import components
from barloom.llm.shared import fan_out, materialise

LEAST = 0.9
TARGET = 0.985
RECALL = 0.9
SAMPLE = 16_000
PROBES = 400
CELL = 8
CHUNK = 1024
GROUPS = 100
RANGES = 4


def _unit(bodies: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), "<f8").reshape(len(bodies), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, length, body (the numbers as bytes; null where the vector can't link)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("length", pa.int32()), ("body", pa.binary())])

    def work(batches):
        for batch in batches:
            out = []
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            flat = lists.values if hasattr(lists, "values") else lists.flatten()
            offsets = lists.offsets.to_numpy()
            values = flat.to_numpy(zero_copy_only=False).astype("<f8")
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, vec_id in enumerate(ids):
                x = values[offsets[i] : offsets[i + 1]]
                ok = vec_id is not None and known[i] and len(x) > 0 and np.isfinite(x).all() and x.any()
                out.append((len(x), (x + 0.0).tobytes() if ok else None))  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), schema.types[1:]))], schema=schema
            ) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return rows.mapInArrow(work, "vec_id long, length int, body binary")


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the rows of x; the same for the same x."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    step = max(1, (1 << 23) // len(c))  # distances of so many rows at once
    for _ in range(rounds):
        squares = (c * c).sum(1)
        near = np.concatenate([np.argmin(squares - 2 * x[at : at + step] @ c.T, axis=1) for at in range(0, len(x), step)])
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate(([0], np.cumsum(n)[:-1])), len(x) - 1), axis=0)
        c = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """Two codebooks; cell = i * (size of the second) + j."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        half = self.books[0].shape[1]
        return [np.maximum((h * h).sum(1)[:, None] + (c * c).sum(1) - 2 * h @ c.T, 0) for h, c in zip((x[:, :half], x[:, half:]), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * np.int64(len(self.books[1])) + b.argmin(1)

    def traverse(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first `most` cells of each row's multi-sequence traversal, nearest first."""
        a, b = self.distances(x)
        ka, kb = min(most, a.shape[1]), min(most, b.shape[1])
        oa, ob = np.argsort(a, axis=1, kind="stable")[:, :ka], np.argsort(b, axis=1, kind="stable")[:, :kb]
        a, b = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        # the n-th nearest cell is at ranks (i, j) with (i + 1)(j + 1) <= n
        i, j = np.nonzero(np.add.outer(np.zeros(ka, int), np.zeros(kb, int)) + (np.outer(np.arange(1, ka + 1), np.arange(1, kb + 1)) > most) == 0)
        sums = a[:, i] + b[:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(oa[:, i] * np.int64(len(self.books[1])) + ob[:, j], first, 1)

    def ranks(self, a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a traversal with sorted-by-codeword distances a, b visits before each of cells."""
        want = a[cells // len(self.books[1])] + b[cells % len(self.books[1])]
        ordered = np.sort(b)
        return np.array([int(np.searchsorted(ordered, w - a, "left").sum()) for w in want], np.int64)


def _ranks_of_links(reps: DataFrame, grid: Grid, queries: list[tuple[int, bytes]], least: float) -> np.ndarray:
    """(query, range of similarity, rank, links) rows: a pass of all vectors against the queries."""
    q = _unit([b for _, b in queries])
    ids = np.array([i for i, _ in queries], np.int64)
    a, b = grid.distances(q)
    held = reps.sparkSession.sparkContext.broadcast((q, ids, a, b))  # of the sample at most

    def work(batches):
        q, ids, a, b = held.value
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            names = batch.column("rep").to_numpy()
            rows = []
            for at in range(0, len(bodies), 2000):
                x = _unit(bodies[at : at + 2000])
                cells = grid.cells(x)
                for k0 in range(0, len(q), 2000):
                    like = q[k0 : k0 + 2000] @ x.T
                    hit, row = np.nonzero((like >= least) & (ids[k0 : k0 + 2000, None] != names[None, at : at + 2000]))
                    band = np.clip((like[hit, row] - least) / max(1 - least, 1e-9) * RANGES, 0, RANGES - 1).astype(np.int64)
                    for k in np.unique(hit):
                        mine = hit == k
                        own, which = np.unique(cells[row[mine]], return_inverse=True)
                        pairs, often = np.unique(which.ravel() * RANGES + band[mine], return_counts=True)
                        ranks = grid.ranks(a[k0 + k], b[k0 + k], own)[pairs // RANGES]
                        rows += zip([int(k0 + k)] * len(pairs), (pairs % RANGES).tolist(), ranks.tolist(), often.tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query", "band", "rank", "n"])

    got = reps.select("rep", "body").mapInArrow(work, "query long, band long, rank long, n long").groupBy("query", "band", "rank").agg(F.sum("n").alias("n"))
    return np.array([tuple(r) for r in got.collect()], np.int64).reshape(-1, 4)


def _grouped(x: np.ndarray, least: float) -> np.ndarray:
    """For each row of x the first of the rows that lead, those alike to no leader before them."""
    lead = np.zeros((0, x.shape[1]))
    out = np.zeros(len(x), np.int64)
    for i, v in enumerate(x):
        like = np.flatnonzero(lead @ v >= least)
        out[i] = like[0] if len(like) else len(lead)
        if not len(like):
            lead = np.concatenate((lead, v[None]))
    return out


def _reaching(rank: np.ndarray, weight: np.ndarray, target: float) -> tuple[int, float]:
    """(cells, recall) of the fewest cells that hold `target` of the weight."""
    order = np.argsort(rank, kind="stable")
    sums = np.cumsum(weight[order])
    ends = np.flatnonzero(np.append(np.diff(rank[order]) > 0, True))
    at = ends[np.flatnonzero(sums[ends] >= target * sums[-1] * (1 - 1e-12))[0]]
    return int(rank[order[at]]) + 1, float(sums[at] / sums[-1])


def _at_the_bar(grid: Grid, x: np.ndarray, least: float) -> np.ndarray:
    """Ranks of the cells of x for vectors made from them, alike by `least` in directions of chance."""
    other = np.random.default_rng(11).normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.maximum(np.sqrt((other * other).sum(1, keepdims=True)), 1e-12)
    a, b = grid.distances(least * x + np.sqrt(max(0, 1 - least * least)) * other)
    return np.array([grid.ranks(a[i], b[i], cell[None])[0] for i, cell in enumerate(grid.cells(x))], np.int64)


def _recall(rows: np.ndarray, visits: int) -> float:
    """The share of links that so many cells hold: the least of the ranges of similarity, each probe counting 1."""
    found = []
    for band in np.unique(rows[:, 1]):
        mine = rows[rows[:, 1] == band]
        _, probe = np.unique(mine[:, 0], return_inverse=True)
        n = mine[:, 3].astype(float)
        share = n / np.bincount(probe.ravel(), n)[probe.ravel()]
        found.append(float(share[mine[:, 2] < visits].sum() / share.sum()))
    return min(found, default=1.0)


def cells_to_visit(
    reps: DataFrame, grid: Grid, queries: list[tuple[int, bytes]], least: float, target: float, probes: int = PROBES,
    total: int | None = None
) -> tuple[int, float, int]:
    """(cells, recall, links it was measured on; 0: made pairs) by the first of queries, as many as it takes; total: of all vectors."""
    rows, groups, done = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), 0
    while done < len(queries) and (not done or groups.max(initial=-1) + 1 < GROUPS):
        end = min(len(queries), max(1, probes) if not done else 4 * done)
        more = _ranks_of_links(reps, grid, queries[done:end], least)
        more[:, 0] += done
        rows, done = np.concatenate((rows, more)), end
        linked, which = np.unique(rows[:, 0], return_inverse=True)
        groups = _grouped(_unit([queries[k][1] for k in linked]), least) if len(linked) else groups
    every = done >= (total or done + 1)  # all vectors are probes: nothing is estimated
    chosen = np.ones(len(rows), bool) if every else rows[:, 0] % 2 == 0
    needs = []
    for band in range(RANGES):
        mine = (rows[:, 1] == band) & chosen
        if mine.any():
            probe, rank, n = which.ravel()[mine], rows[mine, 2], rows[mine, 3].astype(float)
            share = n / np.bincount(probe, n)[probe]  # each probe counts 1
            members = np.bincount(groups[np.unique(probe)])
            needs += [_reaching(rank, w, target)[0] for w in (n, share, share / members[groups[probe]])]
    made = np.zeros((0, 4), np.int64)
    if groups.max(initial=-1) + 1 < GROUPS and not every:
        ranks = _at_the_bar(grid, _unit([b for _, b in queries[:PROBES]]), least)
        made = np.column_stack([np.arange(len(ranks)), np.zeros(len(ranks), np.int64), ranks, np.ones(len(ranks), np.int64)])
        needs.append(_reaching(ranks, np.ones(len(ranks)), target)[0])
    visits, cells = max([4, *needs]), len(grid.books[0]) * len(grid.books[1])
    judge = rows if every else rows[~chosen]
    judge = judge if len(judge) else made
    recall = _recall(judge, visits)
    while recall < RECALL and visits < cells:
        visits *= 2
        recall = _recall(judge, visits)
    visits, links = min(visits, cells), int(judge[:, 3].sum()) if judge is not made else 0
    logging.getLogger(__name__).info("cells to visit: %d of %d, recall %.4f on %d links, %d groups, %d probes", visits, cells, recall, links, groups.max(initial=-1) + 1, done)
    return visits, recall, links


_WORK = "cell long, member boolean, id long, n long, own long, body binary, visits binary"
_WORK_ARROW = pa.schema([("cell", pa.int64()), ("member", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("body", pa.binary()), ("visits", pa.binary())])


def _roots(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable in the bipartite graph of hits, for each row and column."""
    top = np.iinfo(np.int64).max
    l, r = left.copy(), right.copy()
    while True:
        r2 = np.minimum(r, np.where(hit, l[:, None], top).min(0))
        l2 = np.minimum(l, np.where(hit, r2[None, :], top).min(1))
        if (l2 == l).all() and (r2 == r).all():
            return l, r
        l, r = l2, r2


def link(reps: DataFrame, grid: Grid, visits: int, least: float = LEAST) -> DataFrame:
    """reps (rep, n, body) -> id, links, root: partial counts, and edges that connect what is linked."""
    spark = reps.sparkSession
    step = max(1, min(500, 100_000 // visits))  # rows whose cells are held at once

    def own_cells(batches):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            cells = np.concatenate([np.zeros(0, np.int64), *(grid.cells(_unit(bodies[i : i + 2000])) for i in range(0, len(bodies), 2000))])
            yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    # cells of more than a chunk, joined: Spark broadcasts them only if they are few
    large = reps.mapInArrow(own_cells, "cell long").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select(
        "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")
    )

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                bodies, names, counts = part.column("body").to_pylist(), part.column("rep").to_pylist(), part.column("n").to_pylist()
                look = grid.traverse(_unit(bodies), visits)
                rows = []
                for body, name, n, cells in zip(bodies, names, counts, look):
                    own = int(cells[0])
                    rows.append((own, True, name, n, own, body, cells.astype("<i8").tobytes()))
                    rows += [(cell, False, name, n, own, body, None) for cell in cells.tolist()]
                    if len(rows) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WORK_ARROW.types)], schema=_WORK_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WORK_ARROW.types)], schema=_WORK_ARROW)

    def verify(batches):
        now, members, lookers = None, [], []

        def done():
            out = []
            if members and lookers:
                m, ids = _unit([r[3] for r in members]), np.array([r[0] for r in members], np.int64)
                weight = np.array([r[1] for r in members], np.int64)
                seen = np.array([np.frombuffer(r[4], "<i8") for r in members])
                for at in range(0, len(lookers), CHUNK):
                    part = lookers[at : at + CHUNK]
                    names = np.array([r[0] for r in part], np.int64)
                    hit = (_unit([r[3] for r in part]) @ m.T >= least) & (names[:, None] != ids[None, :])
                    if not hit.any():
                        continue
                    rows, cols = hit.any(1), hit.any(0)
                    hit, q, c = hit[np.ix_(rows, cols)], names[rows], ids[cols]
                    n = np.array([r[1] for r in part], np.int64)[rows]
                    own = np.array([r[2] for r in part], np.int64)[rows]
                    left, right = _roots(hit, q, c)
                    # a link is found from both sides, or this side counts for both
                    cells, which = np.unique(own, return_inverse=True)
                    back = np.array([(seen[cols] == x).any(1) for x in cells])[which.ravel()]
                    out += zip(q.tolist(), (hit @ weight[cols]).tolist(), left.tolist())
                    out += zip(c.tolist(), (n @ (hit & ~back)).tolist(), right.tolist())
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[i : i + 20_000])], names=["id", "links", "root"])

        for batch in batches:
            for cell, a, b, member, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, a, b) != now:
                    if now:
                        yield from done()
                    now, members, lookers = (cell, a, b), [], []
                (members if member else lookers).append(row)
        if now:
            yield from done()

    chunks = F.coalesce("chunks", F.lit(1))
    mine, each = F.pmod(F.xxhash64("id"), chunks).cast("int"), F.explode(F.sequence(F.lit(0), chunks - 1))
    # chunk a of the members meets chunk b of those who look: members go to all b, lookers to all a
    parts = reps.mapInArrow(deal, _WORK).join(large, "cell", "left").select("*", mine.alias("mine"), each.alias("other"))
    a, b = F.when(F.col("member"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("member"), F.col("other")).otherwise(F.col("mine"))
    parts = parts.select("cell", a.alias("a"), b.alias("b"), "member", "id", "n", "own", "body", "visits")
    dealt = parts.repartition(fan_out(spark), "cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    found = dealt.mapInArrow(verify, "id long, links long, root long")
    return materialise(found, "links")


def link_all(reps: DataFrame, least: float) -> DataFrame:
    """As link(), for widths of at most CHUNK vectors: everybody of a width meets everybody."""

    def work(batches):
        now, held = None, []

        def done():
            x, ids, n = _unit([r[2] for r in held]), np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            hit = (x @ x.T >= least) & ~np.eye(len(x), dtype=bool)
            root, _ = _roots(hit, ids, ids)
            linked = np.flatnonzero(hit.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array((hit @ n)[linked]), pa.array(root[linked])], names=["id", "links", "root"])

        for batch in batches:
            for width, *row in zip(*(batch.column(c).to_pylist() for c in ("width", "rep", "n", "body"))):
                if width != now and held:
                    yield from done()
                    held = []
                now = width
                held.append(row)
        if held:
            yield from done()

    return reps.repartition(fan_out(reps.sparkSession), "width").sortWithinPartitions("width", "rep").mapInArrow(work, "id long, links long, root long")


def _search(reps: DataFrame, total: int, least: float, target: float, sample: int, probes: int) -> tuple[DataFrame, dict]:
    """Links among `total` vectors of one width, through a grid of their own."""
    k = int(np.ceil(np.sqrt(total / CELL)))
    some = reps.select("rep", "body").orderBy(F.xxhash64("rep"), "rep").limit(max(sample, CELL * k)).collect()
    x = _unit([bytes(r["body"]) for r in some])
    half = x.shape[1] // 2
    grid = Grid(codebook(x[:, :half], k) if half else np.zeros((1, 0)), codebook(x[:, half:], k))
    queries = [(r["rep"], bytes(r["body"])) for r in some[: max(1, sample)]]
    visits, recall, links = cells_to_visit(reps, grid, queries, least, target, probes, total)
    return link(reps, grid, visits, least), {"vectors": total, "cells": k * k, "visited": visits, "recall": recall, "links": links}


def near_duplicates(embeddings: DataFrame, least: float = LEAST, target: float = TARGET, sample: int = SAMPLE, probes: int = PROBES, report: list | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept; see op10's contract. report gets, for each width with a grid, what was visited and the recall."""
    rows = materialise(vectors(embeddings), "vectors")
    marked = rows.select("vec_id", "length", "body").withColumn("key", F.md5("body"))
    alike = marked.filter("body is not null").dropDuplicates(["vec_id", "key"]).groupBy("key")
    reps = materialise(alike.agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("body").alias("body"), F.first("length").alias("width")), "reps")
    sizes = reps.groupBy("width").agg(F.count("*").alias("size"))
    wide = {r["width"]: r["size"] for r in sizes.filter(F.col("size") > CHUNK).collect()}  # a CHUNK-th of the vectors at most
    found = link_all(reps.filter(~F.col("width").isin(*wide)) if wide else reps, least)
    for width, size in sorted(wide.items()):
        more, told = _search(reps.filter(F.col("width") == width), size, least, target, sample, probes)
        found = found.unionByName(more)
        if report is not None:
            report.append({"width": width, **told})
    found = materialise(found, "found")
    part = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = reps.select("key", "rep", "n").join(counts, F.col("rep") == F.col("id"), "left").join(part, F.col("rep") == F.col("node"), "left")
    result = result.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = marked.select("vec_id", "key").join(result, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair compared: for tables of some thousand vectors.
OP10_SQL = """WITH RECURSIVE v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
 links AS (SELECT a.id, b.id AS other FROM ok a JOIN ok b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
 reached AS (SELECT id, id AS to_id FROM ok UNION SELECT r.id, l.other FROM reached r JOIN links l ON l.id = r.to_id),
 n AS (SELECT id, count(DISTINCT other) AS n FROM links GROUP BY 1), c AS (SELECT id, min(to_id) AS c FROM reached GROUP BY 1)
 SELECT CAST(vec_id AS BIGINT) AS vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
 FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id"""
