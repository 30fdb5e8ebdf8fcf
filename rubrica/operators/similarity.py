"""Exact similarity groups and nearest matches without a cross join.

Unit vectors with cosine above t lie closer than r = sqrt(2 - 2t).

* Exact copies collapse to one row first; rows of zero length have no direction
  and stay groups of their own.
* Vectors are rotated so that leading coordinates spread most, and the coordinates dealt
  to g groups.  Of a pair closer than r some group is closer than r / sqrt(g).  Every group
  has inverted lists: a row lives in the list that its leading coordinates, and the norm of
  the group's rest, choose by their side of a median.  It visits a list only if the distances
  to the medians it would cross (by Cauchy and Schwarz no partner there is nearer) stay
  within r / sqrt(g), and of two lists only the later one is visited by the other's rows.
* Data in clumps are better served by lists of another kind: cells of the nearest pivot, and a
  row visits those whose pivot is no further than the cell's radius and r.
* Which kind, and how many groups and lists there are, follows from a sample of fixed size, by
  the number of rows they would shuffle; any choice is exact.
* Long lists are cut into blocks.  Every pair of blocks is one task, which returns links that
  span its connected parts, never all pairs.
* Rows closer than r/2 to a common pivot (a core) are linked through it; large cores are
  blocks of their own, which are not compared with themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stored

CELL_ROWS = 4096
BLOCK_ROWS = 8192
TILE = 2048
MAX_PIVOTS = 1024
MAX_BITS = 16
LARGE = 4  # a core of so many blocks is not compared with itself
SAMPLE = 1024
SLACK = 1e-9
# Nearest match: rows of the tree's sample, its leaves and branches, rows of a block, cells of the second search, (row, leaf) pairs looked at together.
TREE_SAMPLE, MAX_LEAVES, BRANCHES, MATCH_ROWS, FEW, PAIRS = 1 << 15, 4096, 8, 8192, 4, 1 << 20


def choose_pivots(units: DataFrame, key: str, vector: str, apart: float, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """At most ``MAX_PIVOTS`` rows in hash order, thinned to a minimum distance."""
    rows = units.count()
    wanted = int(min(MAX_PIVOTS, max(1, -(-rows // cell_rows))))
    sample = units.orderBy(F.md5(F.col(key).cast("string"))).limit(wanted).select(vector).collect()
    kept: list[np.ndarray] = []
    for row in sample:
        v = np.asarray(row[0], dtype=float)
        if not kept or np.sqrt(((np.stack(kept) - v) ** 2).sum(axis=1)).min() >= apart:
            kept.append(v)
    return np.stack(kept) if kept else np.zeros((0, 1))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


@dataclass
class Lists:
    """Inverted lists over rotated coordinates: ``bits`` medians for each of ``groups`` groups."""

    rotation: np.ndarray
    groups: int
    bits: int
    budget: float
    medians: np.ndarray | None = None

    def features(self, vectors: np.ndarray) -> np.ndarray:
        """``[groups, rows, bits]``: leading coordinates of each group, and the norm of its other ones."""
        x = vectors @ self.rotation
        lead = max(self.bits - 1, 0)
        return np.stack([np.concatenate([x[:, g :: self.groups][:, :lead], np.linalg.norm(x[:, g :: self.groups][:, lead:], axis=1, keepdims=True)], axis=1)[:, : self.bits] for g in range(self.groups)])

    def reach(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(group, row, list, home)`` of every list that may hold a partner of a row."""
        for g, f in enumerate(self.features(vectors)):
            off = f - self.medians[g]
            home = (off > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
            row, found, used = np.arange(len(f)), home.copy(), np.zeros(len(f))
            for j in range(self.bits):
                more = used + off[row, j] ** 2
                flip = more <= self.budget + SLACK
                row, found, used = np.concatenate([row, row[flip]]), np.concatenate([found, found[flip] ^ (1 << j)]), np.concatenate([used, more[flip]])
            yield g, row, found, home


@dataclass
class Cells:
    """Lists by the nearest pivot; ``radius`` is that of all rows of a cell."""

    pivots: np.ndarray
    radius: np.ndarray
    r: float
    groups: int = 1

    @property
    def bits(self) -> int:
        return max(len(self.pivots) - 1, 1).bit_length()

    def reach(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        d = distances(vectors, self.pivots)
        home = d.argmin(axis=1)
        open_ = d <= self.radius + self.r + SLACK
        open_[np.arange(len(d)), home] = True
        row, found = np.nonzero(open_)
        yield 0, row, found, home


def shuffled(lists: Lists | Cells, sample: np.ndarray, rows: int, block_rows: int) -> float:
    """Copies of a row that the lists would shuffle, by the rows of a sample."""
    total = 0.0
    for _, row, found, home in lists.reach(sample):
        share = np.maximum(np.bincount(home, minlength=2**lists.bits) / len(home), 2.0**-lists.bits if isinstance(lists, Lists) else 0.0)
        visit = found > home[row]
        # A row is copied to all blocks of the lists it visits; of its own list half are met from the other side.
        blocks = np.maximum(1.0, share * rows / block_rows)
        total += blocks[home].sum() / 2 + len(home) / 2 + (1 + blocks[found[visit]]).sum()
    return total / len(sample)


def plan_lists(sample: np.ndarray, rows: int, r: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, cells: Cells | None = None) -> Lists | Cells:
    """The lists that shuffle the fewest rows: pivot cells, or a number of groups and bits."""
    width = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    best, least = cells, np.inf if cells is None else shuffled(cells, sample, rows, block_rows)
    for groups in (1, 2, 4, 8):
        if groups > width:
            break
        last = np.inf
        for bits in range(1 if groups > 1 else 0, min(MAX_BITS, width // groups, max(int(np.ceil(np.log2(max(rows / cell_rows, 1)))), 0)) + 1):
            lists = Lists(axes[:, ::-1], groups, bits, r * r / groups)
            lists.medians = np.median(lists.features(sample), axis=1)[:, None, :]
            cost = shuffled(lists, sample[:256], rows, block_rows)
            if cost < 0.99 * least:
                best, least = lists, cost
            if cost > 4 * last:
                break
            last = min(last, cost)
    return best


def block_pairs(units: DataFrame, key: str, vector: str, r: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(tasks, cores)``: rows dealt to pairs of blocks ``(pa, ba, pb, bb)`` with their side, and the links of each core."""
    spark, kind = units.sparkSession, dict(units.dtypes)[key]
    pivots = choose_pivots(units, key, vector, r / 2, cell_rows)
    sample = np.array([x[0] for x in units.orderBy(F.md5(F.col(key).cast("string"))).limit(SAMPLE).select(vector).collect()], float)

    def place(batches):
        for batch in batches:
            if len(batch):
                d = distances(np.stack(batch[vector].to_numpy()).astype(float), pivots)
                cell, near = d.argmin(axis=1).astype("int32"), d.min(axis=1)
                yield batch.assign(__cell=cell, __near=near, __core=np.where(near < r / 2 - 1e-6, cell, -1).astype("int32"))

    placed = stored(units.select(key, vector).mapInPandas(place, f"`{key}` {kind}, `{vector}` array<double>, __cell int, __near double, __core int"), "similarity-rows")
    radius, rows = np.full(len(pivots), -np.inf), 0
    for c in placed.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__near").alias("radius")).collect():  # at most MAX_PIVOTS
        radius[c["__cell"]], rows = c["radius"], rows + c["n"]
    lists = plan_lists(sample, rows, r, cell_rows, block_rows, Cells(pivots, radius, r))
    cores = placed.where("__core >= 0").groupBy("__core").agg(F.count("*").alias("n"), F.min(key).alias("__first"))
    large = np.array([c["__core"] for c in cores.where(F.col("n") > LARGE * block_rows).collect()], int)  # at most MAX_PIVOTS

    def deal(batches):
        for batch in batches:
            for start in range(0, len(batch), TILE):
                part = batch.iloc[start : start + TILE]
                own = part["__core"].to_numpy()
                own = np.where(np.isin(own, large), own, -1)
                for g, row, found, home in lists.reach(np.stack(part[vector].to_numpy()).astype(float)):
                    use = found >= home[row]
                    row, found = row[use], found[use]
                    yield pd.DataFrame(
                        {key: part[key].to_numpy()[row], vector: part[vector].to_numpy()[row], "__list": (g << lists.bits) + found, "__probe": found != home[row], "__sub": own[row].astype("int32")}
                    )

    members = stored(placed.mapInPandas(deal, f"`{key}` {kind}, `{vector}` array<double>, __list bigint, __probe boolean, __sub int"), "similarity-lists")
    group = ["__list", "__probe", "__sub"]
    sizes = members.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("__n"))
    named = F.concat_ws(":", F.col("__probe").cast("int"), "__sub", "__block").alias("__u")
    blocks = sizes.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(*group, named)
    a, b = (blocks.select(F.col("__list").alias(f"{s}l"), F.col("__probe").alias(f"{s}p"), F.col("__sub").alias(f"{s}s"), F.col("__u").alias(f"{s}u")) for s in "ab")
    # Visitors are not compared with visitors, nor a large core with itself.
    met = (F.col("al") == F.col("bl")) & (F.col("au") <= F.col("bu")) & ~(F.col("ap") & F.col("bp")) & ~((F.col("as") == F.col("bs")) & (F.col("as") >= 0))
    pairs = a.join(b, met).select(F.col("al").alias("__list"), F.col("au").alias("__ba"), F.col("bu").alias("__bb"))
    dealt = members.join(sizes, group).withColumn("__block", F.pmod(F.xxhash64(key), F.col("__n").cast("bigint")).cast("int")).select(key, vector, "__list", named)

    def side(u: str, left: bool) -> DataFrame:
        other = pairs if left else pairs.where("__ba <> __bb")
        return dealt.join(other.withColumn("__u", F.col(u)), ["__list", "__u"]).select(
            key, vector, F.col("__list").alias("__pa"), "__ba", F.col("__list").alias("__pb"), "__bb", F.lit(left).alias("__left"), (F.col("__ba") == F.col("__bb")).alias("__both")
        )

    near = placed.where("__core >= 0").join(F.broadcast(cores.select("__core", "__first")), "__core")
    return side("__ba", True).unionByName(side("__bb", False)), near.where(F.col(key) != F.col("__first")).select(F.col(key).alias("a"), F.col("__first").alias("b"))


def spanning(near: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row and, after them, each column of a link matrix."""
    rows, columns = near.shape
    label = np.arange(rows + columns)
    while True:
        low = np.minimum(label[:rows], np.where(near, label[None, rows:], rows + columns).min(axis=1, initial=rows + columns))
        right = np.minimum(label[rows:], np.where(near, low[:, None], rows + columns).min(axis=0, initial=rows + columns))
        new = np.concatenate([low, right])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def similarity_links(
    units: DataFrame, key: str, vector: str, threshold: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Links ``(a, b)`` whose connected components are those of all pairs above the threshold.

    Rows without a direction (a NULL in the unit vector) have no links.
    """
    r = float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0)))
    kind = dict(units.dtypes)[key]
    units = units.where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    copies = units.groupBy(vector).agg(F.min(key).alias("__copy"))
    same = units.join(copies, vector).where(F.col(key) != F.col("__copy")).select(F.col(key).alias("a"), F.col("__copy").alias("b"))
    single = stored(copies.select(F.col("__copy").alias(key), vector), "similarity-units")
    if single.isEmpty():
        return same
    tasks, cores = block_pairs(single, key, vector, r, cell_rows, block_rows)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        both = group["__both"].to_numpy()
        a = group[group["__left"] | both]
        b = group[~group["__left"] | both]
        found = [pd.DataFrame({"a": group[key][:0], "b": group[key][:0]})]
        for i in range(0, len(a) if len(b) else 0, TILE):
            left = np.stack(a[vector].to_numpy()[i : i + TILE]).astype(float)
            for j in range(0, len(b), TILE):
                keys = np.concatenate([a[key].to_numpy()[i : i + TILE], b[key].to_numpy()[j : j + TILE]])
                label = spanning(left @ np.stack(b[vector].to_numpy()[j : j + TILE]).astype(float).T > threshold)
                tied = keys != keys[label]
                found.append(pd.DataFrame({"a": keys[tied], "b": keys[label][tied]}))
        return pd.concat(found, ignore_index=True)

    found = tasks.groupBy("__pa", "__ba", "__pb", "__bb").applyInPandas(link, f"a {kind}, b {kind}")
    return same.unionByName(found).unionByName(cores).where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` with the smallest node as label, for nodes with a link.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): the number of rounds grows with
    the logarithm of the graph, and each round is an aggregate and a join.  The
    edges are checkpointed once per round.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_min.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        edges = cut_lineage(small)
        summary = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if summary == state:
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.unionByName(roots)
        state = summary
    raise ValueError("Components did not settle")


def similarity_groups(df: DataFrame, key: str, vector: str, reference: DataFrame, dimension: int, threshold: float, **sizes) -> DataFrame:
    """Group label per row: connected components of pairs above the cosine threshold.

    Rows are centred on the reference mean first.  The label is the smallest key.
    """
    from .vectors import centred_units

    units = cut_lineage(centred_units(df.select(key, vector), vector, reference, dimension).select(key, "unit"))
    links = similarity_links(units, key, "unit", threshold, **sizes)
    components = connected_components(links).withColumnRenamed("node", key)
    return units.select(key).join(components, key, "left").select(key, F.coalesce("component", key).alias("group"))


def has_partner(groups: DataFrame, key: str, group: str = "group") -> DataFrame:
    """Rows that share a component with another row (so some row is above the threshold)."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("n"))
    return groups.join(sizes, group).select(key, (F.col("n") > 1).alias("has_partner"))


@dataclass
class Tree:
    """A metric tree: ``children[node]`` (none for a leaf), centres, and, once rows are counted, radii and leaf sizes."""

    centres: np.ndarray
    children: list[list[int]]
    radius: np.ndarray | None = None
    size: np.ndarray | None = None

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and the distance to its centre, going to the nearest child at every level; only nodes with rows count, once they are counted."""
        node = np.zeros(len(vectors), int)
        while True:
            moved = False
            for n in np.unique(node):
                below = [c for c in self.children[n] if self.size is None or self.size[c] > 0]
                if below:
                    at = np.flatnonzero(node == n)
                    node[at] = np.array(below)[distances(vectors[at], self.centres[below]).argmin(axis=1)]
                    moved = True
            if not moved:
                return node, np.sqrt(np.maximum(2 - 2 * (vectors * self.centres[node]).sum(axis=1), 0))

    def count(self, rows: dict[int, tuple[int, float]]) -> None:
        """Sizes and radii from those of the leaves; an inner node reaches as far as its children do."""
        self.size, self.radius = np.zeros(len(self.children), int), np.zeros(len(self.children))
        for n in reversed(range(len(self.children))):  # children come after their parents
            if not self.children[n]:
                self.size[n], self.radius[n] = rows.get(n, (0, 0.0))
            else:
                live = [c for c in self.children[n] if self.size[c]]
                self.size[n] = sum(self.size[c] for c in live)
                if live:
                    self.radius[n] = (distances(self.centres[[n]], self.centres[live])[0] + self.radius[live]).max()

    def open_leaves(self, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, distance)``: leaves that may hold something nearer than ``bound`` of the row, and how near at best."""
        out, level = [], [(0, np.arange(len(vectors)), np.zeros(len(vectors)))]
        while level:
            below = []
            for n, row, least in level:
                if not self.children[n]:
                    out.append((row, np.full(len(row), n), least))
                    continue
                for c in self.children[n]:
                    if self.size[c]:
                        near = np.maximum(least, distances(vectors[row], self.centres[[c]])[:, 0] - self.radius[c])
                        use = near <= bound[row] + SLACK
                        if use.any():
                            below.append((c, row[use], near[use]))
            level = below
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def cells(self, rows: int) -> np.ndarray:
        """A cell for each leaf: leaves that follow each other in the tree share one while it has no more than so many rows."""
        cell, now, held, todo = np.full(len(self.children), -1), -1, 0, [0]
        while todo:
            n = todo.pop()
            todo.extend(reversed(self.children[n]))
            if not self.children[n] and self.size[n]:
                if now < 0 or held + self.size[n] > rows:
                    now, held = n, 0
                cell[n], held = now, held + self.size[n]
        return cell


def build_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Levels of ``BRANCHES`` children: centres lie far apart among a node's sample rows, which go to the nearest one."""
    least = max(len(sample) // max(leaves, 1), 1)
    centres, children, todo = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [[]], [(0, np.arange(len(sample)))]
    centres[0] = centres[0] / (np.linalg.norm(centres[0]) or 1.0) if np.linalg.norm(centres[0]) > 1e-9 else sample[0]
    while todo:
        node, own = todo.pop(0)
        if len(own) <= least:
            continue
        x = sample[own]
        picked, far = [0], distances(x, x[[0]])[:, 0]
        while len(picked) < BRANCHES and far.max() > 1e-6:
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances(x, x[[picked[-1]]])[:, 0])
        if len(picked) < 2:
            continue
        near = distances(x, x[picked]).argmin(axis=1)
        for k in range(len(picked)):
            mine = own[near == k]
            if not len(mine):
                continue
            centre = sample[mine].mean(axis=0)
            norm = np.linalg.norm(centre)
            centres.append(centre / norm if norm > 1e-9 else x[picked[k]])
            children.append([])
            children[node].append(len(children) - 1)
            todo.append((len(children) - 1, mine))
    return Tree(np.stack(centres), children)


def nearest_match(
    left: DataFrame, right: DataFrame, key: str, vector: str, cell_rows: int = CELL_ROWS, block_rows: int = MATCH_ROWS, count_seen: bool = False
) -> DataFrame:
    """Exact best cosine of each left unit vector among the right ones.

    Right rows live in the leaves of a metric tree of several levels, grown from a sample of
    fixed size, whose nodes know how far their rows reach; small leaves beside each other are
    one cell.  A left row is matched in its own cell first, then in the few cells that may hold
    something nearest, and at last in all cells that what it has found leaves open; every search
    narrows the next.  A row is stored once with the cells it is to visit, and is copied only on
    its way to their blocks, so a task holds two blocks whatever the number of open cells is.  A
    row without a direction, or without any row to match, has a NULL match.  With
    ``count_seen``, ``seen`` is the number of right rows that a left row was compared with.
    """
    spark, kind = left.sparkSession, dict(left.dtypes)[key]
    directed = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    right = stored(right.select(key, vector).where(directed), "match-right")
    everything = stored(left.select(key, vector), "match-left")
    left = everything.where(directed)
    none = [F.lit(None).cast(kind).alias("match"), F.lit(None).cast("double").alias("cosine"), *([F.lit(0).cast("bigint").alias("seen")] if count_seen else [])]
    sample = right.orderBy(F.md5(F.col(key).cast("string"))).limit(TREE_SAMPLE).select(vector).collect()
    if not sample:
        return everything.select(key, *none)
    tree = build_tree(np.array([x[0] for x in sample], float), int(min(MAX_LEAVES, max(1, -(-right.count() // cell_rows)))))

    def settle(batches):
        for batch in batches:
            if len(batch):
                leaf, near = tree.home(np.stack(batch[vector].to_numpy()).astype(float))
                yield batch.assign(leaf=leaf.astype("int32"), distance=near)

    homes = stored(right.mapInPandas(settle, f"`{key}` {kind}, `{vector}` array<double>, leaf int, distance double"), "match-homes")
    leaves = homes.groupBy("leaf").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    tree.count({r["leaf"]: (r["n"], r["radius"]) for r in leaves.collect()})  # at most MAX_LEAVES rows and some
    cell_of = tree.cells(cell_rows)
    held = np.bincount(cell_of[cell_of >= 0], tree.size[cell_of >= 0]).astype(int)
    sizes = spark.createDataFrame([(n, int(s), int(-(-s // block_rows))) for n, s in enumerate(held) if s], "cell int, n bigint, rb int")
    named = spark.createDataFrame([(n, int(c)) for n, c in enumerate(cell_of) if c >= 0], "leaf int, cell int")
    homes = homes.join(F.broadcast(named), "leaf").select(key, vector, "cell")

    def search(wanted: DataFrame) -> DataFrame:
        """Rows are compared with all of the ``cells`` that they name."""
        loads = wanted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
        split = F.broadcast(sizes.join(loads, "cell").select("cell", "rb", F.ceil(F.col("m") / F.lit(float(block_rows))).cast("int").alias("lb")))
        slot = lambda n: F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")
        l = wanted.select(key, vector, F.explode("cells").alias("cell")).join(split, "cell").select(
            key, vector, "cell", slot("lb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("j"), F.lit(True).alias("is_left")
        )
        r = homes.join(split, "cell").select(
            key, vector, "cell", F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("i"), slot("rb").alias("j"), F.lit(False).alias("is_left")
        )

        def match(group: pd.DataFrame) -> pd.DataFrame:
            a, b = group[group["is_left"]], group[~group["is_left"]]
            if not len(a) or not len(b):
                return pd.DataFrame({key: a[key][:0], "match": a[key][:0], "cosine": np.zeros(0), "seen": np.zeros(0, int)})
            b = b.sort_values(key)
            found, others = [], np.stack(b[vector].to_numpy()).astype(float).T
            for start in range(0, len(a), TILE // 4):
                part = a.iloc[start : start + TILE // 4]
                cosine = np.stack(part[vector].to_numpy()).astype(float) @ others
                best = cosine.argmax(axis=1)
                found.append(pd.DataFrame({key: part[key].to_numpy(), "match": b[key].to_numpy()[best], "cosine": cosine[np.arange(len(part)), best], "seen": len(b)}))
            return pd.concat(found, ignore_index=True)

        return l.unionByName(r).groupBy("cell", "i", "j").applyInPandas(match, f"`{key}` {kind}, match {kind}, cosine double, seen bigint")

    def best(found: DataFrame) -> DataFrame:
        top = found.groupBy(key).agg(F.min_by(F.struct("match", "cosine"), F.struct(-F.col("cosine"), F.col("match"))).alias("b"), F.sum("seen").alias("seen"))
        return top.select(key, "b.match", "b.cosine", "seen")

    shape = f"`{key}` {kind}, `{vector}` array<double>, cells array<int>"
    tile = int(min(max(PAIRS // len(tree.children), 1), TILE))

    def begin(batches):
        for batch in settle(batches):
            yield batch[[key, vector]].assign(cells=list(cell_of[batch["leaf"].to_numpy()].astype("int32")[:, None]))

    done = stored(best(search(left.mapInPandas(begin, shape))), "match-found")
    for first, last in ((0, FEW), (FEW, None)):
        # What was open before this search, in order of the least distance, without what was searched.
        def visit(batches, first=first, last=last):
            for batch in batches:
                for start in range(0, len(batch), tile):
                    part = batch.iloc[start : start + tile]
                    x = np.stack(part[vector].to_numpy()).astype(float)
                    widest = np.sqrt(np.maximum(2 - 2 * part["first"].to_numpy(), 0))
                    row, leaf, near = tree.open_leaves(x, widest)
                    cell, own = cell_of[leaf], cell_of[tree.home(x)[0]]
                    order = np.lexsort((near, cell, row))
                    row, cell, near = row[order], cell[order], near[order]
                    # A cell is as near as the nearest of its leaves.
                    use = (cell != own[row]) & np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])[: len(row)]
                    row, cell, near = row[use], cell[use], near[use]
                    order = np.lexsort((cell, near, row))
                    row, cell, near = row[order], cell[order], near[order]
                    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row]
                    bound = np.sqrt(np.maximum(2 - 2 * part["cosine"].to_numpy(), 0))
                    use = (place >= first) & (place < (len(row) if last is None else last)) & (near <= bound[row] + SLACK)
                    row, cell = row[use], cell[use].astype("int32")
                    some, begin = np.unique(row, return_index=True)
                    if len(some):
                        yield part.iloc[some][[key, vector]].assign(cells=np.split(cell, begin[1:]))

        if first == 0:
            done = done.withColumn("first", F.col("cosine"))
        wanted = stored(left.join(done.select(key, "cosine", "first"), key).mapInPandas(visit, shape), "match-wanted")
        if not wanted.isEmpty():
            start = done.select(key, "first")
            done = stored(best(done.drop("first").unionByName(search(wanted))).join(start, key), "match-found")
    undirected = everything.join(left.select(key), key, "left_anti").select(key, *none)
    return done.select(*[c for c in (key, "match", "cosine", "seen") if c != "seen" or count_seen]).unionByName(undirected)
