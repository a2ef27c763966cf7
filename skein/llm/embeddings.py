"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cosine >= c means a squared distance of at most D = 2 - 2c. After a
fixed random rotation the dimensions are split into blocks; a pair within D is within
its share D * size / dims in at least one block. Each block is range-joined on a grid
over its leading coordinates: a vector is at home in one cell and visits the cells
within reach. Inside a cell, splits at medians of all coordinates of the block leave only
vectors within reach of each other to be checked in the block, then exactly (cosine in
double precision), and counted in the first block only that finds them.

Equal vectors of a label are one class before the join. Home rows of a crowded cell
are dealt over several tasks, which stream the cell's visitors past a bounded block
of home rows. Tasks emit a count and one link a member, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.graph import components
from skein.llm.simhash import _star
from skein.plans.runtime import prepare, stage

COSINE = 0.98
BLOCKS = 8
#: Cell width in reaches of a block's budget, and the share of a label's vectors that the cells in reach along one coordinate hold, about.
WIDTH, SHARE = 2.0, 0.45
#: Home rows that a task holds of a cell, about; visitors are streamed past them in tiles; sets no larger than LEAF aren't split.
HOME_ROWS = 4096
TILE = 4096
LEAF = 48
_SLACK = 1 + 1e-6


def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _plan(dims: int, cosine: float) -> list[tuple[slice, float]]:
    """Each block's dimensions and squared budget."""
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    return [(slice(a, b), (2 - 2 * cosine) * (b - a) / dims) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions; scaled by the largest component first, so that very large and very small vectors keep theirs."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _visits(cosine: float, grid: int, dtype: str, with_vec: bool):
    """Rows (cls, n, label, dims, vec) to their cells: one home row a block, and a visitor row for each lower cell in reach.

    Of two cells in reach of each other only the lower one is visited, so a block finds a pair once.
    """
    names = ["label", "dims", "blk", "cell", "role", "cls", "n", *["vec"] * with_vec]

    def run(batches):
        for b in batches:
            dims, cls, n, lab = (b.column(c).to_numpy() for c in ("dims", "cls", "n", "label"))
            raw = b.column("vec").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _unit(np.array([np.frombuffer(raw[i], dtype) for i in at]).astype(float)) @ _rotation(int(d))
                out: list[list[np.ndarray]] = [[] for _ in range(4)]
                for k, (where, budget) in enumerate(_plan(int(d), cosine)):
                    reach = np.sqrt(budget) * _SLACK
                    y = x[:, where][:, :grid]
                    g = y.shape[1]
                    cell, lo, hi = (np.floor(z / (WIDTH * reach)).astype(np.int64) for z in (y, y - reach, y + reach))
                    for step in np.ndindex(*[3] * g):
                        if step > (1,) * g:
                            continue
                        c = cell + np.array(step) - 1
                        ok = ((c >= lo) & (c <= hi)).all(axis=1)
                        code = np.zeros(len(c), np.int64)
                        for j in range(g):
                            code = code * 100_003 + c[:, j] + 50_000
                        for o, v in zip(out, (at[ok], np.full(ok.sum(), k), code[ok], np.full(ok.sum(), int(step != (1,) * g))), strict=True):
                            o.append(v)
                idx, blk, code, role = (np.concatenate(o) for o in out)
                for s in range(0, len(idx), 4000):
                    e = slice(s, s + 4000)
                    i = idx[e]
                    cols = [pa.array(lab[i], pa.int64()), pa.array(np.full(len(i), d), pa.int32()), pa.array(blk[e], pa.int32()), pa.array(code[e], pa.int64()), pa.array(role[e], pa.int32()), pa.array(cls[i], pa.int64()), pa.array(n[i], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([raw[j] for j in i], pa.binary())] * with_vec, names)

    return run


def grid_dims(n: int, dims: int) -> int:
    """Over how many leading coordinates of a block the grid goes: those that shuffle the fewest rows, for n vectors of the largest label.

    A vector visits 2^g / 2 lower cells, and each of the salts that a cell's home rows are dealt over.
    """
    return min(range(1, max(1, dims // BLOCKS) + 1), key=lambda g: (1 + 2**g / 2) * max(1.0, n * SHARE**g / HOME_ROWS))


def near_pairs(p: np.ndarray, q: np.ndarray, budget: float, same: bool):
    """Arrays i, j, and the number of checks, that hold all pairs of rows of p and q within the squared distance budget; same: q is p, each pair of different rows once, in either order."""
    reach, work = np.sqrt(budget) * _SLACK, [(np.arange(len(p)), np.arange(len(q)), same, 0)]
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    width = p.shape[1]
    while work:
        i, j, same, depth = work.pop()
        if not len(i) or not len(j):
            continue
        if min(len(i), len(j)) <= LEAF or depth >= 3 * width:
            for s in range(0, len(i), TILE):  # as many as that only where nothing splits them
                a = i[s : s + TILE]
                x, y = np.nonzero(pp[a][:, None] + qq[j][None, :] - 2 * p[a] @ q[j].T <= budget * _SLACK + 1e-12)
                if same:
                    x, y = x[a[x] < j[y]], y[a[x] < j[y]]
                yield a[x], j[y], len(a) * len(j)
            continue
        axis = depth % width
        u, v = p[i, axis], q[j, axis]
        cut = np.median(u)
        low = u < cut
        if same:
            work += [(i[low], i[low], True, depth + 1), (i[~low], i[~low], True, depth + 1), (i[low & (u >= cut - reach)], i[~low & (u < cut + reach)], False, depth + 1)]
        else:
            work += [(i[low], j[v < cut + reach], False, depth + 1), (i[~low], j[v >= cut - reach], False, depth + 1)]


class _Rows:
    def __init__(self, rows: list[tuple], dtype: str, rotation: np.ndarray):
        self.cls, self.n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.unit = _unit(np.array([np.frombuffer(r[2], dtype) for r in rows]).astype(float))
        self.turned = self.unit @ rotation


class _Cell:
    """Home rows of one cell and salt, past which the cell's visitors are streamed."""

    def __init__(self, dims: int, blk: int, cosine: float, dtype: str):
        self.plan, self.blk, self.cosine, self.dtype, self.rotation = _plan(dims, cosine), blk, cosine, dtype, _rotation(dims)
        self.rows: tuple[list, list] = ([], [])
        self.home: _Rows | None = None
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.a = self.b = np.empty(0, np.int64)

    def add(self, role: int, row: tuple):
        self.rows[role].append(row)
        if role and len(self.rows[1]) >= TILE:
            self.flush()

    def flush(self):
        if not self.rows[0]:
            return
        if self.home is None:
            self.home = _Rows(self.rows[0], self.dtype, self.rotation)
            self.match(self.home, True)
        if self.rows[1]:
            self.match(_Rows(self.rows[1], self.dtype, self.rotation), False)
            self.rows[1].clear()

    def match(self, other: _Rows, same: bool):
        home = self.home

        def within(k, i, j):
            where, budget = self.plan[k]
            return ((home.turned[i, where] - other.turned[j, where]) ** 2).sum(axis=1) <= budget * _SLACK

        where, budget = self.plan[self.blk]
        n_home, n_other, trees = np.zeros(len(home.cls)), np.zeros(len(other.cls)), []
        for i, j, _ in near_pairs(home.turned[:, where], other.turned[:, where], budget, same):
            keep = home.cls[i] != other.cls[j]
            i, j = i[keep], j[keep]
            keep = within(self.blk, i, j)
            for k in range(self.blk):  # the first block that finds a pair counts it
                keep &= ~within(k, i, j)
            i, j = i[keep], j[keep]
            keep = (home.unit[i] * other.unit[j]).sum(axis=1) >= self.cosine
            if keep.any():
                i, j = i[keep], j[keep]
                n_home += np.bincount(i, other.n[j], len(n_home))
                n_other += np.bincount(j, home.n[i], len(n_other))
                trees.append(_star(home.cls[i], other.cls[j]))
        for cls, n in ((home.cls, n_home), (other.cls, n_other)):
            if n.any():
                self.counts.append((cls[n > 0], n[n > 0].astype(np.int64)))
        if trees:
            self.a, self.b = _star(*(np.concatenate(x) for x in zip((self.a, self.b), *trees, strict=True)))

    def result(self):
        self.flush()
        for cols in ([(c, n, np.full(len(c), -1)) for c, n in self.counts] + [(self.a, np.zeros(len(self.a)), self.b)]):
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["cls", "n", "to"])


def _joiner(cosine: float, dtype: str):
    def run(batches):
        key, cell = None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("label", "dims", "blk", "cell", "salt", "role", "cls", "n", "vec")]
            for label, dims, blk, code, salt, role, cls, n, vec in zip(*cols, strict=True):
                if (now := (label, dims, blk, code, salt)) != key:
                    if cell:
                        yield from cell.result()
                    key, cell = now, _Cell(dims, blk, cosine, dtype)
                cell.add(role, (cls, n, vec))
        if cell:
            yield from cell.result()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, label, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Labels may be of any type; vectors link when their labels are equal and not null, their dimensions are equal and their cosine in double
    precision is at least cosine. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Repeated rows are separate vectors: equal to one another, and so linked. A null vec_id counts as a vector,
    but is no component_id unless nothing else is reachable. No rows give no rows.
    """
    spark = prepare(vectors.sparkSession)
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(ok, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct(F.col("label").cast("string").alias("l"), "v")), 256)))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("label", "v")).alias("x"))
    classes = stage(classes.select("key", "least", "n", "x.label", "x.v", F.monotonically_increasing_id().alias("cls")), "vec-classes")
    dtype = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    pack = F.pandas_udf(lambda s: s.map(lambda a: np.asarray(a, dtype).tobytes()), "binary")
    names = stage(classes.groupBy("label").agg(F.min("cls").alias("name"), F.count("*").alias("c"), F.max(F.size("v")).alias("dims")), "vec-labels")
    packed = classes.join(names.select("label", "name"), "label").select(F.col("name").alias("label"), F.size("v").alias("dims"), "cls", "n", pack("v").alias("vec"))
    largest = names.agg(F.max("c"), F.max("dims")).first()
    grid = grid_dims(largest[0] or 0, largest[1] or 1)
    cell, schema = ["label", "dims", "blk", "cell"], "label long, dims int, blk int, cell long, role int, cls long, n long"
    homes = packed.mapInArrow(_visits(cosine, grid, dtype, False), schema).where("role = 0")
    crowd = stage(homes.groupBy(*cell).agg(F.ceil(F.count("*") / HOME_ROWS).cast("int").alias("salts")).where("salts > 1"), "vec-crowd")
    visits = packed.mapInArrow(_visits(cosine, grid, dtype, True), f"{schema}, vec binary").join(crowd, cell, "left")
    salts = F.coalesce("salts", F.lit(1))
    own = F.pmod(F.xxhash64("cls"), salts).cast("int")
    # a home row visits the salts below its own, so that two home rows of a cell meet once
    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, own).otherwise(salts - 1))))
    visits = visits.withColumn("role", F.when((F.col("role") == 0) & (F.col("salt") == own), 0).otherwise(1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = visits.select(*cell, "salt", "role", "cls", "n", "vec").repartition(tasks, *cell, "salt").sortWithinPartitions(*cell, "salt", "role").mapInArrow(_joiner(cosine, dtype), "cls long, n long, to long")
    found = stage(found, "vec-found")
    counts = found.where("to < 0").groupBy("cls").agg(F.sum("n").alias("others"))
    comp = components(found.where("to >= 0").select("cls", "to")).withColumnRenamed("node", "cls")
    per = classes.select("cls", "key", "n", "least").join(counts, "cls", "left").join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    per = stage(per, "vec-per-class")
    first = stage(per.groupBy("root").agg(F.min("least").alias("component_id")), "vec-first")
    per = stage(per.join(first, "root").select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vec-label")
    out = rows.select("vec_id", "label", "key").join(per, "key", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
