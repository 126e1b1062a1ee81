"""Near-duplicate vectors by E8 lattice hashing.

* Equal vectors of a label are one class, represented by the smallest id, with a count.
* For each of ``TABLES`` tables the direction of a vector is projected at random to
  ``LATTICES`` times 8 dimensions, and each 8 are decoded to the nearest point of the E8
  lattice. The points of a table together name the vector's home cell. It also enters
  ``LATTICES`` neighbouring cells, each with one point exchanged for the best point of
  the lattice's other coset. Two vectors meet where they share a cell.
* Cells with a single class go; in the others all pairs are verified by cosine in double
  precision, as matrix products of at most ``BLOCK`` by ``BLOCK``. A cell with more classes
  is dealt into blocks and each pair of blocks is a task of its own, so no pair is dropped
  and no task holds a whole hot cell.
* A pair that meets in several cells counts in the smallest cell that it shares in the first
  table where it shares one; both vectors' cells follow from the vectors, so this needs no
  exchange. Only link counts and a spanning forest leave a task.

At cosine 0.93 a pair shares no cell of any table with probability below 0.005 (it falls
fast above that); tests measure the recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.components import components
from wordmill.llm.durable import durable
from wordmill.llm.shipping import ship
from wordmill.llm.wordhash import mixed

TABLES, LATTICES, SCALE, SEED = 16, 2, 1.5, 8
CELLS = 1 + LATTICES
BLOCK = 256
#: Rows of cells that are verified in one call, about; pairs that are looked at together.
PACK_ROWS, _PAIRS = 4000, 20_000


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers with an even sum."""
    f = np.rint(y)
    gap = y - f
    worst = np.abs(gap).argmax(axis=1)
    at = np.arange(len(y))
    odd = np.mod(f.sum(axis=1), 2) == 1
    f[at, worst] += np.where(odd, np.where(gap[at, worst] >= 0, 1.0, -1.0), 0.0)
    return f


def decode_e8(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest E8 point, best point of the other coset), both doubled to integers."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = (((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None]
    return (2 * np.where(nearer, a, b)).astype(np.int64), (2 * np.where(nearer, b, a)).astype(np.int64)


_projections: dict[int, np.ndarray] = {}


def _projection(dim: int) -> np.ndarray:
    if dim not in _projections:
        _projections[dim] = np.random.default_rng([SEED, dim]).normal(size=(dim, TABLES * LATTICES * 8)) * SCALE / 8**0.5
    return _projections[dim]


_PLACE = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(n, TABLES, CELLS) signed 64-bit names; home cell first."""
    n, dim = unit.shape
    y = (unit @ _projection(dim)).reshape(n * TABLES * LATTICES, 8)
    near, other = decode_e8(y)
    name = lambda p: mixed((p.astype(np.uint64) * _PLACE).sum(axis=1, dtype=np.uint64)).reshape(n, TABLES, LATTICES)
    home, moved = name(near), name(other)
    weight = mixed(np.arange(11, 11 + LATTICES, dtype=np.uint64)) | np.uint64(1)
    base = mixed(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))[:, None] + mixed(np.arange(101, 101 + TABLES, dtype=np.uint64))
    own = (home * weight).sum(axis=2, dtype=np.uint64) + base
    found = [own] + [own + (moved[:, :, i] - home[:, :, i]) * weight[i] for i in range(LATTICES)]
    return mixed(np.stack(found, axis=2)).view(np.int64)


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _counted(names: np.ndarray, tab: np.ndarray, cell: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) that meet in ``cell`` of ``tab`` count there: they share no cell
    of an earlier table and no smaller cell of this one."""
    out = np.ones(len(i), dtype=bool)
    for x in range(CELLS):
        for y in range(CELLS):
            same = names[i, :, x] == names[j, :, y]
            out &= ~(same & (np.arange(TABLES) < tab[:, None])).any(axis=1)
            here = np.arange(len(i)), tab
            out &= ~(same[here] & (names[i, tab, x] < cell))
    return out


def _links(unit: np.ndarray, rows: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked rows of many cells: (id, root in its cell, links that count in this cell)."""
    order = np.lexsort((rows["rep"], rows["b2"], rows["b1"], rows["cell"], rows["tab"]))
    unit, rows = unit[order], {c: v[order] for c, v in rows.items()}
    rep, mine = rows["rep"], rows["mine"]
    fresh = np.zeros(len(rep), dtype=bool)
    fresh[:1] = True
    for c in ("tab", "cell", "b1", "b2"):
        fresh[1:] |= rows[c][1:] != rows[c][:-1]
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(rep))
    left, right = [], []
    twos = starts[ends - starts == 2]
    near = np.einsum("ij,ij->i", unit[twos], unit[twos + 1]) >= threshold
    left.append(twos[near])
    right.append(twos[near] + 1)
    for s, e in zip(starts, ends):
        if e - s > 2:
            a, b = np.nonzero(np.triu(unit[s:e] @ unit[s:e].T >= threshold, 1))
            left.append(a + s)
            right.append(b + s)
    i, j = np.concatenate(left), np.concatenate(right)
    crossing = (rep[i] != rep[j]) & ((rows["b1"][i] == rows["b2"][i]) | (mine[i] != mine[j]))
    i, j = i[crossing], j[crossing]
    root = np.arange(len(rep))
    while True:  # rows of a cell are sorted by id, so the smallest place is the smallest id
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    n = np.zeros(len(rep), dtype=np.int64)
    names = cells(unit, rows["label"])
    for at in range(0, len(i), _PAIRS):
        p, q = i[at : at + _PAIRS], j[at : at + _PAIRS]
        take = _counted(names, rows["tab"][p], rows["cell"][p], p, q)
        np.add.at(n, p[take], rows["copies"][q[take]])
        np.add.at(n, q[take], rows["copies"][p[take]])
    linked = np.zeros(len(rep), dtype=bool)
    linked[i] = linked[j] = True
    return rep[linked], rep[root[linked]], n[linked]


CLEAN = "id long, label long, vec binary"


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; null where a vector can't be compared."""
    for b in batches:
        lists = b.column("vec")
        values = lists.flatten()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        ends = np.cumsum(lengths)
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        bad, some = upto(~np.isfinite(x)), upto(x != 0)
        usable = (bad[ends] == bad[ends - lengths]) & (some[ends] > some[ends - lengths]) & ~b.column("label").is_null().to_numpy(zero_copy_only=False)
        raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int64).tobytes()), pa.py_buffer(x.tobytes())])
        vec = pc.if_else(pa.array(usable), raw, pa.scalar(None, pa.large_binary())).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), vec], names=["id", "label", "vec"])


def _enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs, reps, labels = b.column("vec").to_pylist(), b.column("rep").to_numpy(), b.column("label").to_numpy()
        lengths = np.array([len(v) for v in vecs])
        for size in np.unique(lengths):
            which = np.flatnonzero(lengths == size)
            names = cells(_unit([vecs[i] for i in which]), labels[which])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[which], TABLES * CELLS)), pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), CELLS), len(which))), pa.array(names.reshape(-1))], names=["rep", "tab", "cell"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of the same label (and length) are linked where their cosine is at least
    ``threshold``. Null, empty and zero vectors, vectors with null or non-finite
    components, rows with a null label or id are linked with nothing: n_links 0, their
    own component, kept. ``n_links`` counts rows, so a vector with k equal copies has
    them among its links. Repeated ids are rows of their own. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    clean = durable(vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast("array<double>").alias("vec")).mapInArrow(_clean, CLEAN), "vectors")
    usable = clean.filter("vec IS NOT NULL AND id IS NOT NULL")
    classes = durable(usable.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")

    entered = durable(classes.select("rep", "label", "vec").mapInArrow(_enter, "rep long, tab int, cell long").distinct(), "cells")
    shared = durable(entered.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-cells")
    meeting = durable(entered.join(shared, ["tab", "cell"]), "meeting")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    packs = max(1, -(-(meeting.agg(F.sum(blocks)).first()[0] or 0) // PACK_ROWS))  # a row goes to every block of its cell
    dealt = (
        meeting.join(classes.select("rep", "label", "vec", "copies"), "rep")
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "label", "vec", "copies", "tab", "cell", "mine", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"))
        .withColumn("pack", F.pmod(F.xxhash64("tab", "cell", "b1", "b2"), F.lit(packs)).cast("int"))
    )

    def verify(table: pa.Table) -> pa.Table:
        vecs = table.column("vec").to_pylist()
        lengths = np.array([len(v) for v in vecs])
        columns = {c: table.column(c).to_numpy() for c in ("rep", "label", "copies", "tab", "cell", "mine", "b1", "b2")}
        found = [_links(_unit([vecs[i] for i in which]), {c: v[which] for c, v in columns.items()}, threshold) for size in np.unique(lengths) for which in [np.flatnonzero(lengths == size)]]
        rep, root, n = (np.concatenate(x) for x in zip(*found))
        return pa.table({"rep": rep, "root": root, "n": n})

    found = durable(dealt.groupBy("pack").applyInArrow(verify, "rep long, root long, n long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
    answers = durable(
        classes.join(counts, "rep", "left")
        .join(joined.withColumnRenamed("v", "rep"), "rep", "left")
        .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "vector-answers",
    )
    plain = clean.filter("vec IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    rows = usable.join(answers, ["label", "vec"]).select("id", "n_links", "component").union(plain)
    return rows.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
