"""Near-duplicates of word-shingle sets by SetSketch registers.

* Each document's set becomes ``REGISTERS`` registers: the minimum of exponentially
  distributed hashes, truncated to powers of a base close to 1. Registers of two sets
  merge by their maximum, and are equal with a probability close to the sets' Jaccard
  similarity.
* Documents with the same set are one class from here on, represented by the smallest id.
* Registers are cut into ``BANDS`` bands of ``ROWS``; classes that share a band meet in a
  bucket. At similarity 0.8 a pair shares no bucket with probability
  (1 - 0.8**7)**50 < 1e-5.
* *Stars.* Each member of a bucket is tied to the bucket's smallest id. Ties are estimated
  from registers and set sizes jointly by maximum likelihood; those not more than ``MARGIN``
  below the threshold are likely. Of its likely ties each class has the best one verified
  on the full sets. So one comparison a class joins most near-copies under one tag.
* *The rest.* Only buckets whose members still have different tags hold pairs that could
  join anything more. Members of such buckets form candidate clusters by the same ties. In
  a cluster, pairs of different tags are estimated, which splits clusters that only
  chance or shared passages held together, and then verified by matrix products; only a
  spanning forest of the links leaves a task.

A star is cut into parts of bounded size, each with a copy of its centre. A cluster of more
than ``BLOCK`` classes is dealt into blocks; a tag of more than ``BLOCK`` members has
blocks of its own, which are never compared with each other. Each other pair of blocks is a
task of its own. So no task holds more than two blocks, no pair that could matter is skipped,
a large group of near-copies costs its members, not their pairs, and hot groups of equal
documents cost one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.arrow_slices import slices, small_batches
from wordmill.llm.bitmap import bitmap, likely_rows, may_hold
from wordmill.llm.components import components
from wordmill.llm.durable import durable
from wordmill.llm.names import column, unused
from wordmill.llm.shipping import ship
from wordmill.llm.wordhash import Words, mixed, runs

ROWS, BANDS = 7, 50
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base of the spacing, rate of the exponentials, largest register.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Six standard deviations of the estimate at the threshold.
MARGIN = 6 * (0.16 / REGISTERS) ** 0.5
BLOCK = 256
#: What one call judges of stars: shingles (and ``_TIE`` for each tie) in all, and at most in one part.
STAR_LOAD, STAR_PART = 500_000, 250_000
_TIE = 64
_PIECE = 512
#: Bytes of text that are hashed at once.
SLICE = 3_000_000

_MULTIPLIERS = (mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND_BASE = mixed(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A-Z become lower case. A text of fewer than ``size`` words has its whole word sequence as
    one shingle; a text without words has the empty set.
    """
    words = Words(texts, lower=True)
    hashes = words.hashes()
    shingles = runs(hashes, size)
    for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if e - s >= size:
            yield np.unique(shingles[s : e - size + 1])
        elif e > s:
            yield runs(hashes[s:e], e - s)
        else:
            yield np.zeros(0, dtype=np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """For each register the smallest of the set's hashes, 32 bits."""
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    v = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(v), _PIECE):
        np.minimum(low, (_MULTIPLIERS[:, None] * v[None, at : at + _PIECE]).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Minima of uniform hashes → exponentially spaced, truncated registers."""
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + LARGEST // 2, 0, LARGEST).astype("<u2")


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(n, REGISTERS) → (n, BANDS) signed 64-bit bucket names."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _BAND_BASE).sum(axis=2, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def joint_estimate(n1: np.ndarray, n2: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, given set sizes and how many registers of the first
    lie above and below those of the second (in the limit of a base close to 1)."""
    u = n1 / (n1 + n2)
    v = 1 - u
    same = REGISTERS - above - below
    x, y = u * u * (same + below), v * v * (same + above)
    root = np.sqrt((x - y) ** 2 + 4.0 * below * above * u * u * v * v)
    return np.clip((x + y - root) / (2 * REGISTERS * u * v), 0.0, 1.0)


SKETCHED = "id long, n long, sig1 long, sig2 long, sketch binary"


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, set size, 128-bit signature of the set, registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            ns, s1, s2, low = [], [], [], []
            for found in shingle_sets(b.column("text"), size):
                ns.append(len(found))
                s1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                low.append(minima(found))
            sketch = registers(np.stack(low))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([k.tobytes() for k in sketch], pa.binary())], names=["id", "n", "sig1", "sig2", "sketch"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, SKETCHED)


def _buckets(classes: DataFrame, likely: Broadcast | None = None) -> DataFrame:
    """(rep, key) of all buckets, or without most of those that the bitmap does not have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype="<u2").reshape(b.num_rows, REGISTERS)).reshape(-1)
                reps = np.repeat(b.column("rep").to_numpy(), BANDS)
                if likely is not None:
                    take = may_hold(likely.value, keys)
                    reps, keys = reps[take], keys[take]
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(keys)], names=["rep", "key"])

    return classes.select("rep", "sketch").mapInArrow(run, "rep long, key long")


def _forest(linked: np.ndarray) -> np.ndarray:
    """Adjacency → for each vertex the smallest one reachable."""
    label = np.arange(len(linked))
    far = np.where(linked, label[None, :], len(linked))
    while True:
        new = np.minimum(label, far.min(axis=1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
        far = np.where(linked, label[None, :], len(linked))


def _estimated(limit: float) -> Callable[[np.ndarray, list[bytes]], np.ndarray]:
    def linked(n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        k = np.frombuffer(b"".join(sketches), dtype="<u2").reshape(len(n), REGISTERS)
        out = np.zeros((len(n), len(n)), dtype=bool)
        for i in range(len(n) - 1):
            rest = k[i + 1 :]
            above, below = (k[i] > rest).sum(axis=1), (k[i] < rest).sum(axis=1)
            out[i, i + 1 :] = joint_estimate(float(n[i]), n[i + 1 :].astype(float), above, below) >= limit
        return out | out.T

    return linked


def _verified(percent: int) -> Callable[[np.ndarray, list[bytes]], np.ndarray]:
    def linked(n: np.ndarray, sets: list[bytes]) -> np.ndarray:
        values = np.frombuffer(b"".join(sets), dtype="<u8")
        owner = np.repeat(np.arange(len(n)), [len(s) // 8 for s in sets])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        often = np.bincount(group) > 1 if len(group) else np.zeros(0, bool)
        take = often[group] if len(group) else often
        group, owner = (np.cumsum(often) - 1)[group[take]] if len(group) else group, owner[take]
        common = np.zeros((len(n), len(n)), dtype=np.float64)
        columns = int(often.sum())
        for at in range(0, columns, 4096):
            here = slice(*np.searchsorted(group, [at, at + 4096]))
            m = np.zeros((len(n), min(4096, columns - at)), dtype=np.float32)
            m[owner[here], group[here] - at] = 1
            common += m @ m.T
        union = n[:, None] + n[None, :] - common
        return 100 * common >= percent * union

    return linked


def star_links(ties: DataFrame, payloads: DataFrame, judge: Callable[[pa.Table, np.ndarray], np.ndarray]) -> DataFrame:
    """ties (a, b, load) and payloads (rep, n, payload) → (a, b, score) of ties with a score.

    ``judge`` gets rows and, for each, the place of its star's centre ``b``; it returns scores,
    NaN for none. A star is cut into parts, and parts are packed, by the loads of their ties.
    """
    packs = max(1, -(-(ties.agg(F.sum("load")).first()[0] or 0) // STAR_LOAD))
    parts = ties.groupBy("b").agg(F.ceil(F.sum("load") / STAR_PART).cast("int").alias("parts"))
    dealt = ties.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    names = [F.pmod(F.xxhash64("b", "part"), F.lit(packs)).cast("int").alias("pack"), "b", "part", "rep", "n", "payload"]
    members = dealt.join(payloads, F.col("a") == F.col("rep")).select(*names)
    centres = dealt.select("b", "part").distinct().join(payloads, F.col("b") == F.col("rep")).select(*names)

    def run(table: pa.Table) -> pa.Table:
        rep, b, part = (table.column(c).to_numpy() for c in ("rep", "b", "part"))
        order = np.lexsort((table.column("n").to_numpy(), rep != b, part, b))
        table, rep, b, part = table.take(pa.array(order)), rep[order], b[order], part[order]
        fresh = np.concatenate([[True], (b[1:] != b[:-1]) | (part[1:] != part[:-1])])
        score = judge(table, np.flatnonzero(fresh)[np.cumsum(fresh) - 1])
        good = ~np.isnan(score) & ~fresh
        return pa.table({"a": rep[good], "b": b[good], "score": score[good]})

    return members.union(centres).groupBy("pack").applyInArrow(run, "a long, b long, score double")


def _star_estimates(limit: float) -> Callable[[pa.Table, np.ndarray], np.ndarray]:
    def judge(table: pa.Table, centre: np.ndarray) -> np.ndarray:
        k = np.frombuffer(b"".join(table.column("payload").to_pylist()), dtype="<u2").reshape(table.num_rows, REGISTERS)
        n = table.column("n").to_numpy().astype(float)
        found = joint_estimate(n, n[centre], (k > k[centre]).sum(axis=1), (k < k[centre]).sum(axis=1))
        return np.where(found >= limit, found, np.nan)

    return judge


def _star_verified(size: int, percent: int) -> Callable[[pa.Table, np.ndarray], np.ndarray]:
    def judge(table: pa.Table, centre: np.ndarray) -> np.ndarray:
        out, of = np.full(table.num_rows, np.nan), np.zeros(0, np.uint64)
        at = 0
        for batch in slices(table.select(["payload"]).to_batches(), "payload", SLICE):
            for found in shingle_sets(batch.column("payload"), size):
                if centre[at] == at:
                    of = found
                else:
                    common = int((of[np.minimum(np.searchsorted(of, found), len(of) - 1)] == found).sum())
                    union = len(of) + len(found) - common
                    if 100 * common >= percent * union:
                        out[at] = common / union
                at += 1
        return out

    return judge


def within_clusters(members: DataFrame, payload: str, linked: Callable[[np.ndarray, list[bytes]], np.ndarray], label: str) -> DataFrame:
    """members (rep, cluster, tag, n, payload) → links (a, b) that span those in clusters.

    Members of equal ``tag`` are known to belong together. Clusters of at most ``BLOCK`` are one
    task's group each. Larger ones have blocks: tags of more than ``BLOCK`` members their own,
    all other tags common ones; every pair of blocks is a group but for those of one tag.
    """
    members = members.select("rep", "cluster", "tag", "n", F.col(payload).alias("payload"))
    sizes = members.groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("k"))
    own = F.when(F.col("k") > BLOCK, F.col("tag")).alias("own")
    kinds = sizes.select("cluster", own, "k").groupBy("cluster", "own").agg(F.ceil(F.sum("k") / BLOCK).cast("int").alias("blocks"))
    kinds = durable(kinds, f"{label}-blocks")
    owns = kinds.filter("own IS NOT NULL").select("cluster", F.col("own").alias("tag"), F.col("blocks").alias("own_blocks"))
    common = kinds.filter("own IS NULL").select("cluster", "blocks")
    block = F.struct(F.when(F.col("own_blocks").isNotNull(), F.col("tag")).alias("own"), F.pmod(F.xxhash64("rep"), F.coalesce("own_blocks", "blocks")).cast("int").alias("i"))
    placed = members.join(owns, ["cluster", "tag"], "left").join(common, "cluster", "left").select("rep", "cluster", "n", "payload", block.alias("block"))
    every = kinds.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "own").select("cluster", F.struct("own", "i").alias("block"))
    same = F.col("b1.own").isNotNull() & F.col("b1.own").eqNullSafe(F.col("b2.own"))
    pairs = durable(every.withColumnRenamed("block", "b1").join(every.withColumnRenamed("block", "b2"), "cluster").filter((F.col("b1") <= F.col("b2")) & ~same), f"{label}-pairs")
    sent = pairs.select("cluster", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    key = lambda c: F.xxhash64(F.col("cluster"), F.coalesce(f"{c}.own", F.lit(-1)), F.col(f"{c}.own").isNull(), F.col(f"{c}.i"))
    dealt = placed.withColumn("at", key("block")).join(sent.withColumn("at", key("block")).drop("block"), ["cluster", "at"]).select("rep", "cluster", "n", "payload", "b1", "b2")

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        n = table.column("n").to_numpy()[order]
        payloads = table.column("payload").to_pylist()
        roots = _forest(linked(n, [payloads[i] for i in order]))
        far = roots != np.arange(len(rep))
        return pa.table({"a": rep[far], "b": rep[roots[far]]})

    return durable(dealt.groupBy("cluster", "b1", "b2").applyInArrow(run, "a long, b long"), f"{label}-forest")


def _ties(buckets: DataFrame, heads: DataFrame) -> DataFrame:
    """(rep, head) → at most a tie a row that hold buckets together: a class stays tied to its smallest head, and so do its other heads."""
    tied = buckets.join(heads, "key").filter("rep <> head").groupBy("rep").agg(F.collect_set("head").alias("heads"))
    lowest = tied.withColumn("b", F.array_min("heads")).withColumn("head", F.explode("heads"))
    return lowest.select(F.when(F.col("head") == F.col("b"), F.col("rep")).otherwise(F.col("head")).alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked where 100 * common >= percent * union of their sets of ``shingle``
    consecutive words, A-Z lower-cased. Null, empty and blank texts have the empty set, are
    linked with nothing and are kept. Ids are expected to be unique; rows that repeat an id
    get that id's component each. Null ids are linked with nothing. Other columns are
    ignored. ``percent`` may be 80 or more; lower thresholds would need more bands.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    sketched = durable(sketch_documents(docs, id_col, text_col, shingle), "sketches")
    full = sketched.filter("n > 0 AND id IS NOT NULL")
    same = ["n", "sig1", "sig2"]
    reps = durable(full.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    own = full.select("id", "sketch", *same)
    # The class's smallest id brings its registers; equal sets have equal registers.
    classes = durable(own.join(reps, (own["id"] == reps["rep"]) & (own["n"] == reps["n"]) & (own["sig1"] == reps["sig1"]) & (own["sig2"] == reps["sig2"])).select("rep", own["n"], "sketch"), "class-sketches")

    heads = durable(_buckets(classes).groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "head"), "heads")
    limit = percent / 100 - MARGIN
    # Only buckets of two and more go on, which most classes' buckets are not, and of classes those in them.
    shared = durable(_buckets(classes, bitmap(heads.select("key"))).join(heads, "key"), "shared-buckets")
    met = durable(shared.select("rep").distinct(), "met")
    in_met = bitmap(met)
    sketches = durable(likely_rows(classes, "rep", in_met).join(met, "rep"), "met-sketches")
    texts = likely_rows(docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("payload")), "rep", in_met)
    # Here ``n`` only orders texts that share an id.
    texts = durable(texts.join(met, "rep").select("rep", F.xxhash64("payload").alias("n"), "payload").distinct(), "met-texts")
    ties = durable(shared.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), "ties")
    likely = star_links(ties.withColumn("load", F.lit(2 * _TIE)), sketches.withColumnRenamed("sketch", "payload"), _star_estimates(limit))
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("score", F.negative("b"))).alias("b"))
    best = durable(best.join(sketches.select(F.col("rep").alias("a"), (F.col("n") + _TIE).alias("load")), "a"), "best-ties")
    stars = durable(star_links(best, texts, _star_verified(shingle, percent)).select("a", "b"), "stars")
    tags = components(stars, "tags").withColumnsRenamed({"v": "rep", "component": "tag"})

    # What the stars left: buckets of several tags.
    tagged = shared.join(tags, "rep", "left").select("rep", "key", F.coalesce("tag", "rep").alias("tag"))
    open_heads = durable(tagged.groupBy("key").agg(F.min("rep").alias("head"), F.min("tag").alias("low"), F.max("tag").alias("high")).filter("low <> high").select("key", "head"), "open-heads")
    joined = reps.join(tags, "rep", "left").select(*same, F.coalesce("tag", "rep").alias("component"))
    if open_heads.limit(1).count():
        tag = F.coalesce("tag", "rep").alias("tag")

        def clusters(links: DataFrame, name: str) -> DataFrame:
            found = components(links, name).select(F.col("v").alias("rep"), F.col("component").alias("cluster"))
            return found.join(tags, "rep", "left").select("rep", "cluster", tag)

        candidates = durable(clusters(_ties(shared.drop("head"), open_heads), "candidates"), "candidate-clusters")
        estimated = within_clusters(candidates.join(sketches, "rep"), "sketch", _estimated(limit), "estimated")
        members = durable(clusters(estimated, "likely"), "likely-clusters")

        def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "payload", SLICE):
                found = list(shingle_sets(b.column("payload"), shingle))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("cluster"), b.column("tag"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["rep", "cluster", "tag", "n", "set"])

        with_sets = texts.join(members, "rep").select("rep", "cluster", "tag", "payload").mapInArrow(sets, "rep long, cluster long, tag long, n long, set binary")
        links = within_clusters(with_sets, "set", _verified(percent), "verified")
        ends = members.select("rep", "tag").distinct()
        across = links.join(ends.withColumnsRenamed({"rep": "a", "tag": "ta"}), "a").join(ends.withColumnsRenamed({"rep": "b", "tag": "tb"}), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        further = components(across.filter("a <> b"), "verified").withColumnsRenamed({"v": "tag", "component": "further"})
        joined = joined.withColumnRenamed("component", "tag").join(further, "tag", "left").select(*same, F.coalesce("further", "tag").alias("component"))

    joined = durable(joined, "class-components")
    rows = sketched.join(joined, same, "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``near_duplicates`` keeps: one id of each component.

    Rows that repeat a kept id all stay, as do rows of null, empty or blank text and of null
    id. No rows in, no rows out. All other columns stay as they are, whatever their names.
    """
    (kept_id,) = unused(docs, "kept_id")
    kept = near_duplicates(docs, id_col, text_col, shingle, percent).filter("kept").select(F.col(id_col).alias(kept_id)).distinct()
    return docs.join(kept, column(id_col).cast("long").eqNullSafe(F.col(kept_id)), "left_semi").select(*map(column, docs.columns))
