"""Removing word sequences that occur elsewhere, by relative Lempel-Ziv parsing.

Every group of documents is a reference block, indexed by the fingerprints of its phrases
(runs of ``window`` words). Parsing every document against every block would grow with the
square of the corpus, so fingerprints first tell which block can hold a match at all:

1. *Index.* Documents are dealt into groups by a hash. A group sends the fingerprints of its
   distinct phrases, dealt out by range. Where a range is gathered, each phrase that several
   groups hold is told, in each of them, the group before it.
2. *Seeds.* A group knows by that answer which of its phrases occur elsewhere, maybe. Runs of
   them are its regions, kept as reference text. Of each phrase, the first occurrence in the
   group goes on: runs of such phrases with the same group before them are sent there, as text.
3. *Parse.* The receiving block factors what it was sent, and its own regions, greedily against
   its regions: a factor begins at a place that the fingerprint index names and goes on as
   long as words are equal (the words themselves are compared). The next factor begins at the
   first phrase that isn't wholly inside the last, so factors overlap by ``window - 1`` words and
   no phrase across a boundary is missed. A factor of ``window`` words and more is a duplicate
   at both of its places.
4. *Collisions.* A phrase whose fingerprint leads to other words is no factor. Such phrases, and
   those they were compared with, are compared with each other as texts; what is found
   nowhere else is put back into its document.

A passage that a third of all documents share is one phrase list per group, and each group
passes it to one other, so there is no hot block. Judging by the input, both copies of a passage go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.arrow_slices import small_batches
from wordmill.llm.durable import durable
from wordmill.llm.names import column
from wordmill.llm.shipping import ship
from wordmill.llm.wordhash import Words, runs

#: Bytes of text that a group aims at: at least the first, at most the last, between them
#: so that a group's message to a range stays around ``MESSAGE`` bytes.
GROUP_BYTES = (6 << 20, 64 << 20)
MESSAGE = 4096
#: Bits of a fingerprint beyond those that number the bytes of the corpus: collisions cost a
#: little work, never a wrong result.
SPARE_BITS = 16


def _phrases(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word places where a phrase starts, its fingerprint of ``size`` bytes); phrases don't leave their document."""
    hashes = words.hashes()
    n = np.maximum(np.diff(words.first) - window + 1, 0)
    begins = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    found = runs(hashes, window)
    return begins, (found[begins] if len(begins) else np.zeros(0, np.uint64)) >> np.uint64(64 - 8 * size)


def _packed(prints: np.ndarray, size: int) -> bytes:
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1)


def _binary(col: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_binary())


def _chains(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of neighbouring places that agree in ``same``."""
    if not len(places):
        return np.zeros(0, int), np.zeros(0, int)
    fresh = np.diff(places) != 1
    for s in same:
        fresh |= s[1:] != s[:-1]
    first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    return first, np.append(first[1:] - 1, len(places) - 1)


def _word_numbers(words: Words) -> np.ndarray:
    """Equal words, and no others, have equal numbers."""
    lengths = words.ends - words.starts
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    data = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode().indices.to_numpy()


def factor(numbers: np.ndarray, ends: np.ndarray, places: np.ndarray, seeds: np.ndarray, window: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Greedy factors (place, reference place, words), and (place, seed) pairs whose words differ.

    ``numbers`` are words of texts one after another, ``ends`` the end of each word's text,
    ``places`` (rising) where phrases start and ``seeds`` where the index has them.
    """
    found, wrong, i = [], [], 0
    while i < len(places):
        w, p = int(places[i]), int(seeds[i])
        most, n, step = int(min(ends[w] - w, ends[p] - p)), 0, 2 * window
        while n < most:
            to = min(n + step, most)
            equal = numbers[w + n : w + to] == numbers[p + n : p + to]
            if not equal.all():
                n += int(equal.argmin())
                break
            n, step = to, 2 * step
        if n >= window:
            found.append((w, p, n))
            i = int(np.searchsorted(places, w + n - window + 1))
        else:
            wrong.append((w, p))
            i += 1
    return found, wrong


def duplicate_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", fingerprint_bytes: int | None = None) -> DataFrame:
    """One row per input row: id, n_words, spans array<struct<start,end>>, n_removed, kept_text.

    ``spans`` are the word ranges (end exclusive) covered by a run of ``window`` words
    that also starts anywhere else, in this or another document; ``kept_text`` has the other
    words joined by one space. Words are compared unchanged.

    Null text counts as empty: no words, no spans, empty ``kept_text``. Texts of fewer than
    ``window`` words are left alone. Rows that repeat a text lose all of it if it is
    long enough. Null and repeated ids are rows like any other. Other columns are ignored.
    No rows in, no rows out. ``fingerprint_bytes`` (1 to 8) follows from the corpus' size if not given.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).select("id", "text", F.xxhash64("id", "text").alias("h"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    aim = min(max(GROUP_BYTES[0], int((total * MESSAGE) ** 0.5)), GROUP_BYTES[1])
    groups = max(-(-total // aim), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    size = fingerprint_bytes or min(8, -(-(math.ceil(math.log2(total + 2)) + SPARE_BITS) // 8))
    bits = min(max(1, (groups - 1).bit_length()), 8 * size)
    grouped = rows.withColumn("grp", F.pmod("h", F.lit(groups)).cast("int")).repartition(groups, "grp")

    def index(table: pa.Table) -> pa.Table:
        distinct = np.unique(_phrases(Words(_binary(table.column("text"))), window, size)[1])
        block = (distinct >> np.uint64(8 * size - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        return pa.table({
            "block": pa.array(block[starts], pa.int32()),
            "grp": pa.array(np.full(len(starts), table.column("grp")[0].as_py()), pa.int32()),
            "phrases": pa.array([_packed(p, size) for p in np.split(distinct, starts[1:])] if len(starts) else [], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        sent = table.column("phrases").to_pylist()
        prints, counts = _unpacked(b"".join(sent), size), np.array([len(x) // size for x in sent])
        holder = np.repeat(table.column("grp").to_numpy().astype(np.int32), counts)
        order = np.lexsort((holder, prints))
        same = prints[order[1:]] == prints[order[:-1]]
        before = np.full(len(prints), -1, dtype="<i4")
        before[order[1:][same]] = holder[order[:-1][same]]
        shared = before >= 0
        shared[order[:-1][same]] = True
        cuts = np.cumsum(counts)[:-1]
        return pa.table({
            "grp": table.column("grp"), "block": table.column("block"), "n": pa.array(counts, pa.int32()),
            "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary()),
            "before": pa.array([b[x].tobytes() for b, x in zip(np.split(before, cuts), np.split(shared, cuts))], pa.binary()),
        })

    def seed(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _rows(None, [], [], [])
        left = left.sort_by([("h", "ascending"), ("id", "ascending")])
        words = Words(_binary(left.column("text")))
        begins, prints = _phrases(words, window, size)
        distinct, first, place, count = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        by_block = np.argsort(right.column("block").to_numpy())
        shared, before = np.zeros(len(distinct), dtype=bool), np.full(len(distinct), -1, dtype=np.int32)
        if len(by_block):
            bits_of, n_of, before_of = right.column("bits").to_pylist(), right.column("n").to_numpy(), right.column("before").to_pylist()
            shared[:] = np.concatenate([np.unpackbits(np.frombuffer(bits_of[i], np.uint8), count=n_of[i]) for i in by_block]).astype(bool)
            before[shared] = np.frombuffer(b"".join(before_of[i] for i in by_block), "<i4")
        flagged = (shared | (count > 1))[place]
        grp, found = left.column("grp")[0].as_py(), begins[flagged]
        owner = np.searchsorted(words.first, found, "right") - 1
        at, to = _chains(found, owner)
        regions = [(grp, int(a), int(b), int(o)) for a, b, o in zip(found[at], found[to], owner[at])]
        going = np.zeros(len(begins), dtype=bool)
        going[first] = before >= 0
        sent, whither = begins[going], before[place[going]]
        at, to = _chains(sent, whither, np.searchsorted(words.first, sent, "right"))
        asks = [(int(g), int(a), int(b)) for g, a, b in zip(whither[at], sent[at], sent[to])]
        return _rows(left, regions, asks, [words, found, window])

    def parse(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        source, start = table.column("src").to_numpy(), table.column("start").to_numpy()
        words = Words(_binary(table.column("region")))
        begins, prints = _phrases(words, window, size)
        row = np.searchsorted(words.first, begins, "right") - 1
        # In an own region, an earlier place in the group comes first.
        mine = np.flatnonzero(own[row])
        place = start[row] + begins - words.first[row]
        mine = mine[np.argsort(place[mine], kind="stable")]
        known, first = np.unique(prints[mine], return_index=True)
        at = np.minimum(np.searchsorted(known, prints), max(len(known) - 1, 0))
        has = known[at] == prints if len(known) else np.zeros(len(prints), bool)
        seeds = np.where(has, begins[mine[first[at]]], -1) if len(known) else np.full(len(prints), -1)
        has &= seeds != begins
        ends = np.repeat(words.first[1:], np.diff(words.first))
        found, wrong = factor(_word_numbers(words), ends, begins[has], seeds[has], window)
        here = table.column("at")[0].as_py()
        name = lambda w: (lambda r: (int(source[r]), int(start[r] + w - words.first[r])))(int(np.searchsorted(words.first, w, "right") - 1))
        text = lambda w: b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[w : w + window], words.ends[w : w + window]))
        out = [(*name(w), here, name(p)[1], n, None) for w, p, n in found] + [(*name(x), None, None, None, text(x)) for w, p in wrong for x in (w, p)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["src", "start", "at", "ref", "n", "phrase"])

    kind = rows.schema["id"].dataType.simpleString()
    entries = grouped.groupBy("grp").applyInArrow(index, "block int, grp int, phrases binary")
    answers = entries.groupBy("block").applyInArrow(answer, "grp int, block int, n int, bits binary, before binary")
    seeded = durable(grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(seed, f"id {kind}, h long, {_FOUND}, own boolean, at int, src int, start long, last long, base long, region binary"), "phrases")
    factors = durable(seeded.filter("own IS NOT NULL").select("own", "at", "src", "start", "region").groupBy("at").applyInArrow(parse, "src int, start long, at int, ref long, n long, phrase binary"), "factors")
    found = seeded.filter("own IS NULL").select("id", "h", "n_words", "spans", "n_removed", "kept_text")
    if factors.filter("phrase IS NOT NULL").limit(1).count():
        found = _without_collisions(rows, found, seeded, factors, window)
    return found.drop("h").withColumnRenamed("id", id_col)


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, n_removed long, kept_text string"


def _without_collisions(rows: DataFrame, found: DataFrame, seeded: DataFrame, factors: DataFrame, window: int) -> DataFrame:
    """``found`` with phrases put back that only share their fingerprint with another."""
    kind = rows.schema["id"].dataType.simpleString()
    wrong = factors.filter("phrase IS NOT NULL").select("src", "start", "phrase").distinct()
    twice = wrong.groupBy("phrase").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("phrase")
    alone = durable(wrong.join(twice, "phrase", "left_anti").select("src", "start"), "lone-phrases")
    groups = durable(alone.select("src").distinct(), "lone-groups")
    good = factors.filter("phrase IS NULL")
    places = good.select("src", "start", "n").union(good.select(F.col("at").alias("src"), F.col("ref").alias("start"), "n"))
    regions = seeded.filter("own").select("src", "start", "last", "base", "id", "h")
    empty = lambda t: F.lit(None).cast(t)
    both = (
        alone.select("src", "start", F.lit(0).alias("what"), empty("long").alias("last"), empty("long").alias("base"), empty(kind).alias("id"), empty("long").alias("h"))
        .union(places.select("src", "start", F.lit(1), F.col("start") + F.col("n") - window, empty("long"), empty(kind), empty("long")).join(groups, "src", "left_semi"))
        .union(regions.select("src", "start", F.lit(2), "last", "base", "id", "h").join(groups, "src", "left_semi"))
    )

    def check(table: pa.Table) -> pa.Table:
        what, start = table.column("what").to_numpy(), table.column("start").to_numpy()
        last = table.column("last").fill_null(-1).to_numpy()
        top = int(max(start.max(), last.max())) + 2
        covered = np.zeros(top + 1, dtype=np.int32)
        np.add.at(covered, start[what == 1], 1)
        np.add.at(covered, last[what == 1] + 1, -1)
        lone = start[what == 0]
        lone = np.unique(lone[np.cumsum(covered)[lone] == 0])
        out: dict[tuple, list[int]] = {}
        touched = set()
        at = np.flatnonzero(what == 2)
        for i, (id_, h, base) in zip(at, zip(*(table.column(c).take(at).to_pylist() for c in ("id", "h", "base")))):
            inside = lone[(lone >= start[i]) & (lone <= last[i])]
            key = (id_, h, base)
            if len(inside):
                touched.add(key)
            out.setdefault(key, []).extend((np.setdiff1d(np.arange(start[i], last[i] + 1), inside) - base).tolist())
        keys = [k for k in out if k in touched]
        return pa.table({"id": pa.array([k[0] for k in keys], table.schema.field("id").type), "h": pa.array([k[1] for k in keys], pa.int64()), "still": pa.array([sorted(out[k]) for k in keys], pa.list_(pa.int32()))})

    changed = durable(both.groupBy("src").applyInArrow(check, f"id {kind}, h long, still array<int>"), "changed-documents")

    def again(batches):
        for b in batches:
            words = Words(b.column("text"))
            still = b.column("still").to_pylist()
            places = np.array([p + f for f, s in zip(words.first[:-1].tolist(), still) for p in s], dtype=np.int64)
            yield from _documents(b.column("id"), b.column("h"), words, places, window).to_batches()

    same = found["h"].eqNullSafe(changed["h"]) & found["id"].eqNullSafe(changed["id"])
    mine = rows["h"].eqNullSafe(changed["h"]) & rows["id"].eqNullSafe(changed["id"])
    put_back = rows.join(changed, mine).select(rows["id"], rows["h"], "text", "still").mapInArrow(again, f"id {kind}, h long, {_FOUND}")
    return found.join(changed, same, "left_anti").unionByName(put_back)


def _cut_out(words: Words, found: np.ndarray, window: int) -> tuple[np.ndarray, list, np.ndarray, tuple[bytes, np.ndarray]]:
    """Places where a known phrase starts → (words per text, spans per text, removed per text, kept text).

    A place at most ``window`` words after the last one touches or overlaps its phrase and
    continues the span.
    """
    n = len(words.starts)
    first = words.first
    owner = np.searchsorted(first, found, "right") - 1
    fresh = np.concatenate([[True], (np.diff(found) > window) | (np.diff(owner) > 0)]) if len(found) else np.zeros(0, bool)
    begin = found[fresh]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(found) - 1) if len(found) else np.zeros(0, int)
    end = found[last] + window if len(found) else begin
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    counts = np.diff(first)
    up_to = np.concatenate([[0], np.cumsum(kept)])
    removed = counts - (up_to[first[1:]] - up_to[first[:-1]])
    of = owner[fresh]
    cut = np.searchsorted(of, np.arange(len(counts) + 1))
    base = first[of] if len(of) else of
    spans = (cut, (begin - base).astype(np.int32), (end - base).astype(np.int32))

    # Bytes of kept words, and the white space after each but a text's last as one space.
    size = len(words.data)
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    which = np.flatnonzero(kept)
    text_of = np.searchsorted(first, which, "right") - 1
    followed = which[:-1][text_of[1:] == text_of[:-1]] if len(which) else which
    gaps = words.ends[followed]
    data = words.data.copy()
    data[gaps] = 0x20
    take[gaps] = True
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(take, dtype=np.int64)])[words.bounds] if size else np.zeros(len(words.bounds), np.int64)
    return counts, spans, removed, (data[take].tobytes(), bounds)


def _documents(ids, h, words: Words, found: np.ndarray, window: int) -> pa.Table:
    """Documents without the words of the phrases that start at ``found``."""
    counts, (cut, begin, end), removed, (raw, bounds) = _cut_out(words, found, window)
    inner = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
    n = len(bounds) - 1
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())
    return pa.table({
        "id": ids, "h": h, "n_words": pa.array(counts[:n].astype(np.int64)), "spans": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), inner),
        "n_removed": pa.array(removed[:n].astype(np.int64)), "kept_text": text,
    })


_REGIONS = {"own": pa.bool_(), "at": pa.int32(), "src": pa.int32(), "start": pa.int64(), "last": pa.int64(), "base": pa.int64(), "region": pa.binary()}


def _rows(left: pa.Table | None, regions: list[tuple], asks: list[tuple], rest: list) -> pa.Table:
    """Documents, then own regions, then what is sent to other groups, as one table."""
    if left is None:
        none = pa.table({"id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        for name, kind in _REGIONS.items():
            none = none.append_column(name, pa.array([], kind))
        return none
    words, found, window = rest
    grp = left.column("grp")[0].as_py()
    documents = _documents(left.column("id"), left.column("h"), words, found, window)
    for name, kind in _REGIONS.items():
        documents = documents.append_column(name, pa.nulls(documents.num_rows, kind))
    text = lambda a, b: words.data[words.starts[a] : words.ends[b + window - 1]].tobytes()
    ids, h = left.column("id"), left.column("h")
    which = pa.array([o for *_, o in regions] + [None] * len(asks), pa.int64())
    more = {
        "id": ids.take(which), "h": h.take(which), "own": [True] * len(regions) + [False] * len(asks), "at": [g for g, *_ in regions] + [g for g, *_ in asks],
        "src": [grp] * (len(regions) + len(asks)), "start": [r[1] for r in regions] + [a[1] for a in asks], "last": [r[2] for r in regions] + [a[2] for a in asks],
        "base": [int(words.first[r[3]]) for r in regions] + [None] * len(asks), "region": [text(r[1], r[2]) for r in regions] + [text(a[1], a[2]) for a in asks],
    }
    n = len(regions) + len(asks)
    extra = pa.table({f.name: (more[f.name] if isinstance(more.get(f.name), (pa.Array, pa.ChunkedArray)) else pa.array(more[f.name], f.type)) if f.name in more else pa.nulls(n, f.type) for f in documents.schema})
    return pa.concat_tables([documents, extra])
