"""Near-duplicates of texts and vectors, and substring dedup, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SF

from wordmill.llm import bitmap, embedding_dedup, queries, setsketch_dedup, substring_dedup
from wordmill.llm.components import components
from wordmill.llm.wordhash import Words, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(rows, k, percent=80):
    ids = sorted(i for i, _ in rows if i is not None)
    sets = [shingles(dict(rows)[i], k) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), ids[c]) for i, s, c in zip(ids, sets, joined(len(ids), links))}


def family(r, base, n, rate):
    for _ in range(n):
        yield " ".join(w if r.random() > rate else f"n{r.randint(0, 10**6)}" for w in base)


def near_rows(seed=1, copies=40):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "A b\tC", "a b c d", "é É", "x " * 5000, "x " * 4999]
    for size in (12, 60, 300):
        base = [f"w{r.randint(0, 400)}" for _ in range(size)]
        texts += [" ".join(base)] * 3 + list(family(r, base, copies, 0.01)) + list(family(r, base, copies, 0.04))
    return [(i * 3, t) for i, t in enumerate(r.sample(texts, len(texts)))]


def check_near(frame, rows, k):
    got = {r.doc_id: r for r in setsketch_dedup.near_duplicates(frame, shingle=k).collect()}
    want = brute_near(rows, k)
    assert {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs_of, k):
    rows = near_rows()
    check_near(docs_of(rows), rows, k)


def test_clusters_larger_than_a_block(docs_of, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "BLOCK", 16)
    rows = near_rows(seed=2, copies=30)
    check_near(docs_of(rows), rows, 5)


def test_stars_of_many_parts_and_pure_blocks(docs_of, monkeypatch):
    for name, value in (("BLOCK", 8), ("STAR_PART", 2000), ("STAR_LOAD", 4000)):
        monkeypatch.setattr(setsketch_dedup, name, value)
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    # near the threshold: many copies are linked with the base but not with each other
    texts = [" ".join(base), *family(r, base, 60, 0.022), *family(r, base, 30, 0.005), *family(r, base, 20, 0.06)]
    rows = list(enumerate(r.sample(texts, len(texts))))
    check_near(docs_of(rows), rows, 5)


def test_blocks_of_one_tag_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "BLOCK", 4)
    rows = [(i, 0, 0 if i < 20 else i, 1, bytes([i])) for i in range(23)] + [(100 + i, 1, 1, 1, b"x") for i in range(9)] + [(200 + i, 2, 200 + i, 1, b"y") for i in range(3)]
    members = spark.createDataFrame(rows, "rep long, cluster long, tag long, n long, payload binary")

    def linked(n, payloads):
        return np.ones((len(n), len(n)), dtype=bool)

    got = {(r.a, r.b) for r in setsketch_dedup.within_clusters(members, "payload", linked, "test").collect()}
    assert all(b < a for a, b in got) and {a for a, b in got if a < 100} >= {20, 21, 22}
    assert not [a for a, b in got if 100 <= a < 200]
    assert {a for a, b in got if a >= 200} == {201, 202}
    assert set(joined(23, [(a, b) for a, b in got if a < 23])) == {0}


def test_rows_that_repeat_an_id_with_other_texts(docs_of):
    base = [f"w{i}" for i in range(80)]
    near = " ".join([*base[:79], "x"])
    rows = [(1, " ".join(base)), (1, " ".join(f"v{i}" for i in range(80))), (2, near), (3, " ".join([*(f"v{i}" for i in range(79)), "y"])), (4, "z z z z z z z")]
    got = {(r.doc_id, r.component_id) for r in setsketch_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_near_duplicates_of_odd_tables(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, None), (4, "a b c d e f")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch_dedup.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False)], key=str)
    assert setsketch_dedup.near_duplicates(docs_of(rows).limit(0)).count() == 0
    docs = docs_of(rows)
    kept = setsketch_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None}
    with pytest.raises(ValueError):
        setsketch_dedup.near_duplicates(docs, percent=50)


def test_slices_of_short_texts_only(docs_of, monkeypatch):
    from wordmill.llm import wordhash

    monkeypatch.setattr(wordhash, "_tables", {})
    assert [len(x) for x in setsketch_dedup.shingle_sets(wordhash.pa.array(["zz yy", None, "", "a"]), 4)] == [1, 0, 0, 1]
    rows = [(1, "a b c d e f g h i j"), (2, "zz yy"), (3, "Zz\tyy"), (4, "q"), (5, None), (6, " ")]
    check_near(docs_of(rows).repartition(6), rows, 4)


def test_op8_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_near(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_minhash"](spark, SF).collect()} == want


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_without_a_partner_are_not_shuffled(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    words = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(4000)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(300)]
    texts[200] = texts[7] + " more"
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    # as on tables too large to broadcast
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        at = shuffled(spark)
        check_near(docs, rows, 4)
        few = shuffled(spark) - at
        monkeypatch.setattr(bitmap, "MOST_BITS", 0)
        check_near(docs, rows, 4)
        every = shuffled(spark) - at - few
    finally:
        spark.conf.set(name, before)
    # Either way the result is whole; without bitmaps all texts, registers and bucket names go to the joins.
    assert few < 1_500_000 < 3_000_000 < every


def test_bitmaps_lose_no_row(spark, monkeypatch):
    keys = [*range(-500, 500), -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    rows = spark.createDataFrame([(k,) for k in [*keys, *range(10_000, 30_000), None]], "rep long")
    got = [x.rep for x in bitmap.likely_rows(rows, "rep", bitmap.bitmap(frame)).collect()]
    assert set(keys) <= set(got) and None not in got and len(got) < len(keys) + 2500
    monkeypatch.setattr(bitmap, "MOST_BITS", 1024)
    got = [x.rep for x in bitmap.likely_rows(rows, "rep", bitmap.bitmap(frame)).collect()]
    assert set(keys) <= set(got)
    monkeypatch.setattr(bitmap, "MOST_BITS", 1000)
    assert bitmap.bitmap(frame) is None and bitmap.likely_rows(rows, "rep", None).count() == rows.count()
    monkeypatch.undo()
    assert bitmap.likely_rows(rows, "rep", bitmap.bitmap(frame.limit(0))).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 900).astype(np.uint64), r.integers(0, 2**63, 300).astype(np.uint64)
    both = np.unique(np.concatenate([a, b]))
    ka, kb, kab = (setsketch_dedup.registers(setsketch_dedup.minima(x)) for x in (a, b, both))
    assert (np.maximum(ka, kb) == kab).all()
    for share in (0.3, 0.6, 0.8, 0.95):
        gaps = []
        for _ in range(20):
            v = r.integers(0, 2**63, 1000).astype(np.uint64)
            n = int(1000 * 2 * share / (1 + share))
            x, y = v, np.concatenate([v[:n], r.integers(0, 2**63, 1000 - n).astype(np.uint64)])
            kx, ky = (setsketch_dedup.registers(setsketch_dedup.minima(z)).astype(int) for z in (x, y))
            gaps.append(setsketch_dedup.joint_estimate(1000.0, np.array(1000.0), (kx > ky).sum(), (kx < ky).sum()) - n / (2000 - n))
        assert abs(np.mean(gaps)) < 0.02 and max(map(abs, gaps)) < setsketch_dedup.MARGIN


def brute_spans(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[j : j + window]) for w in words for j in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        yield len(w), gone, " ".join(x for x, g in zip(w, gone) if not g)


def check_spans(frame, rows, window, **more):
    got = substring_dedup.duplicate_spans(frame, window, **more).collect()
    want = Counter((i, n, tuple(gone), kept) for (i, _), (n, gone, kept) in zip(rows, brute_spans([t for _, t in rows], window)))
    seen = Counter()
    for r in got:
        gone = [False] * r.n_words
        for s in r.spans:
            gone[s.start : s.end] = [True] * (s.end - s.start)
        assert sum(gone) == r.n_removed
        seen[(r.doc_id, r.n_words, tuple(gone), r.kept_text)] += 1
    assert seen == want


@pytest.mark.parametrize("window", [1, 3, 8])
def test_duplicate_spans(docs_of, window):
    r = random.Random(window)
    texts = [None, "", " \n ", "a", "a a a a a a a a a a a a", "same words here", "same words here", " lead\r\n\x0bmid\x0c\ttail ", "é è  é è é è", "z " * 3000]
    texts += [r.choice(["  ", ""]).join([" ".join(r.choice("abcd") for _ in range(r.randint(1, 30))), " "]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same words here"), (1, "twice")]
    check_spans(docs_of(rows), rows, window)


def test_passages_shared_by_documents(docs_of):
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"u{i}.{j}" for j in range(r.randint(0, 50))]
        at, a, b = r.randint(0, len(own)), r.randint(0, 20), r.randint(40, 60)
        rows.append((i, " ".join(own[:at] + passage[a:b] + own[at:])))
    check_spans(docs_of(rows), rows, 35)


@pytest.mark.parametrize("window", [3, 8])
def test_colliding_fingerprints(docs_of, window):
    r = random.Random(50 + window)
    base = [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(40)]
    texts = [" ".join([f"u{i}.{j}" for j in range(r.randint(0, 30))] + base[(a := r.randint(0, 30)) : a + r.randint(1, 25)] + [r.choice("xyz") for _ in range(r.randint(0, 9))]) for i in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, *texts[:5]])]
    check_spans(docs_of(rows), rows, window, fingerprint_bytes=1)


def test_factors_are_greedy_and_true():
    numbers = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 7, 8, 1, 2, 9, 4])
    ends = np.array([6] * 6 + [16] * 10)
    found, wrong = substring_dedup.factor(numbers, ends, np.array([6, 7, 8, 12]), np.array([0, 1, 2, 0]), 2)
    assert found == [(6, 0, 4), (12, 0, 2)] and wrong == []
    found, wrong = substring_dedup.factor(numbers, ends, np.array([6, 12]), np.array([0, 0]), 3)
    assert found == [(6, 0, 4)] and wrong == [(12, 0)]


def test_spans_of_nothing_and_bad_windows(docs_of):
    assert substring_dedup.duplicate_spans(docs_of([(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.duplicate_spans(docs_of([(1, "a")]), 0)


def test_op7_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, sum(g), hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(rows, brute_spans([t for _, t in rows], 35))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op7_substring_dedup"](spark, SF).collect()} == want


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from wordmill.llm import wordhash

    texts = pa.array(["ab", "c ab", None, "", " ab  c\t", "é" * 50])
    whole = Words(texts).hashes()
    monkeypatch.setattr(wordhash, "_BYTES", 3)
    assert (Words(texts).hashes() == whole).all() and (runs(whole, 2) == wordhash.runs(whole, 2)).all()
    assert whole[0] == whole[2] == whole[3] and whole[1] == whole[4] and len(whole) == 6


@pytest.mark.parametrize("links, want", [([], {}), ([(1, 1)], {1: 1}), ([(i, i + 1) for i in range(50)], {i: 0 for i in range(51)}), ([(5, 9), (9, 5), (7, 9), (2, 3), (None, 3)], {5: 5, 9: 5, 7: 5, 2: 2, 3: 2})])
def test_components(spark, links, want):
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.v: r.component for r in got.collect()} == want


def brute_vectors(rows, threshold):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    scaled = [v / np.abs(v).max() for _, v, _ in ok]
    unit = [v / np.linalg.norm(v) for v in scaled]
    links = [(a, b) for a in range(len(ok)) for b in range(a) if ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    order = sorted(range(len(ok)), key=lambda x: ok[x][0])
    rank = {x: k for k, x in enumerate(order)}
    comp = joined(len(ok), [(rank[a], rank[b]) for a, b in links])
    n = Counter(x for link in links for x in link)
    out = {ok[x][0]: (n[x], ok[order[comp[rank[x]]]][0]) for x in range(len(ok))}
    return out | {i: (0, i) for i, _, _ in rows if i not in out}


def vector_rows(seed=0):
    r = np.random.default_rng(seed)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 64, 1), (3, [float("nan")] * 64, 1), (4, [1.0] * 63 + [None], 1), (5, [1.0] * 64, None), (6, [1.0] * 64, 1), (7, [2.0] * 64, 1), (8, [1.0] * 64, 2), (9, [1.0] * 32, 1), (None, [1.0] * 64, 1), (10, [1e300] * 64, 1), (11, [float("inf")] * 64, 1), (12, [-1.0] * 64, 1)]
    for label in range(3):
        for c in range(6):
            base = r.normal(size=64)
            for k in range(40 if c == 0 else 12):
                rows.append((100 + len(rows), (base + r.normal(size=64) * r.choice([0.0, 0.05, 0.12, 0.2, 0.27])).tolist(), label))
    return rows


def test_vectors(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, tab string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    want = brute_vectors(rows, 0.93)
    assert set(got) == set(want)
    total, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert total > 2000 and 0.99 * total <= found <= total and all(got[i][0] <= want[i][0] for i in want)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_hot_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rows = vector_rows(1)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    want = {i: n for i, (n, _) in brute_vectors(rows, 0.93).items()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_op5_recall_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute_vectors(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op5_embedding_dedup"](spark, SF).collect()}
    assert set(got) == set(want) and sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_a_hot_cell_of_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PACK_ROWS", 2000)
    r = np.random.default_rng(9)
    base = r.normal(size=32)
    x = base + r.normal(size=(3000, 32)) * 0.05
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert want.min() > 2900 and all(got[i] == (n, 0) for i, n in enumerate(want))


def test_nearest_lattice_points():
    y = np.random.default_rng(3).normal(size=(200, 8)) * 2
    near, other = embedding_dedup.decode_e8(y)
    for p in (near, other):
        assert ((p % 2 == 0).all(axis=1) | (p % 2 != 0).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    gap = lambda p: ((y - p / 2) ** 2).sum(axis=1)
    assert (gap(near) <= gap(other)).all() and gap(near).max() <= 1.0 + 1e-9  # the covering radius of E8 is 1
