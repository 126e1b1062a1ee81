"""Exact dedup and mixing."""

import hashlib
from collections import defaultdict

import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F

from wordmill.llm import exact_dedup, mixing, queries

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "A"), (3, "a"), (None, "a"), (None, "zz"), (8, "x" * 200_000), (9, "x" * 200_000)]


@pytest.mark.parametrize("name", ["op2_mixing", "op3_warc", "op9_exact_dedup"])
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert rows_of(got[sorted(want.columns)]) == rows_of(want)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, docs_of, keep):
    got = exact_dedup.exact_dedup(docs_of(ROWS), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    assert len(got) == len(ROWS)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert set(by_text) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for t, ids in groups.items():
        rows = by_text[hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        best = (min(known) if keep == "smallest" else max(known)) if known else None
        assert sorted((r.doc_id for r in rows), key=str) == sorted(ids, key=str)
        assert {(r.keep_id, r.group_size) for r in rows} == {(best, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [best]  # one row, even where the id repeats


def test_exact_dedup_of_nothing(docs_of):
    assert exact_dedup.exact_dedup(docs_of(ROWS).limit(0)).count() == 0


def test_rows_that_stay_keep_their_columns(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(1, "a"), (2, "b"), (4, None), (6, "a "), (7, "A"), (8, "x" * 200_000)]


def test_clashing_names_and_repeated_ids(docs_of):
    docs = docs_of(ROWS)
    for keep in ("smallest", "largest"):
        kept = exact_dedup.keep_one_of_each(docs, keep=keep).collect()
        assert len(kept) == len({t or "" for _, t in ROWS}) and {r[4:] for r in kept} == {tuple(docs.first())[4:]}
    odd = docs.withColumn("source", F.col("doc_id").cast("string")).union(docs.withColumn("source", F.lit("other")))
    made = [sorted(map(tuple, exact_dedup.keep_one_of_each(odd.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert made[0] == made[1]
    assert exact_dedup.keep_one_of_each(docs.limit(0)).count() == 0
    nulls = exact_dedup.keep_one_of_each(docs_of([(1, None), (2, "")])).collect() + exact_dedup.keep_one_of_each(docs_of([(2, None), (1, "")])).collect()
    assert [(r.doc_id, r.text) for r in nulls] == [(1, None), (1, "")]


def test_an_unknown_rule_is_refused(docs_of):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs_of(ROWS), keep="newest")


def water(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed, free = sum(sizes.values()), {}, set(names)
    while free:
        share = {n: (total - sum(fixed.values())) * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        if not over:
            return fixed | share
        for n in over:
            fixed[n] = most * sizes[n]
            free.discard(n)
    return fixed


MIXES = [
    [(i, "w " * (i % 13), None, f"s{i % 5}") for i in range(300)],
    [(i, "w " * (1 + i % 7), None, None if i % 9 == 0 else "hot" if i % 3 else f"s{i}") for i in range(200)],
    [(1, "a b c", None, "only")],
    [(1, None, None, "a"), (2, "", None, None)],
    [(i, "w " * (500 if i == 7 else 2), None, "abcdefgh"[i % 8]) for i in range(160)],
]


@pytest.mark.parametrize("rows", MIXES)
def test_mix_meets_targets(docs_of, rows):
    got = mixing.mix(docs_of(rows)).collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want, taken = water(sizes), defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").split())) for i, t, _, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, mixing.mix(docs_of(rows)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_nothing(docs_of):
    assert mixing.mix(docs_of(MIXES[0]).limit(0)).count() == 0


def test_positions_invert_the_demand(spark):
    knots = [(0.0, 2.0), (0.25, 0.5), (1.0, 1.0)]
    area = 0.25 * 1.25 + 0.75 * 0.75
    demand = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if t > a[0]) / area
    for r in spark.range(101).select((F.col("id") / 100).alias("x")).select("x", mixing.position(F.col("x"), knots).alias("t")).collect():
        assert demand(r.t) == pytest.approx(r.x, abs=1e-9)
    for bad in ([(0, 1)], [(0.0, 1.0), (0.5, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, -1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            mixing.position(F.lit(0.5), bad)


def test_training_order(docs_of):
    docs = docs_of(MIXES[0])
    mixed = mixing.mix(docs)
    out = mixing.in_training_order(docs, mixed, position_col="at")
    assert out.columns == [*docs.columns, "at"]
    with pytest.raises(ValueError):
        mixing.in_training_order(docs, mixed, position_col="__At")
    rows = [r.at for part in out.rdd.glom().collect() for r in part]
    assert rows == sorted(rows) and len(rows) == sum(r.copies for r in mixed.collect())


def test_op2_is_written_in_training_order(spark):
    got = queries.QUERIES["op2_mixing"](spark, SF)
    rows = [r for part in got.rdd.glom().collect() for r in part]
    first = [-1 if r.first_position is None else r.first_position for r in rows]
    assert first == sorted(first) and any(f > 0 for f in first)
    assert all((r.first_position is None) == (r.copies == 0) and r.taken == r.copies * r.size for r in rows)
