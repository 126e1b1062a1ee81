"""Tokenising, normalising, hashing and lines against byte-wise models."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordmill.config import CountConfig
from wordmill.functions.hashing import two_level, word_hash
from wordmill.functions.words import byte_view, from_byte_view, normalize, tokens
from wordmill.operators import buckets, counting
from wordmill.sources import sinks, text

LETTERS = set(b"abcdefghijklmnopqrstuvwxyz")


def model_word(token: bytes, strip: str) -> bytes:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in token)
    if not LETTERS & set(low):
        return low
    start, end = 0, len(low)
    while start < end and low[start] not in LETTERS:
        start += 1
        if strip == "once":
            break
    while end > start and low[end - 1] not in LETTERS:
        end -= 1
        if strip == "once":
            break
    return low[start:end]


def model_counts(lines: list[str], config: CountConfig) -> Counter:
    found: Counter = Counter()
    for line in lines:
        raw = line.encode() + b"\n"
        step = config.line_limit or len(raw)
        for at in range(0, len(raw), step):
            row = raw[at : at + step]
            if row[:1] == b"\n":
                continue
            for token in row.rstrip(b"\n").split(b" "):
                word = model_word(token, config.strip)
                if word and (config.max_bytes is None or len(word) <= config.max_bytes):
                    found[word] += 1
    return found


VECTORS = ["The", '"\'Hello,\'"', "don't", "he--it", "***", "1997", "9,", "café", "Éa", "aÉb", "word\r", "\r", "a\tb", "a,\r", "x" * 70, "x" * 71, "-a-", "--a--", "é", "A1b2", "\x00a"]


@pytest.mark.parametrize("strip", ["all", "once"])
def test_normalize_vectors(spark, strip):
    df = spark.createDataFrame([(v,) for v in VECTORS], "t string")
    got = {r.t: bytes(r.w) for r in df.select("t", from_byte_view(normalize(byte_view(F.col("t")), strip)).alias("w")).collect()}
    assert got == {v: model_word(v.encode(), strip) for v in VECTORS}


def test_normalize_all_needs_no_byte_view(spark):
    df = spark.createDataFrame([(v,) for v in VECTORS], "t string")
    assert {r.t: r.w.encode() for r in df.select("t", normalize(F.col("t")).alias("w")).collect()} == {v: model_word(v.encode(), "all") for v in VECTORS}


def test_tokens_split_on_single_spaces(spark):
    df = spark.createDataFrame([("a  b",), ("a ",), ("   ",), ("a\tb c",)], "v string")
    assert [r[0] for r in df.select(tokens(F.col("v"))).collect()] == [["a", "", "b"], ["a", ""], ["", "", "", ""], ["a\tb", "c"]]


def test_hash_vectors(spark):
    want = {"the": 249, "and": 139, "vasili": 152, "nikita": 0, "***": 138, "": 0}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", word_hash(F.col("w")).alias("h"), *[c.alias(n) for c, n in zip(two_level(F.col("w"), 16, 5), ("p", "t"))]).collect()
    assert {r.w: r.h for r in got} == want
    for r in got:
        assert (r.p, r.t) == (r.h % 16, 0 if r.h % 16 == 0 else r.h // 16 % 5)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ '-,.9é日\r\t")), max_size=90), max_size=12), st.sampled_from([CountConfig(), CountConfig(line_limit=7), CountConfig(strip="once", max_bytes=None), CountConfig(max_bytes=3)]))
def test_counts_equal_the_byte_model(spark, lines, config):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    got = {r.w if isinstance(r.w, str) else bytes(r.w): r.cnt for r in counting.count_words(df, config).withColumnRenamed("word", "w").collect()}
    assert {w.encode() if isinstance(w, str) else w: n for w, n in got.items()} == dict(model_counts(lines, config))


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"a b c{i % 7} D{i % 3}",) for i in range(200)], "value string")
    assert {tuple(r) for r in counting.count_words(df.repartition(1)).collect()} == {tuple(r) for r in counting.count_words(df.repartition(9)).collect()}


def test_columns_of_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n x")], "id int, t string")
    assert [(r.id, r.line_no, r.value) for r in text.column_lines(df, "t", "id").orderBy("id", "line_no").collect()] == [(2, 0, ""), (3, 0, ""), (3, 1, ""), (3, 2, " x")]
    assert [tuple(r) for r in counting.count_column(df, "t").collect()] == [("x", 1)]
    assert counting.count_column(df.limit(0), "t").count() == 0


def test_row_counters(spark):
    df = spark.createDataFrame([("",), ("a  b",), ("x" * 71,), ("'" * 80 + "y",)], "value string")
    assert counting.row_counters(df).first().asDict() == {"lines": 4, "blank_lines": 1, "tokens": 4, "words": 3, "dropped": 1}
    assert counting.row_counters(df.limit(0)).first().asDict() == {"lines": 0, "blank_lines": 0, "tokens": 0, "words": 0, "dropped": 0}


@pytest.mark.parametrize("n, chunks", [(3, 20), (20, 20), (2568, 20), (101, 7)])
def test_chunks_leave_the_rest_to_the_last(spark, n, chunks):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(n)], "d long, l long")
    sizes = Counter(r.chunk for r in text.chunk_of(df, ["d", "l"], chunks).collect())
    each = n // chunks
    assert sizes == ({chunks - 1: n} if each == 0 else {i: each if i < chunks - 1 else n - each * (chunks - 1) for i in range(chunks)})


def test_files_lines_and_outputs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.txt").write_bytes(b"The cat\r\n\nsat a\rb\n")
    (folder / "1.txt").write_bytes(b"the \"q\" don't 5,\n")
    lines = text.read_chunks(spark, str(folder), 2)
    assert sorted((r.file, r.value) for r in lines.collect()) == [("0.txt", ""), ("0.txt", "The cat\r"), ("0.txt", "sat a\rb"), ("1.txt", "the \"q\" don't 5,")]
    with pytest.raises(Exception, match="(?i)path"):
        text.read_chunks(spark, str(folder), 3).count()
    counts = counting.count_words(lines)
    want = {tuple(r) for r in counts.collect()}
    assert ("the", 2) in want and ("5,", 1) in want and ("a\rb", 1) in want
    sinks.write_counts(counts, str(tmp_path / "out"))
    assert {tuple(r) for r in sinks.read_counts(spark, str(tmp_path / "out")).collect()} == want
    sinks.write_counts(counts.limit(0), str(tmp_path / "out"), mode="ignore")
    assert sinks.read_counts(spark, str(tmp_path / "out")).count() == len(want)
    pid, tid = two_level(F.col("word"), 16, 5)
    sinks.write_partitioned(counts, str(tmp_path / "parts"), [pid, tid], ["pid", "tid"])
    back = sinks.read_counts(spark, str(tmp_path / "parts"))
    assert {(r.word, r.cnt) for r in back.collect()} == want and back.count() == len(want)
    sinks.merge_outputs(spark, str(tmp_path / "parts"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 and not (tmp_path / "parts").exists()
    assert sorted(map(tuple, sinks.read_counts(spark, str(tmp_path / "one")).collect())) == sorted(want)


def test_chunks_are_written_and_read_by_number(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i}", i % 3, i) for i in range(20)] + [("", 0, 50)], "value string, chunk int, place long")
    text.write_chunks(lines, str(tmp_path / "c"), 5)
    got = [(r.file, r.value) for r in text.read_chunks(spark, str(tmp_path / "c"), 5).collect()]
    assert sorted(got) == sorted([(f"{i % 3}.txt", f"line {i}") for i in range(20)] + [("0.txt", "")])
    assert [v for f, v in got if f == "1.txt"] == [f"line {i}" for i in range(20) if i % 3 == 1]


def test_counts_of_a_sample(spark):
    """A text of our own with known numbers: 40 lines of 12 words, 9 of them distinct after normalising."""
    lines = spark.createDataFrame([("The mill, the MILL; ground 7 sacks -- (sacks) of *** rye\tand oats. 7",)] * 40 + [("",)] * 5, "value string")
    got = {r.word: r.cnt for r in counting.count_words(lines).collect()}
    assert got == {"the": 80, "mill": 80, "ground": 40, "7": 80, "sacks": 80, "--": 40, "of": 40, "***": 40, "rye\tand": 40, "oats": 40}
    assert tuple(counting.row_counters(lines).first()) == (45, 5, 560, 560, 0)


def test_files_roll_over(spark, tmp_path):
    counts = spark.range(12_000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("cnt")).coalesce(1)
    sinks.write_counts(counts, str(tmp_path / "rolled"), rows_per_file=5000)
    assert len(list((tmp_path / "rolled").glob("part-*"))) == 3
    assert [tuple(r) for r in buckets.shuffle_manifest(counts.withColumn("mapper", F.lit("m")), 1).collect()] == [("m", 0, 3)]


def test_config_is_checked():
    for bad in ({"buckets": 0}, {"processes": 0}, {"max_bytes": 0}, {"line_limit": 1}, {"strip": "twice"}, {"rows_per_file": 0}):
        with pytest.raises(ValueError):
            CountConfig(**bad)


def test_plan_counts_before_the_shuffle(spark):
    df = spark.createDataFrame([("a b",)], "value string")
    plan = counting.count_words(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "partial_count" in plan and "partial_sum" in plan and "Python" not in plan
    by_bytes = counting.count_words(df, CountConfig(strip="once"))._jdf.queryExecution().executedPlan().toString()
    assert by_bytes.count("Exchange") == 1 and "partial_count" in by_bytes


def test_stream_equals_batch(spark, tmp_path):
    from wordmill.streaming import wordcount

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"a b{i}\nA c\n\n")
    counts = wordcount.count_stream(wordcount.stream_lines(spark, str(folder), files_per_batch=1))
    wordcount.start_counts(counts, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {tuple(r) for r in sinks.read_counts(spark, str(tmp_path / "out" / "batch=2")).collect()}
    assert got == {tuple(r) for r in counting.count_words(text.read_lines(spark, str(folder))).collect()}
    assert ("a", 6) in got


def test_folders_of_chunks(tmp_path):
    from wordmill.plans import grid

    for name in ("file_chunks_8", "file_chunks_130", "file_chunks", "other"):
        (tmp_path / name).mkdir()
    assert grid.chunk_folders(str(tmp_path)) == {"8": "file_chunks_8", "130": "file_chunks_130"}
