"""The registered queries over the word-count engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.config import CountConfig
from wordmill.functions.hashing import bucket, two_level, word_hash
from wordmill.functions.words import ascii_lower, byte_view, count_row, normalize
from wordmill.operators import buckets, counting
from wordmill.plans import grid
from wordmill.sources import sinks, text
from wordmill.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Text columns that word counts are registered for.
COUNTED = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text", "part": "p_name", "events": "event_type"}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, name: str = "documents", *keep: str) -> DataFrame:
    return text.column_lines(_table(spark, sf_dir, name), COUNTED[name], *keep)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_words(_lines(spark, sf_dir))


# ---- SQL parts ----

_LINES = "(SELECT * REPLACE (s[line_no] AS s), line_no - 1 AS line0 FROM (SELECT {keep}, s, unnest(range(1, len(s) + 1)) AS line_no FROM (SELECT {keep}, string_split({col}, chr(10)) AS s FROM {table})))"


def _lines_sql(table: str = "documents", keep: str = "doc_id, source") -> str:
    return f"SELECT {keep}, line0 AS line_no, s AS value FROM {_LINES.format(keep=keep, col=COUNTED[table], table=table)}"


_LOW = "translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORM = rf"CASE WHEN regexp_matches({_LOW}, '[a-z]') THEN regexp_replace({_LOW}, '\A[^a-z]+|[^a-z]+\z', '', 'g') ELSE {_LOW} END"
_LATIN = "list_aggregate(list_transform(range(1, strlen({0}) + 1), lambda i: chr(('0x' || substr(hex(encode({0})), 2*i - 1, 2))::INT)), 'string_agg', '')"
_HASH = "list_reduce(list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2*i - 1, 2))::INT), lambda a, c: xor(xor(a * 16, a), c) & 255, 0)"


def _tokens_sql(table: str = "documents", keep: str = "doc_id, source") -> str:
    return f"SELECT {keep}, token FROM (SELECT {keep}, unnest(string_split(value, ' ')) AS token FROM ({_lines_sql(table, keep)}) WHERE value <> '') WHERE token <> ''"


def _words_sql(table: str = "documents", keep: str = "doc_id, source") -> str:
    return f"SELECT * FROM (SELECT {keep}, token, {_NORM} AS word FROM ({_tokens_sql(table, keep)})) WHERE strlen(word) <= 70"


_KEYS = {"documents": "doc_id, source", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id", "part": "p_partkey", "events": "event_id"}


def _counts_sql(table: str = "documents") -> str:
    return f"SELECT word, count(*)::BIGINT AS cnt FROM ({_words_sql(table, _KEYS[table])}) GROUP BY word"


# ---- word counts ----


def _wordcount(table: str) -> None:
    _query(f"wordcount_{table}", _counts_sql(table))(lambda spark, sf_dir: counting.count_words(_lines(spark, sf_dir, table)))


for _name in COUNTED:
    _wordcount(_name)


@_query("partial_counts", f"SELECT source AS mapper, word, count(*)::BIGINT AS cnt FROM ({_words_sql()}) GROUP BY source, word")
def partial_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.partial_counts(_lines(spark, sf_dir, "documents", "source"), "source")


@_query("merge_counts", f"SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT source, word, count(*) AS cnt FROM ({_words_sql()}) GROUP BY source, word) GROUP BY word")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.merge_counts(partial_counts(spark, sf_dir))


@_query(
    "row_counters",
    f"""SELECT (SELECT count(*) FROM ({_lines_sql()})) AS lines, (SELECT count(*) FROM ({_lines_sql()}) WHERE value = '') AS blank_lines,
    (SELECT count(*) FROM ({_tokens_sql()})) AS tokens, (SELECT count(*) FROM ({_words_sql()})) AS words,
    (SELECT count(*) FROM ({_tokens_sql()})) - (SELECT count(*) FROM ({_words_sql()})) AS dropped""",
)
def row_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.row_counters(_lines(spark, sf_dir))


_BYTE_LINE = _LATIN.format("value") + " || chr(10)"


@_query(
    "linebuf_wordcount",
    rf"""WITH l AS (SELECT {_BYTE_LINE} AS v FROM (SELECT CASE WHEN value = '' THEN NULL ELSE value END AS value FROM ({_lines_sql()})) WHERE value IS NOT NULL),
    s AS (SELECT regexp_replace(substr(v, i * 255 + 1, 255), '\n\z', '') AS value FROM (SELECT v, unnest(range(0, (length(v) - 1) // 255 + 1)) AS i FROM l)),
    t AS (SELECT token FROM (SELECT unnest(string_split(value, ' ')) AS token FROM s WHERE value <> '') WHERE token <> '')
    SELECT word, count(*)::BIGINT AS cnt FROM (SELECT {_NORM} AS word FROM t) WHERE length(word) <= 70 GROUP BY word""",
)
def linebuf_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in byte view, since a 255-byte row may end inside a character."""
    counts = counting.count_words(_lines(spark, sf_dir), CountConfig(line_limit=255))
    return counts.select(byte_view(F.col("word")).alias("word"), "cnt")


# ---- lines ----


@_query("nonblank_lines", f"SELECT doc_id, line_no, value FROM ({_lines_sql()}) WHERE value <> ''")
def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.nonblank(_lines(spark, sf_dir, "documents", "doc_id")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


@_query("capped_scan", f"SELECT doc_id, line_no, value FROM ({_lines_sql()}) WHERE value <> '' ORDER BY doc_id, line_no LIMIT 50")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_lines(nonblank_lines(spark, sf_dir), ["doc_id", "line_no"], 50)


@_query(
    "chunk_split",
    f"""SELECT doc_id, line_no, CASE WHEN n < 20 THEN 19 ELSE least((rn - 1) // (n // 20), 19) END::INT AS chunk
    FROM (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS rn, count(*) OVER () AS n FROM ({_lines_sql()}))""",
)
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    return text.chunk_of(lines, ["doc_id", "line_no"], 20)


# ---- tokens and words ----


@_query("tokens", f"SELECT doc_id, token, count(*)::BIGINT AS cnt FROM ({_tokens_sql()}) GROUP BY doc_id, token")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.split_words(_lines(spark, sf_dir, "documents", "doc_id"), "doc_id").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("cnt"))


@_query("ascii_lower_tokens", f"SELECT DISTINCT token, {_LOW} AS lowered FROM ({_tokens_sql()})")
def ascii_lower_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.split_words(_lines(spark, sf_dir)).distinct().select("token", ascii_lower(F.col("token")).alias("lowered"))


@_query("normalize_map", f"SELECT DISTINCT token, {_NORM} AS word FROM ({_tokens_sql()})")
def normalize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.split_words(_lines(spark, sf_dir)).distinct().select("token", normalize(F.col("token")).alias("word"))


@_query(
    "normalize_once_map",
    rf"""SELECT raw AS token, CASE WHEN regexp_matches({_LOW}, '[a-z]') THEN regexp_replace(regexp_replace({_LOW}, '\A[^a-z]', ''), '[^a-z]\z', '') ELSE {_LOW} END AS word
    FROM (SELECT raw, {_LATIN.format("raw")} AS token FROM (SELECT DISTINCT token AS raw FROM ({_tokens_sql()})))""",
)
def normalize_once_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word`` in byte view: stripping once takes one byte, which may halve a character."""
    return counting.split_words(_lines(spark, sf_dir)).distinct().select("token", normalize(byte_view(F.col("token")), "once").alias("word"))


@_query("length_guard_dropped", f"SELECT word, count(*)::BIGINT AS cnt FROM (SELECT {_NORM} AS word FROM ({_tokens_sql('pages', 'page_id')})) WHERE strlen(word) > 70 GROUP BY word")
def length_guard_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counting.words_of(_lines(spark, sf_dir, "pages"), config=CountConfig(max_bytes=None))
    return words.filter(F.octet_length("word") > 70).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


# ---- hashes and buckets ----


@_query("word_hash", f"SELECT word, {_HASH}::INT AS hash FROM ({_counts_sql()})")
def word_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("word", word_hash(F.col("word")).alias("hash"))


@_query(
    "bucket_histogram",
    f"""SELECT r AS buckets, (h % r)::INT AS bucket, count(*)::BIGINT AS words, sum(cnt)::BIGINT AS tokens
    FROM (SELECT {_HASH}::INT AS h, cnt FROM ({_counts_sql()})), (SELECT unnest([5, 8, 10, 16]) AS r) GROUP BY ALL""",
)
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_histogram(_counts(spark, sf_dir), [5, 8, 10, 16])


@_query(
    "two_level_buckets",
    f"""SELECT pid, tid, count(*)::BIGINT AS words, sum(cnt)::BIGINT AS tokens FROM (
    SELECT (h % 16)::INT AS pid, CASE WHEN h % 16 = 0 THEN 0 ELSE (h // 16) % 5 END::INT AS tid, cnt FROM (SELECT {_HASH}::INT AS h, cnt FROM ({_counts_sql()}))) GROUP BY ALL""",
)
def two_level_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.two_level_histogram(_counts(spark, sf_dir), 16, 5)


@_query(
    "bucket_dump",
    f"""SELECT i AS bucket, 'H[' || i || ']' || coalesce(items, ' NULL ') AS line FROM (SELECT unnest(range(300)) AS i)
    LEFT JOIN (SELECT {_HASH}::INT % 300 AS b, string_agg(' {{' || word || ',' || cnt || '}} ', '' ORDER BY word) AS items FROM ({_counts_sql()}) GROUP BY 1) ON b = i""",
)
def bucket_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_dump(_counts(spark, sf_dir), 300)


@_query(
    "shuffle_manifest",
    f"""SELECT mapper, ({_HASH} % 16)::INT AS bucket, ceil(count(*) / 5000.0)::BIGINT AS n_files
    FROM (SELECT DISTINCT source AS mapper, word FROM ({_words_sql()})) GROUP BY ALL""",
)
def shuffle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.shuffle_manifest(partial_counts(spark, sf_dir), 16)


# ---- rows of text ----


@_query("formatted_rows", f"SELECT word || ' ' || cnt AS value FROM ({_counts_sql()})")
def formatted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select(count_row(F.col("word"), F.col("cnt")).alias("value"))


@_query("parse_rows", _counts_sql())
def parse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.parse_counts(formatted_rows(spark, sf_dir))


@_query("merged_output", _counts_sql())
def merged_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all (process, thread) outputs, merged into one and read back."""
    parts, path = scratch_path(spark, "parts"), scratch_path(spark, "merged")
    sinks.write_partitioned(_counts(spark, sf_dir), parts, list(two_level(F.col("word"), 16, 5)), ["pid", "tid"])
    sinks.merge_outputs(spark, parts, path)
    return sinks.read_counts(spark, path)


@_query("reducer_files", f"SELECT word, cnt, ({_HASH} % 10)::INT AS bucket FROM ({_counts_sql()})")
def reducer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of 10 reducers, a folder each, read back with the reducer that wrote them."""
    path = scratch_path(spark, "reducers")
    sinks.write_partitioned(_counts(spark, sf_dir), path, bucket(F.col("word"), 10), ["bucket"])
    return sinks.read_counts(spark, path)


@_query("rolled_files", f"SELECT bucket, count(*)::BIGINT AS words, ceil(count(*) / 5000.0)::BIGINT AS n_files FROM (SELECT ({_HASH} % 5)::INT AS bucket FROM ({_counts_sql()})) GROUP BY bucket")
def rolled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that reducers begin anew after 5000 words: what lies on disk."""
    path = scratch_path(spark, "rolled")
    sinks.write_partitioned(_counts(spark, sf_dir), path, bucket(F.col("word"), 5), ["bucket"], rows_per_file=CountConfig().rows_per_file)
    rows = spark.read.text(path, lineSep="\n").select("bucket", F.col("_metadata.file_path").alias("file"))
    per_file = rows.groupBy("bucket", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("bucket").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("n_files"))


@_query("written_once", _counts_sql())
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished output stays as it is when the same run is submitted again."""
    path, counts = scratch_path(spark, "once"), _counts(spark, sf_dir)
    sinks.write_counts(counts, path, mode="ignore")
    sinks.write_counts(counts.withColumn("cnt", F.col("cnt") + 1), path, mode="ignore")
    return sinks.read_counts(spark, path)


@_query(
    "chunk_files_wordcount",
    f"""SELECT chunk || '.txt' AS file, word, count(*)::BIGINT AS cnt FROM (
    SELECT chunk, {_NORM} AS word FROM (SELECT chunk, unnest(string_split(value, ' ')) AS token FROM (
      SELECT value, CASE WHEN n < 20 THEN 19 ELSE least((rn - 1) // (n // 20), 19) END::INT AS chunk
      FROM (SELECT value, row_number() OVER (ORDER BY doc_id, line_no) AS rn, count(*) OVER () AS n FROM ({_lines_sql()})))) WHERE token <> '')
    WHERE strlen(word) <= 70 GROUP BY ALL""",
)
def chunk_files_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as 20 files named by number, and the words of each counted."""
    lines = _lines(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")
    chunks, folder = text.chunk_of(lines, ["doc_id", "line_no"], 20), scratch_path(spark, "chunks")
    text.write_chunks(chunks.select("value", "chunk", F.struct("doc_id", "line_no").alias("place")), folder, 20)
    return counting.partial_counts(text.read_chunks(spark, folder, 20), "file").withColumnRenamed("mapper", "file")


@_query("bucket_rows", f"SELECT word, cnt, ({_HASH} % 10)::INT AS bucket FROM ({_counts_sql()})")
def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 10 reducers would write."""
    return _counts(spark, sf_dir).withColumn("bucket", bucket(F.col("word"), 10))


@_query(
    "config_grid",
    """SELECT c::INT AS n_chunks, p::INT AS procs, 10::INT AS threads, r::INT AS "read", w::INT AS "write", m::INT AS "map", 10::INT AS reduce
    FROM (SELECT unnest([8, 16, 32, 64, 100, 130]) AS c), (SELECT unnest([2, 4, 8, 16]) AS p), (SELECT unnest([8, 16]) AS r), (SELECT unnest([8, 16]) AS w), (SELECT unnest([1, 2, 4]) AS m)
    WHERE p * r <= c AND r = w AND r + m <= 10""",
)
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.config_grid(spark, [8, 16, 32, 64, 100, 130])
