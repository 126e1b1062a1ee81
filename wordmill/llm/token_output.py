"""Tokenising a corpus into binary shards, and reading them back.

Documents are range-sorted by id, so shard after shard holds ascending ids and the place
of a document in the corpus is its shard's start plus its place there. Each task writes
one shard under a temporary name, frame by frame, and returns a manifest row; the
manifest is committed by Spark's own writer. A shard of a lost or repeated attempt is in no
manifest and is never read.

The tokenizer is asked once for each distinct piece of text between spaces: its pattern
always starts a new token at the space before a non-space character, so what it makes of
such a piece doesn't depend on what stands around it. Other spaces stay inside their piece.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm import token_file
from wordmill.llm.arrow_slices import slices
from wordmill.llm.durable import durable, fresh_path
from wordmill.llm.files import TemporaryFile, reading
from wordmill.llm.pieces import PieceMemory, between_spaces, concatenated
from wordmill.llm.shipping import ship

#: Words that a Python worker remembers in each of two generations (about 170 bytes each).
REMEMBERED = 300_000
#: A space before white space or the end; a cut there could take a run of white space apart.
_ODD_SPACE = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
_CUT = re.compile(r" (?=\S)").split
#: Lines of one word each, with or without marks behind it. The tokenizer's pattern always
#: cuts between letters and these marks, and around a lone line feed.
_MARKS = "[.,;:!?%$&*]"
_WORDS = rf"^ ?\p{{L}}+{_MARKS}*(?:\n\p{{L}}+{_MARKS}*)*$"
#: Words that the library is given as one text, a line each.
_JOINED = 500


class PieceEncoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._memory = PieceMemory(self._ask, REMEMBERED)
        self._line_feed = self._library(["\n"])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str]) -> list[bytes]:
        """Plain words are asked for many at a time and told apart by the line feeds between them."""
        plain = [len(self._line_feed) == 4 and w[w[:1] == " " :].isalpha() for w in words]
        many, others = [w for w, p in zip(words, plain) if p], iter(self._library([w for w, p in zip(words, plain) if not p]))
        got: list[bytes] = []
        for at in range(0, len(many), _JOINED):
            some = many[at : at + _JOINED]
            ids = np.frombuffer(self._library(["\n".join(some)])[0], dtype="<u4")
            feeds = np.flatnonzero(ids == np.frombuffer(self._line_feed, dtype="<u4"))
            if len(feeds) != len(some) - 1:
                got += self._library(some)
                continue
            raw, starts, ends = ids.tobytes(), [0, *(4 * feeds + 4).tolist()], [*(4 * feeds).tolist(), 4 * len(ids)]
            got += [raw[s:e] for s, e in zip(starts, ends)]
        words_ = iter(got)
        return [next(words_) if p else next(others) for p in plain]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """All pieces but a text's first have a space in front."""
        if not len(texts):
            return []
        pieces, lengths = between_spaces(texts, _ODD_SPACE, _CUT)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        coded, heads = pieces.dictionary_encode(), pieces.take(pa.array(first)).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        which[first] = len(coded.dictionary) + heads.indices.to_numpy()
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        distinct = pa.concat_arrays([pc.binary_join_element_wise(space, coded.dictionary, nothing), heads.dictionary])
        plain = pc.match_substring_regex(distinct, _WORDS)
        of_words, others = distinct.filter(plain), distinct.filter(pc.invert(plain))
        parts = pc.split_pattern(pc.replace_substring_regex(of_words, f"({_MARKS}+|\n)", "\x1f\\1\x1f"), "\x1f")
        words = pa.concat_arrays([parts.flatten(), others]).dictionary_encode()
        counts = np.concatenate([pc.list_value_length(parts).to_numpy(), np.ones(len(others), np.int64)])
        ids = concatenated(pa.array(self._memory(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()), words.indices, counts)
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(plain, np.cumsum(plain) - 1, len(of_words) + np.cumsum(~plain) - 1)
        return concatenated(ids, pa.array(place[which]), lengths).to_pylist()


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


MANIFEST = "shard string, part long, n_docs long, n_ids long"


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``folder``; return the committed manifest.

    Null text counts as empty text, so such a document has ``end_id`` alone. Null ids come
    first. Documents that repeat an id follow each other, in the order of their text's
    hash. Other columns are ignored. No documents, no shards.
    """

    ship(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, out = _encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), None
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        n_docs = n_ids = 0
        for b in slices(batches, "text"):
            coded = [c + end for c in encoder.encode(b.column("text"))]
            out = out or TemporaryFile(folder, f"shard-{part:06d}-{attempt[:8]}.tok", attempt)
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            out.write(token_file.encode_frame(b.column("id").to_pylist(), np.array([len(c) // 4 for c in coded]), ids))
            n_docs, n_ids = n_docs + b.num_rows, n_ids + len(ids)
        if out:
            out.commit()
            yield pa.RecordBatch.from_pydict({"shard": [out.uri], "part": [part], "n_docs": [n_docs], "n_ids": [n_ids]})

    tie = F.xxhash64(text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), tie.alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return durable(ordered.mapInArrow(write, MANIFEST), "token-manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32, all from the files.

    The manifest has a row per shard, so the running sum over it is small.
    """
    spark = manifest.sparkSession
    starts = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist()):
                with reading(shard) as f:
                    for doc_ids, lengths, ids in token_file.read_frames(f):
                        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                        begins = ends - lengths
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(lengths, pa.int64()),
                            pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins, ends)], pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += len(ids)

    n = max(1, manifest.count())
    return starts.repartition(n, "shard").mapInArrow(read, READ)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_token_shards(write_token_shards(docs, fresh_path(spark, "tokens"), tokenizer_path, end_id))
