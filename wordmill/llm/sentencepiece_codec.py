"""SentencePiece encoding and decoding with one forward pass per distinct word.

Text is marked (a mark in front, spaces become marks) and cut before every run of marks
and around characters that the vocabulary lacks; no piece reaches over such a cut. The
distinct words of a slice are sorted, which lays out their trie in depth-first order:
the forward states of the prefix that a word shares with the one before stay on a stack
and only the rest of the word is computed.

The state that a forward pass keeps for each prefix depends on the model's kind:

* *unigram*: best total score and the last piece of that path, as in Viterbi's algorithm;
* *bpe*: the last piece of the prefix's only segmentation. Merging by rank has the
  property that cutting pieces off the end of a text's segmentation leaves the segmentation
  of the text that remains. So of all pieces ending at a place exactly one continues the
  state where it starts, namely the one that merging would leave beside its neighbour.
  Summing a BPE model's scores would give other ids than that model's own encoder.

Characters without a piece become byte pieces, or the unknown piece where the model has
no bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.arrow_slices import slices
from wordmill.llm.pieces import PieceMemory, between_spaces, concatenated
from wordmill.llm.shipping import ship

MARK = "▁"
#: Pieces of text that a Python worker remembers with their ids in each of two generations.
REMEMBERED = 300_000
#: Pairs of pieces whose standing side by side is remembered.
PAIRS_REMEMBERED = 250_000


class PieceModel:
    """Pieces, scores and kind of a model; encodes words and decodes ids."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], kind: str, unk_id: int, byte_ids: list[int] | None, table: list[bytes]) -> None:
        self.pieces, self.scores, self.kind, self.unk_id, self.byte_ids = pieces, scores, kind, unk_id, byte_ids
        self._bytes = pa.array(table, pa.large_binary())
        self.longest = max(map(len, pieces), default=1)
        self._beside: dict[tuple[str | None, str], bool] = {}
        self._known = {p for p in pieces if len(p) == 1}
        self._memory = PieceMemory(self._ask, REMEMBERED)
        # A line break is not part of a word unless some piece holds one.
        self._breaks_lines = not any("\n" in p for p in pieces)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        kind = {pb.TrainerSpec.BPE: "bpe", pb.TrainerSpec.UNIGRAM: "unigram"}.get(proto.trainer_spec.model_type)
        if kind is None or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only bpe or unigram models with identity normalisation and a mark in front are supported")
        pieces, scores, table, by = {}, {}, [], {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                pieces[p.piece], scores[p.piece] = i, p.score
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece with a mark after a letter isn't supported")
            if p.type == kinds.BYTE:
                by[int(p.piece[3:5], 16)] = i
            table.append(bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode())
        return cls(pieces, scores, kind, proto.trainer_spec.unk_id, [by[b] for b in range(256)] if len(by) == 256 else None, table)

    # ---- words ----

    def _merged(self, text: str) -> list[str]:
        """Segmentation by merging, for the short strings that decide what may stand side by side."""
        parts = list(text)
        while True:
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _may_follow(self, before: str | None, piece: str) -> bool:
        key = (before, piece)
        found = self._beside.get(key)
        if found is None:
            found = self._merged((before or "") + piece) == ([piece] if before is None else [before, piece])
            if len(self._beside) >= PAIRS_REMEMBERED:
                self._beside.clear()
            self._beside[key] = found
        return found

    def _ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is not None:
            return [found]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk_id]

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, little-endian 32-bit ids) for distinct words, in sorted order."""
        pieces, longest, known, beside, may_follow = self.pieces, self.longest, self._known, self._beside, self._may_follow
        bpe, scores = self.kind == "bpe", self.scores
        unknown_score = min(scores.values(), default=0.0) - 10.0
        last: list[str | None] = [None]  # per prefix: its last piece
        score = [0.0]
        before = ""
        for word in sorted(words):
            n, k = len(word), 0
            top = min(n, len(before))
            while k < top and word[k] == before[k]:
                k += 1
            del last[k + 1 :]
            del score[k + 1 :]
            for end in range(k + 1, n + 1):
                found: str | None = None
                if word[end - 1] not in known:
                    found = word[end - 1]
                    score.append(score[-1] + unknown_score)
                elif bpe:
                    for start in range(end - 1, max(-1, end - 1 - longest), -1):
                        piece = word[start:end]
                        if piece in pieces:
                            left = last[start]
                            if left is not None and left not in pieces:
                                left = None  # nothing merges with a character that has no piece
                            ok = beside.get((left, piece))
                            if may_follow(left, piece) if ok is None else ok:
                                found = piece
                                break
                    score.append(0.0)
                else:
                    best = float("-inf")
                    for start in range(end - 1, max(-1, end - 1 - longest), -1):
                        piece = word[start:end]
                        if piece in pieces and (s := score[start] + scores[piece]) > best:
                            best, found = s, piece
                    score.append(best)
                if found is None:
                    raise ValueError(f"no segmentation of {word[:end]!r}")
                last.append(found)
            before = word
            out, end = [], n
            while end > 0:
                out.append(last[end])
                end -= len(last[end])
            yield word, np.array([i for p in reversed(out) for i in self._ids_of(p)], dtype="<i4").tobytes()

    # ---- texts ----

    _CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _cut(self, text: str) -> list[str]:
        """The marked words of a piece of text, line breaks apart."""
        marked = MARK + text.replace(" ", MARK)
        if not self._breaks_lines or "\n" not in marked:
            return self._CUT.findall(marked)
        out: list[str] = []
        for line in marked.split("\n"):
            if line:
                out += self._CUT.findall(line)
            out.append("\n")
        out.pop()
        return out

    def _ask(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        known = dict(self.encode_words(list({w for words in cut for w in words})))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian 32-bit ids of each text. A piece is what stands between single spaces; further
        spaces stay in front of the piece behind them, as marks do. Null is empty."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        pieces, lengths = between_spaces(texts, f"^ |  |{MARK}|^$", lambda t: re.split("(?<=[^ ]) ", t.replace(MARK, " ")) if t else [])
        words = pieces.dictionary_encode()
        found = self._memory(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        return concatenated(pa.array(found, pa.large_binary()), words.indices, lengths)

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """Text after text of ids, in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        raw = concatenated(self._bytes, pa.array(ids), lengths)
        for text in raw.to_pylist():
            text = text[text.startswith(b" ") :]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            yield text

    def decode(self, ids: Iterable[int]) -> str:
        return next(self.decode_all(np.array(list(ids), dtype=np.int64), np.array([len(ids)]))).decode()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel.load(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids, decoded_sha256: one row per input row, in no special order.

    ``decoded_sha256`` is the digest of what the ids decode to, so it equals the digest of
    the text where encoding loses nothing (identity normalisation loses nothing but the
    difference between a space and a literal mark). Null text counts as empty: no ids.
    Nothing is shuffled; memory is bounded by a slice of text and the word memory.
    """

    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in slices(batches, "text"):
            coded = m.encode(b.column("text"))
            lengths = pc.binary_length(coded).to_numpy() // 4
            ids = np.frombuffer(coded.buffers()[2], dtype="<i4", count=lengths.sum())
            digests = [hashlib.sha256(t).hexdigest() for t in m.decode_all(ids, lengths)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lengths, pa.int64()), lists, pa.array(digests, pa.string())], names=["id", "n_pieces", "ids", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, ids array<int>, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``coded`` with a column ``text_col`` holding the text of its ids; null ids give null."""

    ship(coded.sparkSession)

    @F.pandas_udf("string")
    def texts(ids):
        m = model(model_path)
        return ids.map(lambda x: None if x is None else m.decode(x))

    return coded.withColumn(text_col, texts(coded[ids_col]))
