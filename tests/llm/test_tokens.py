"""SentencePiece codec, token shards."""

import hashlib
import io
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmill.llm import queries, sentencepiece_codec, token_file, token_output
from wordmill.llm.pieces import PieceMemory
from wordmill.llm.sentencepiece_codec import PieceModel

ODD = ["", None, " ", "  ", "a", "a b", "a  b", "  a", "a \n b", "\n", "\n\na", "日本語 テスト", "é è\tq", "emoji 😀😀 ok", "\x00a\x00", "<s> </s> <unk>", "<0x41>", "1234567 89", "a   ", "<|endoftext|> a<|endoftext|>b", "it's we'll  I'd\t\tx", "a" * 3000, "ab " * 40_000, "x  y", "x  y", "a\r\n b", "end.\nOf line,\nNo. 7\n\nx!?\ny.z\x1fq", "a²b c½. é́.\nß", "\x1f", "a\u00a0 b \u2003c"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(queries.tokenizer_path("piece_bpe_32k.model"))


def ids_of(model, text):
    return np.frombuffer(model.encode(pa.array([text]))[0].as_py(), "<i4").tolist()


def test_pieces_equal_the_library(spark, library, model):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [np.frombuffer(c, "<i4").tolist() for c in model.encode(pa.array(texts)).to_pylist()] == library.encode(texts)
    assert [model.decode(i) for i in library.encode(texts)] == texts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("thein goand▁ \nßé日s0")), max_size=40))
def test_any_text_equals_the_library(library, model, text):
    assert ids_of(model, text) == library.encode(text)
    assert model.decode(ids_of(model, text)) == text.replace("▁", " ")


def test_unigram_takes_the_best_path():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.2, "▁a": -3.5, "ba": -2.9, "▁ab": -6.0, "bab": -6.5}
    model = PieceModel({p: i + 1 for i, p in enumerate(scores)}, scores, "unigram", 0, None, [])
    for word in ("".join(w) for n in range(1, 7) for w in product("ab", repeat=n)):
        marked = f"▁{word}"

        def best(at):
            return 0.0 if at == len(marked) else max((scores[marked[at:e]] + best(e) for e in range(at + 1, len(marked) + 1) if marked[at:e] in scores), default=-1e9)

        names = list(scores)
        got = [names[i - 1] for i in ids_of(model, word)]
        assert "".join(got) == marked and sum(scores[p] for p in got) == pytest.approx(best(0))
    assert ids_of(model, "q") == [1, 0]


def test_encode_frame_and_decode(docs_of):
    docs = docs_of(list(enumerate(ODD)))
    path = queries.tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode(docs, path)
    back = {r.doc_id: r.back for r in sentencepiece_codec.decode(coded, path, text_col="back").collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert sentencepiece_codec.encode(docs.limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=600), max_size=5))
def test_frames_round_trip(docs):
    lengths, ids = np.array([len(d) for d in docs], dtype=np.int64), np.array([i for d in docs for i in d], dtype=np.uint32)
    names = [None if i == 1 else i * 7 - 3 for i in range(len(docs))]
    frame = token_file.encode_frame(names, lengths, ids)
    for got_names, got_lengths, got in token_file.read_frames(io.BytesIO(frame + frame)):
        assert got_names == names and (got_lengths == lengths).all() and (got == ids).all()
    if len(frame) > 60:
        for cut in (frame[:-1], frame[:50] + bytes([frame[50] ^ 1]) + frame[51:]):
            with pytest.raises(ValueError):
                list(token_file.read_frames(io.BytesIO(cut)))


def test_outliers_become_exceptions():
    ids = np.full(1024, 5, dtype=np.uint32)
    ids[::50] = 4_000_000_000
    assert len(token_file.encode_frame([1], np.array([1024]), ids)) < 400


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def coder():
    return token_output.PieceEncoder(queries.tokenizer_path("byte_bpe_50k.json"))


def test_memo_equals_the_library(spark, tokenizer, coder):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [np.frombuffer(c, "<u4").tolist() for c in coder.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's1 \n\t  .é<|>")), max_size=30))
def test_any_text_equals_the_tokenizer(tokenizer, coder, text):
    assert np.frombuffer(coder.encode(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_shards(docs_of, tokenizer):
    rows = [(i * 3 % len(ODD), t) for i, t in enumerate(ODD)] + [(None, "null id"), (500, "same"), (500, "same")]
    got = token_output.tokenised(docs_of(rows).repartition(3), queries.tokenizer_path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert [s[0] for s in seen] == sorted((w[0] for w in want), key=lambda x: -1 if x is None else x)
    assert token_output.tokenised(docs_of(rows).limit(0), queries.tokenizer_path("byte_bpe_50k.json"), 2).count() == 0


def test_op1_over_its_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op1_sentencepiece"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op4_over_its_table(spark, tokenizer):
    start, want = 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op4_token_output"](spark, SF).collect())) == want


def test_memory_forgets_what_is_not_wanted():
    asked = []
    memory = PieceMemory(lambda words: asked.extend(words) or [w.encode() for w in words], 3)
    for words in (["a", "b"], ["c", "a", ""], ["a", "d", "e", "f"], ["a", "b"], ["g", "h", "i", "j", "k", "l", "m", "a"]):
        assert memory(words) == [w.encode() for w in words]
        assert len(memory._young) + len(memory._old) <= 6
    assert asked.count("b") == 2 and asked.count("") == 1
