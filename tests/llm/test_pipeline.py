"""The pipeline against the same stages in plain Python."""

import hashlib
from collections import Counter, defaultdict

from helpers import SF
from test_exact import water
from test_near import brute_near

import corpus_pipeline
from wordmill.llm import queries


def brute_mix(rows):
    sizes, by_source, out = defaultdict(int), defaultdict(list), Counter()
    for r in rows:
        n = len(r.text.split())  # these texts hold ASCII white space only
        sizes[r.source] += n
        by_source[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, n))
    target = water(sizes)
    for source, docs in by_source.items():
        before = 0
        for _, i, n in sorted(docs):
            out[i] = sum(before + n / 2 + k * sizes[source] < target[source] for k in range(3))
            before += n
    return +out


def test_stages(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    near = brute_near([(r.doc_id, r.text) for r in first.values()], 5)
    kept = [r for r in first.values() if near[r.doc_id][1] == r.doc_id]
    want = brute_mix(kept)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == want
    texts = {r.doc_id: r.text for r in docs}
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_take_odd_tables(spark, docs_of):
    en, fr = "the lazy dog went over there and the fox too", "les chiens sont là avec eux et le renard aussi"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, en, "en", "a"), (4, en, "en", None), (None, fr, "fr", "b"), (4, "x", None, "b"), (4, en, "en", None), (5, "123 !?", "en", "a"), (6, en + " " + "word " * 40_000, "en", "a")]
    for table, last in ((docs_of(rows), {None, 3, 6}), (docs_of(rows).limit(0), set())):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns
                assert {tuple(r)[4:] for r in out.collect()} <= {tuple(r)[4:] for r in table.collect()}
            docs = out
        assert {r.doc_id for r in docs.collect()} - {4} <= last
        assert bool(last) == bool(docs.count())


def test_each_stage_on_odd_rows(spark, docs_of):
    stages = dict(corpus_pipeline.STAGES)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "a b c d e f", "en", "a"), (3, "a b c d e f", "en", "a"), (None, "a b c d e f", "en", None), (4, "A b c d e f", None, "a")]
    ids = lambda name: sorted((r.doc_id for r in stages[name](spark, docs_of(rows), SF).collect()), key=str)
    assert ids("exact_dedup") == [1, 3, 4]
    assert ids("minhash_dedup") == [1, 2, 3, 3, None]
    assert ids("sentencepiece") == [1, 2, 3, 3, 4, None]
    assert stages["language_id"](spark, docs_of([(1, "the dog", None)]), SF).count() == 0


def test_stages_take_characters_above_the_basic_plane(spark, docs_of):
    text = {"en": "the lazy dog went over there and the fox too {} \U0001f600", "fr": "les chiens sont là avec eux et le renard aussi {} \U0001d400"}
    rows = [(i, text[k].format("ab" * (i + 1)), k, "a") for i, k in enumerate(["en", "fr"] * 10)]
    docs = docs_of([*rows, (90, "\U0001f600\U0001f680", "en", "a"), (91, "\U00010330\U00010331 \U00020000", "fr", "a")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    ids = {r.doc_id for r in docs.collect()}
    assert 90 not in ids and len(ids & {r[0] for r in rows}) >= 10
