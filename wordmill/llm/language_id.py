"""Language identification: family first, then languages within it.

Features are relative frequencies of character 1- to 3-grams of lower-cased letters, hashed
to ``BINS`` bins, with every run of non-letters as one word boundary. Between each two
families, and between each two languages of a family, stands one linear support vector
machine. The family with most votes is taken first, then the language with most votes
inside it; ties go to the larger sum of margins.

A classifier on frequencies is a mean of weights over a text's n-grams, so a whole text is
scored in one pass with no feature vector.

Training takes at most ``SAMPLE`` labelled rows of each language, those with the smallest
hash of id and text (a bounded sample, the same on every run). Each text counts whole, and
pieces of several lengths count beside it so that short texts are judged well too. Texts
become vectors where they lie; one task gets the vectors (of at most ``BINS`` entries each,
however long the text) and fits; the driver gets the weights.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm.arrow_slices import slices
from wordmill.llm.names import column
from wordmill.llm.shipping import ship

#: Most labelled rows of a language that training looks at.
SAMPLE = 150
BINS = 1 << 12
#: Lengths, in characters, of the pieces that training texts are cut into.
PIECES = (24, 60, 200, 1200)
#: Most pieces of each length that a training row is cut into.
PER_LENGTH = 3
UNKNOWN = "und"
#: Bytes of text that are scored at once; characters of a longer text that are looked at together.
SLICE = 1_000_000
#: Families by language code; a code that is not listed is a family of its own.
FAMILIES: dict[str, str] = {
    "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sr": "slavic", "uk": "slavic",
}

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter, for all 0x110000 of them (1.1 MB)."""
    if not _letters:
        _letters.append(np.frombuffer(bytearray(map(str.isalpha, map(chr, range(0x110000)))), dtype=bool))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every n-gram, number of n-grams of each text); no letters, no n-grams."""
    bins, counts = [], np.zeros(len(texts), dtype=np.int64)
    joined = "\x00".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    ends = np.flatnonzero(code == 0)
    if len(ends) != max(len(texts) - 1, 0):  # a text holds a NUL
        return grams([t.replace("\x00", " ") for t in texts])
    letter = _is_letter()[code]
    # Keep letters and the first of each run of others; a boundary is 32, a text's end stays.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    keep[ends] = True
    c = np.where(letter, code, 32).astype(np.uint32)
    c[ends] = 0
    c, owner_ends = c[keep], np.cumsum(keep)[ends] - 1 if len(ends) else ends
    c = np.concatenate([[32], c, [32, 32]]).astype(np.uint32)
    stop = np.zeros(len(c), dtype=bool)
    stop[owner_ends + 1] = True
    c[stop] = 32
    text_of = np.cumsum(stop)
    solid = c != 32
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-2] + c[1:-1]) * np.uint32(0x85EBCA6B) + np.uint32(1)
    three = (two + c[2:]) * np.uint32(0xC2B2AE35) + np.uint32(2)
    at = [np.flatnonzero(solid[:-2]), np.flatnonzero(solid[:-2] | solid[1:-1]), np.flatnonzero(solid[1:-1])]
    out = [one[at[0]], two[at[1]], three[at[2]]]
    shift = np.uint32(32 - BINS.bit_length() + 1)
    where = np.concatenate([text_of[at[0]], text_of[at[1]] + 0, text_of[at[2] + 1]]) if len(c) else np.zeros(0, int)
    bins = np.concatenate([(v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for v in out]).astype(np.int32)
    order = np.argsort(where, kind="stable")
    counts[:] = np.bincount(where, minlength=len(texts))[: len(texts)]
    return bins[order], counts


def _parts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in parts of at most ``SLICE`` characters, and whose each part is. The two n-grams
    or so across a cut don't count."""
    parts = [t[at : at + SLICE] for t in texts for at in range(0, max(len(t), 1), SLICE)]
    return parts, np.repeat(np.arange(len(texts)), [max(-(-len(t) // SLICE), 1) for t in texts])


@dataclass(frozen=True)
class Classifier:
    """One linear machine per pair; a positive margin speaks for the first of the pair."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (BINS, pairs)
    bias: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner = _parts(texts)
        bins, counts = grams(parts)
        some = counts > 0
        total = np.bincount(owner, weights=counts, minlength=len(texts))
        out = np.zeros((len(texts), len(self.pairs)))
        if some.any() and self.pairs:
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            for p in range(len(self.pairs)):
                sums = np.add.reduceat(self.weights[:, p][bins].astype(np.float64), starts)
                out[:, p] = np.bincount(owner[some], weights=sums, minlength=len(texts)) / np.maximum(total, 1) + self.bias[p]
        return out, total > 0

    def _winner(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winning name, its probability) from the machines among ``names``."""
        votes, total, least = (np.zeros((len(margins), len(names))) for _ in range(3))
        least[:] = np.inf
        for i, j in combinations(range(len(names)), 2):
            m = margins[:, self.pairs.index((names[i], names[j]))]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.lexsort((total, votes), axis=1)[:, -1] if len(names) > 1 else np.zeros(len(margins), int)
        margin = least[np.arange(len(margins)), best]
        return best, 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0..1) of each text; no letters: ``und`` and 0."""
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins, some = self.margins(texts)
        names = sorted(self.families)
        family, score = self._winner(names, margins)
        out = np.empty(len(texts), dtype=object)
        for f, name in enumerate(names):
            which = np.flatnonzero(family == f)
            if len(which):
                best, inner = self._winner(self.families[name], margins[which])
                out[which] = np.array(self.families[name], dtype=object)[best]
                score[which] *= inner
        out[~some] = UNKNOWN
        return out.tolist(), np.where(some, score, 0.0)


def _machine(sides: tuple[list[np.ndarray], list[np.ndarray]], rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, by accelerated gradient descent,
    for the rows of two lists of blocks. The last column is 1, for the bias.

    Both sides weigh the same, however many rows they have.
    """
    blocks = [*sides[0], *sides[1]]
    ends = np.cumsum([len(b) for b in blocks])
    sizes = [sum(map(len, s)) for s in sides]
    y = np.repeat(np.array([1, -1], np.float32), sizes)
    weight = np.repeat(np.array([0.5 / n for n in sizes], np.float32), sizes)
    times = lambda v: np.concatenate([b @ v for b in blocks])
    back = lambda u: sum(b.T @ p for b, p in zip(blocks, np.split(u, ends[:-1])))
    n = blocks[0].shape[1]
    v = np.random.default_rng(0).normal(size=n).astype(np.float32)
    for _ in range(12):  # largest curvature
        v = back(weight * times(v))
        v /= np.linalg.norm(v)
    step = 1 / (2.2 * np.linalg.norm(back(weight * times(v))) + penalty)
    w, ahead = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for k in range(rounds):
        gap = np.maximum(1 - y * times(ahead), 0)
        new = ahead - np.float32(step) * (np.float32(penalty) * ahead - 2 * back(weight * gap * y))
        ahead, w = (new + np.float32(k / (k + 3)) * (new - w)).astype(np.float32), new
    return w[:-1], float(w[-1])


def vectors(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bins, shares) of a whole text and of pieces spread over it; without letters, none."""
    pieces = [text[i * len(text) // n :][:length] for length in PIECES for n in [min(PER_LENGTH, -(-len(text) // length))] for i in range(n)]
    parts, _ = _parts([text])
    whole = sum((np.bincount(grams([p])[0], minlength=BINS) for p in parts), np.zeros(BINS, np.int64))
    counted = [whole, *(np.bincount(grams([p])[0], minlength=BINS) for p in pieces)]
    return [(at.astype("<u2"), (c[at] / c.sum()).astype("<f4")) for c in counted for at in [np.flatnonzero(c)] if len(at)]


def fit(rows: list[tuple[str, str]], families: dict[str, str] | None = None) -> Classifier:
    """(text, language) rows → classifier. No usable rows: everything will be ``und``."""
    return _fit([(lang, *v) for text, lang in rows for v in vectors(text)], families)


def _fit(rows: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str] | None = None) -> Classifier:
    families = FAMILIES if families is None else families
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, at, share in rows:
        by_lang.setdefault(lang, []).append((at, share))
    known: dict[str, list[str]] = {}
    for lang in sorted(by_lang):
        known.setdefault(families.get(lang, lang), []).append(lang)
    names = list(combinations(sorted(known), 2))
    pairs = names + [p for f in sorted(known) for p in combinations(known[f], 2)]
    weights, bias = np.zeros((BINS, len(pairs)), dtype=np.float32), np.zeros(len(pairs))
    if not pairs:
        return Classifier(known, [], weights, bias)
    blocks: dict[str, np.ndarray] = {}
    for lang in sorted(by_lang):
        x = np.zeros((len(by_lang[lang]), BINS + 1), dtype=np.float32)
        x[:, BINS] = 1
        for row, (at, share) in zip(x, by_lang[lang]):
            row[at] = share
        blocks[lang] = x
    mean = sum(x[:, :BINS].sum(axis=0, dtype=np.float64) for x in blocks.values()) / sum(map(len, blocks.values()))
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)
    for x in blocks.values():
        x[:, :BINS] *= scale
    for p, pair in enumerate(pairs):
        sides = [[blocks[k] for k in known[f]] for f in pair] if p < len(names) else [[blocks[k]] for k in pair]
        w, bias[p] = _machine((sides[0], sides[1]))
        weights[:, p] = w * scale
    return Classifier(known, pairs, weights, bias)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int | None = 0) -> Classifier:
    """Fit on a bounded sample of the labelled rows outside the fold ``held_out``.

    Rows with null text or null language teach nothing.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    if held_out is not None:
        rows = rows.filter(fold(F.col("id")) != held_out)
    rows = rows.select("lang", F.xxhash64("id", "text").alias("h"), "text")
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return _fit([])
    # About 2 * SAMPLE rows of each language have a hash up to its top.
    tops = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(-(1 << 63) + int(min(1.0, 2 * SAMPLE / n) * ((1 << 64) - 1)), (1 << 63) - 1))])

    def vectorise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            for lang, h, text in zip(*(c.to_pylist() for c in b.columns)):
                found = vectors(text)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "h": [h], "tie": [hashlib.sha256(text.encode()).digest()], "at": [[v[0].tobytes() for v in found]], "share": [[v[1].tobytes() for v in found]]}, schema=_VECTORS)

    def learn(table: pa.Table) -> pa.Table:
        got: dict[str, list[tuple]] = {}
        for row in table.select(["lang", "h", "tie", "at", "share"]).to_pylist():
            got.setdefault(row["lang"], []).append((row["h"], row["tie"], row["at"], row["share"]))
        chosen = [(lang, np.frombuffer(a, "<u2"), np.frombuffer(s, "<f4")) for lang in sorted(got) for _, _, at, share in sorted(got[lang])[:SAMPLE] for a, s in zip(at, share)]
        return pa.table({"model": pa.array([pickle.dumps(_fit(chosen))], pa.binary())})

    sample = rows.filter(F.col("h") <= F.element_at(tops, F.col("lang"))).mapInArrow(vectorise, "lang string, h long, tie binary, at array<binary>, share array<binary>")
    found = sample.groupBy().applyInArrow(learn, "model binary").first()
    return pickle.loads(found.model) if found else _fit([])


_VECTORS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("tie", pa.binary()), ("at", pa.list_(pa.binary())), ("share", pa.list_(pa.binary()))])


def _judged(docs: DataFrame, classifier: Classifier, text_col: str) -> DataFrame:
    """row (all columns but the text), text, lang, score."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(F.lit(0).alias("0"), *(column(c) for c in docs.columns if c != text_col)).alias("row"), column(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            lang, score = classifier.predict([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "text", "lang", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))


def _columns(names: list[str], text_col: str) -> list[Column]:
    return [(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in names]


def identify(docs: DataFrame, classifier: Classifier, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the two named (columns of these names are replaced).

    The prediction sees the whole text and nothing else. Null, empty and letterless texts
    are ``und`` with score 0. Repeated rows and ids are judged one by one; no rows in, no
    rows out. Nothing is shuffled.
    """
    others = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    found = _judged(docs.select(*map(column, others)), classifier, text_col)
    return found.select(*_columns(others, text_col), F.col("lang").alias(lang_out), F.col("score").alias(score_out))


#: A winner of one machine at each level has this at least; less means that machines disagree.
MIN_SCORE = 0.3


def accepted(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language can be told.

    Null, empty and letterless texts go, and those that score below ``MIN_SCORE``. All other
    columns stay as they are, whatever their names.
    """
    found = _judged(docs, classifier, text_col).filter((F.col("lang") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.select(*_columns(docs.columns, text_col))
