"""WARC archives, HTML extraction, language identification."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from helpers import SF

from wordmill.llm import html_extract, language_id, queries, warc
from wordmill.llm.durable import fresh_path
from wordmill.llm.html_pages import labelled_page


@pytest.fixture()
def pages_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, id int, digest string, text string")

    return make


BIG = "<p>" + "é word " * 40_000
PAGES = [(5, "http://a/é x\r\n", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 100), (1, "u", "y" * 99), (2, "u", "y" * 99), (4, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (3, "again", "x" * 100), (None, "n", "x" * 100), (10, "u", "a\r\n\r\nb" * 30)]


def expected(rows):
    holder = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            holder[h] = min(i, holder.get(h, i))
    seen, out = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body, first = (h or "").encode(), holder.get(h)
        revisit = first is not None and (i != first or (i, h) in seen) and sum(x[2] == h for x in rows) > 1
        seen.add((i, h))
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, pages_of, monkeypatch):
    manifest = warc.write_archives(pages_of(PAGES).repartition(3), fresh_path(spark, "t"))
    got = warc.read_archives(manifest)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(PAGES)
    assert sum(r.n_records for r in manifest.collect()) == len(PAGES)
    assert warc.archived(pages_of(PAGES).limit(0)).count() == 0


def test_archives_are_plain_gzip_with_whole_payloads_and_the_same_every_time(spark, pages_of):
    made = []
    for _ in range(2):
        manifest = warc.write_archives(pages_of(PAGES).coalesce(1), fresh_path(spark, "t"))
        made.append(b"".join(open(r.file.removeprefix("file:").replace("///", "/"), "rb").read() for r in manifest.orderBy("part", "seq").collect()))
    assert made[0] == made[1]
    plain = gzip.decompress(made[0])
    assert plain.count(b"WARC-Type: warcinfo") >= 1 and BIG.encode() in plain and b"WARC-Target-URI: http://a/\xc3\xa9%20x%0D%0A\r\n" in plain


@pytest.fixture()
def ranges_stay(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_are_cut_the_same_way_every_time(spark, pages_of, monkeypatch, ranges_stay):
    monkeypatch.setattr(warc, "RANGE_BYTES", (1 << 16, 1 << 20), raising=False)
    rows = [(i * 7 % 6007 - 900, f"u{i}", f"<p>{i % 4000}</p>" * (i % 20)) for i in range(6000)] + [(None, "n", f"<b>{i}</b>" * 9) for i in range(900)] + [(5, "again", "x" * 200)] * 900
    made = []
    for n in (3, 3, 11):
        manifest = warc.write_archives(pages_of(rows).repartition(n), fresh_path(spark, "t")).orderBy("part", "seq").collect()
        made.append({r.file.rpartition("/")[2]: open(r.file.removeprefix("file:").replace("///", "/"), "rb").read() for r in manifest})
        assert sum(r.n_records for r in manifest) == len(rows)
        ids = [-1000 if i is None else i for r in manifest for i in (r.first_id, r.last_id)]
        assert ids == sorted(ids) and len(made[-1]) >= 3
    assert [[hashlib.sha256(m[k]).hexdigest() for k in sorted(m)] for m in made[1:]] == [[hashlib.sha256(made[0][k]).hexdigest() for k in sorted(made[0])]] * 2
    got = warc.archived(pages_of(rows)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(((i, len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows), key=str)


def test_files_roll_by_size(spark):
    class Out:
        pass

    folder = fresh_path(spark, "roll")
    roller = warc._Roller(folder, 3, "abc")
    data = warc.record(1, "u", np.random.default_rng(0).bytes(1000), "d", None)
    old, warc.ROLL_BYTES = warc.ROLL_BYTES, 2500
    try:
        for i in range(7):
            roller.add(i, data)
        roller.close()
    finally:
        warc.ROLL_BYTES = old
    assert [r["seq"] for r in roller.rows] == list(range(len(roller.rows))) and len(roller.rows) > 2 and sum(r["n_records"] for r in roller.rows) == 7
    assert all(r["n_bytes"] < 2500 + 1600 for r in roller.rows)


def test_damage_is_seen(spark):
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    at = data.rindex(b"Content-Length: ", 0, data.index(b"\r\n\r\n")) + 16
    for bad in (data[:-1], data[:at] + b"9" + data[at:], b"NOPE" + data):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        import io

        list(warc.members(io.BytesIO(warc._member(data)[:-9])))


SITE = """<html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<div id=cookie-notice><p>We use cookies on this site to give you the best experience possible today.</p></div>
<header class='site-header'><h2>My Site</h2><ul><li><a href=x>Home</a></li></ul></header><!-- <p>not this</p> -->
<div class=wrapper><div class='post-content'><h1>Title  here</h1><p>First\n para with <a href=y title="a > b">a link</a> and &lt;text&gt; &amp more&hellip;
<p>Second<br>para.<div class='ad-slot'>Buy now!</div><ul><li>one<li>two</ul><p>Ok.</p><form><label>Name</label><input></form></div>
<aside><h3>Related</h3><p>Some long related teaser text that is a paragraph of prose and goes on.</p></aside>
<section id=comments><h2>Comments</h2><div class=comment><p>I really liked this article a lot and have so many words to say about it.</p></div></section></div>
<div style="display: none"><p>nobody sees this long paragraph of text in the page at all</p></div><footer>&copy; 2020 all rights</footer></body></html>"""


@pytest.mark.parametrize(
    "html, text",
    [
        (SITE, "Title here\nFirst para with a link and <text> & more…\nSecond para.\none\ntwo\nOk."),
        (None, ""),
        ("", ""),
        ("<script>x", ""),
        ("<article><p>a</article>", "a"),
        ("<article><p>a<b>b</b>c <i> d</i></p>\n<p></p><p>e", "abc d\ne"),
        ("<nav><a href=/>x</a></nav><article><h1>H &eacute;</h1><p>" + "w " * 30_000 + "</p></article><footer>f</footer>", "H é\n" + " ".join(["w"] * 30_000)),
        ("<article><p>1 < 2 and a<b</p></article>", "1 < 2 and a"),
        ("<b>" * 30_000 + "</x>" * 30_000 + "<article><p>words stand here</p></article>", "words stand here"),
        ("<div>" * 3000 + "<article><p>deep words stand here</p></article>", "deep words stand here"),
        ("<article><p>a&nbsp;b \u2003 c\u00a0</p></article>", "a b c"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_texts([html or ""], html_extract.default_model())[0] == text


PROSE = "The harbour was quiet that morning, and the boats that usually left before dawn lay side by side along the wall while their owners talked about the storm."
MORE = "Nobody had expected it to turn north so late in the year; by noon the rain had stopped and the first of the fishing boats went out again."
COMMENT = "I was there and remember it quite differently, but thank you for writing this up so nicely for all of us who live here."
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/b>Boats</a><li><a href=/c>Contact</a></ul></nav>"
FOOT = "<footer><p>&copy; 2021 Harbour News. All rights reserved.</p></footer>"
#: Written by hand; the model has not seen them.
HAND = {
    "body only": (f"<html><body>{PROSE}</body></html>", PROSE),
    "body with breaks": (f"<html><head><title>x</title></head><body>{PROSE}<br><br>{MORE}</body></html>", f"{PROSE} {MORE}"),
    "division with breaks": (f"<body><div>{PROSE}<br><br>{MORE}</div></body>", f"{PROSE} {MORE}"),
    "no markup": (f"{PROSE}\n{MORE}", f"{PROSE} {MORE}"),
    "paragraphs in the body": (f"<html><body><p>{PROSE}</p><p>{MORE}</p></body></html>", f"{PROSE}\n{MORE}"),
    "section of comments": (f"<html><body>{MENU}<article><h1>Harbour</h1><p>{PROSE}</p><p>{MORE}</p><section class=comments><h2>Comments</h2><p>{COMMENT}</p></section></article>{FOOT}</body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "list of comments": (f"<html><body>{MENU}<article><h1>Harbour</h1><p>{PROSE}</p><p>{MORE}</p><div id=comments><h3>2 replies</h3><ol class=comment-list><li><b>Ann B.</b><p>{COMMENT}</p><li><b>Cy</b><p>{COMMENT}</p></ol></div></article>{FOOT}</body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "name about search": (f"<html><body>{MENU}<div class='search-engines-history'><h1>Harbour</h1><p>{PROSE}</p><p>{MORE}</p></div>{FOOT}</body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "name about forms": (f"<html><body>{MENU}<div class='text-form-related'><h1>Harbour</h1><p>{PROSE}</p><p>{MORE}</p></div>{FOOT}</body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "paragraph with a name": (f"<html><body>{MENU}<article><h1>Harbour</h1><p class='share-of-text'>{PROSE}</p><p>{MORE}</p></article>{FOOT}</body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "old layout": (f"<html><body><table><tr><td class=sidebar><a href=/>Home</a><br><a href=/b>Boats</a></td><td class=content><h2>Harbour</h2><p>{PROSE}<p>{MORE}</td></tr></table></body></html>", f"Harbour\n{PROSE}\n{MORE}"),
    "wrapped": (f"<body><div id=wrapper><div class='site-header'>Harbour News</div><div id=main><h1>Harbour</h1><p>{PROSE}</p><blockquote>{MORE}</blockquote><img src=x><p>Photo</p></div><div class=sidebar><h3>Related</h3><p>{COMMENT}</p></div></div></body>", f"Harbour\n{PROSE}\n{MORE}\nPhoto"),
    "image and rule": (f"<body>{MENU}<main><h1>Harbour</h1><img src=a><hr><p>{PROSE}</p><hr><p>{MORE}<br>End.</p></main><div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div>{FOOT}</body>", f"Harbour\n{PROSE}\n{MORE} End."),
    "advert inside": (f"<body>{MENU}<article><h1>Harbour</h1><p>{PROSE}</p><div class='ad'><p>Buy two lamps and get the third one free until Sunday.</p></div><p>{MORE}</p><form><label>Mail</label><input name=m><button>Send</button></form></article></body>", f"Harbour\n{PROSE}\n{MORE}"),
}


@pytest.mark.parametrize("name", HAND)
def test_pages_written_by_hand(name):
    html, text = HAND[name]
    assert html_extract.main_texts([html], html_extract.default_model())[0] == text


SEEN = "<p>These are words of an article that a reader wants to see.</p>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is positive.</p>", "The sum a+b is positive."),
        ("<svg><path d='x'><p>After the drawing.</p>", "After the drawing."),
        ("<math><mi>q</mi><mspace/><p>After the formula.</p>", "q\nAfter the formula."),
        ("<svg><svg><g>" * 9 + "<p>After drawings.</p><p>b</p>", "After drawings.\nb"),
        ("<p>x <svg viewBox='0 0 1 1'><path d='M0 0'/><style>p{}</style><g/></svg> y</p>", "x y"),
        ("<svg><foreignObject><p>in</p><p>side</p></foreignObject></svg><p>z</p>", "in\nside\nz"),
        ("<p>a <video src=x>b</video> <canvas>c</canvas> <audio>d</audio> <object data=x>e</object></p><template><p>f</p></template>", "a b c d e\nf"),
        ("<video src=x><p>After it.</p>", "After it."),
        ("<p>pick <select><option>one<option>two</select> now</p>", "pick now"),
        ("<svg><desc>" + "<b>" * 30_000 + "</desc></svg><p>z</p>", "z"),
    ],
)
def test_only_raw_text_elements_lose_their_text(inner, text):
    got = html_extract.main_texts([f"<article>{SEEN}{inner}</article><footer>f</footer>"], html_extract.default_model())[0]
    assert got == f"{SEEN[3:-4]}\n{text}"


def test_marginals_equal_enumeration():
    import random
    from itertools import product

    model = html_extract.default_model()
    r = random.Random(4)
    for _ in range(8):
        (nodes, _) = html_extract._labelled(labelled_page(r))
        nodes = tuple(x[:7] for x in nodes)
        n = len(nodes[0])
        f = html_extract.Forest([nodes, nodes])
        seen = model.seen(f)
        total = np.zeros((n, 3))
        for states in product(range(3), repeat=n):
            p = np.exp(model.root[states[0]] + seen[0][states[0]] + sum(model.pair[f.relation[i], states[f.parent[i]], states[i]] + seen[i][states[i]] for i in range(1, n)))
            for i, s in enumerate(states):
                total[i, s] += p
        want = total / total.sum(axis=1, keepdims=True)
        assert np.allclose(model.marginals(f), np.vstack([want, want]))


def test_model_finds_labelled_texts():
    import random

    r = random.Random(77)
    made = [html_extract._labelled(labelled_page(r)) for _ in range(200)]
    f = html_extract.Forest([m[0] for m in made])
    got = html_extract.default_model().marginals(f)[:, html_extract.CONTENT] > 0.5
    state, leaf = np.array([s for m in made for s in m[1]]), f.tag == 0
    assert (got == (state == html_extract.CONTENT))[leaf].mean() > 0.97


def test_op6_over_its_table(spark):
    import html

    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op6_html_extraction"](spark, SF).collect()
    assert {r.page_id for r in got} == set(rows)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", rows[r.page_id].html)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_pages_frame(pages_of):
    rows = [(1, "u", None), (1, None, "<article><p>a b c d</p></article>"), (None, "u", "<article><p>a b c d</p></article>")]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages_of(rows)).collect()), key=str) == sorted([(1, "u", "", 0), (1, None, "a b c d", 7), (None, "u", "a b c d", 7)], key=str)
    assert html_extract.extract(pages_of(rows).limit(0)).count() == 0


def test_op10_over_its_table(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.98


TEXTS = {"en": "the quick brown fox and the lazy dog went over there with them ", "de": "der schnelle braune fuchs und die faulen hunde gingen über das feld ", "fr": "le renard brun et les chiens paresseux sont allés là avec eux ", "ja": "これは日本語の文章です。とても短いです "}


def test_languages(docs_of):
    rows = [(i, TEXTS[k] * (1 + i % 3), k) for i, k in enumerate(list(TEXTS) * 20)] + [(900, None, "en"), (901, "the", None)]
    classifier = language_id.train(docs_of(rows), held_out=None)
    assert classifier.families == {"germanic": ["de", "en"], "romance": ["fr"], "ja": ["ja"]}
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, TEXTS["fr"].upper()), (5, TEXTS["en"] * 3000), (6, "\x00 the lazy dog \x00"), (None, TEXTS["ja"]), (7, "é")]
    docs = docs_of(odd)
    found = language_id.identify(docs, classifier)
    assert set(found.columns) == set(docs.columns)  # two of these names were there before
    got = {r.doc_id: r.lang_pred for r in found.collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6, None)} == {1: "und", 2: "und", 3: "und", 4: "fr", 5: "en", 6: "en", None: "ja"}
    kept = language_id.accepted(docs, classifier)
    assert {tuple(r)[4:] for r in kept.collect()} == {tuple(docs.first())[4:]}
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 4
    assert language_id.identify(docs.limit(0), classifier).count() == 0


def test_characters_above_the_basic_plane(docs_of):
    table = language_id._is_letter()
    assert len(table) == 0x110000 and all(table[ord(c)] == c.isalpha() for c in "aé1 \uffff\U00010330\U0001d400\U00020000\U0001f600\U0010ffff")
    gothic = "\U00010330\U00010331\U00010332\U00010333 \U00010334\U00010335\U00010336 \U00010337\U00010338\U00010339 "
    rows = [(i, (TEXTS | {"got": gothic})[k] * (1 + i % 3) + "\U0001f600", k) for i, k in enumerate([*TEXTS, "got"] * 20)]
    classifier = language_id.train(docs_of(rows), held_out=None)
    odd = [(1, "\U0001f600 \U0001f680"), (2, TEXTS["fr"] + "\U0001f600"), (3, gothic), (4, "\U0001f600" + TEXTS["ja"] + "\U00020000")]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs_of(odd), classifier).collect()} == {1: "und", 2: "fr", 3: "got", 4: "ja"}
    plain, smiling = classifier.predict([TEXTS["de"], TEXTS["de"] + "\U0001f600"])[1]
    assert plain == smiling


def test_nothing_to_learn_from(docs_of):
    docs = docs_of([(1, "the", None), (2, None, "en")])
    classifier = language_id.train(docs)
    assert [r.lang_pred for r in language_id.identify(docs, classifier).collect()] == ["und", "und"]
    one = language_id.train(docs_of([(i, "the lazy dog", "en") for i in range(9)]))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"en", "und"}


def test_long_texts_are_looked_at_in_parts(monkeypatch):
    c = language_id.fit([(TEXTS[k] * 3, k) for k in TEXTS for _ in range(10)])
    texts = [TEXTS["de"] * 50, "", "les chiens", TEXTS["en"] * 20 + TEXTS["fr"] * 80]
    whole = c.margins(texts)[0]
    monkeypatch.setattr(language_id, "SLICE", 1000)
    assert np.abs(c.margins(texts)[0] - whole).max() < 0.05
    assert c.predict(texts)[0] == ["de", "und", "fr", "fr"]
    x = language_id.vectors("aé1 " * 3000)
    assert len(x) == 13 and all(abs(share.sum() - 1) < 1e-5 for _, share in x)


def test_predictions_follow_the_machines_text_by_text():
    c = language_id.fit([(TEXTS[k] * 3, k) for k in TEXTS for _ in range(10)])
    for text in [*TEXTS.values(), "the fox", "und les", "Über das Feld"]:
        votes = {p: m for p, m in zip(c.pairs, c.margins([text])[0][0])}
        wins = {f: sum(m >= 0 for (a, b), m in votes.items() if a == f and b in c.families) + sum(m < 0 for (a, b), m in votes.items() if b == f and a in c.families) for f in c.families}
        family = max(wins, key=lambda f: (wins[f], sum(m if a == f else -m for (a, b), m in votes.items() if f in (a, b) and {a, b} <= set(c.families))))
        inner = c.families[family]
        inside = {k: sum(m >= 0 for (a, b), m in votes.items() if a == k and b in inner) + sum(m < 0 for (a, b), m in votes.items() if b == k and a in inner) for k in inner}
        assert c.predict([text])[0][0] in [k for k in inner if inside[k] == max(inside.values())]


def test_scores_of_a_text_do_not_depend_on_its_batch():
    rows = [(TEXTS[k] * 3, k) for k in TEXTS for _ in range(10)]
    c = language_id.fit(rows)
    texts = ["the dog", "", "les chiens", "x", TEXTS["de"], "...", "und das"]
    together = c.predict(texts)
    for i, t in enumerate(texts):
        alone = c.predict([t])
        assert alone[0][0] == together[0][i] and alone[1][0] == pytest.approx(together[1][i])
