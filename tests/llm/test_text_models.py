from collections import Counter
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import html_extract, piece_lattice, quality_crf, token_rollup
from tessella.llm.piece_lattice import MODEL, decode, encode, encode_pieces, load, row_key

DOCS = "doc_id long, text string, source string, lang string, score double, lines long"


# -- quality


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return quality_crf.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_quality_on_held_out_documents(spark, model):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_crf.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    kept = {r.doc_id for r in quality_crf.keep_good(docs, model).select("doc_id").collect()}
    assert all(r.doc_id in kept for r in got if r.quality == 1)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    scores, move = rng.standard_normal((5, 2)), rng.standard_normal((2, 2))
    marginal, pairs, log_z = quality_crf._chain(scores, move)
    total, ones, both = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        w = np.exp(sum(scores[k, y[k]] for k in range(5)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        ones += w * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            both[a, b] += w
    assert np.allclose(marginal, ones / total) and np.allclose(pairs, both / total) and np.isclose(log_z, np.log(total))


def test_quality_edges(spark, model):
    rows = [(1, None, "s", None, 0.1, 1), (2, "", "s", "l", 0.1, 1), (None, "text here.", None, None, None, None), (3, "word. " * 30_000, "s", "l", 0.1, 1), (3, "\n" * 50, "s", "l", 0.1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_crf.score_quality(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_crf.keep_good(docs, model).columns == docs.columns
    assert quality_crf.score_quality(docs.limit(0), model).count() == 0
    none = quality_crf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in quality_crf.score_quality(docs, none).collect())


def test_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda read: seen.append([(len(n), y) for _, n, y in read]))
    ids = [i for i in range(400) if not quality_crf.held_out(i)][:100]
    docs = spark.createDataFrame([(i, "line\n" * 9, "s", "l", 0.0, 1) for i in ids] + [(ids[0], "again", "s", "l", 0.0, 1)] * 50 + [(None, "x", "s", "l", 0.0, 1)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, quality int")
    quality_crf.train(docs, labels)
    quality_crf.train(docs, labels, max_docs=7)
    quality_crf.train(docs, labels, max_lines=205)
    quality_crf.train(docs, labels, max_chars=10)
    assert [len(s) for s in seen[:2]] == [100, 7] and 190 <= sum(n for n, _ in seen[2]) <= 205
    assert seen[3] == [(1, ids[0] % 2)]


# -- pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return load(f.read(), 1.0)


TEXTS = ["", " ", "\n", "hello world", "  two  spaces ", "tab\tcr\r\n\n\nend", "literal ▁ mark ▁▁", "é😀﷐\x00", "x" * 5000, "a b " * 3000, "no" + "—" * 90]


def test_lossless_and_reproducible(vocabulary):
    keys = [row_key(i) for i in range(len(TEXTS))]
    whole = encode(TEXTS, keys, vocabulary)
    assert [decode(x, vocabulary) for x in whole] == TEXTS
    for k in reversed(range(len(TEXTS))):
        assert np.array_equal(encode([TEXTS[k]], [keys[k]], vocabulary)[0], whole[k])
    assert any(not np.array_equal(a, b) for a, b in zip(whole, encode(TEXTS, [k + 1 for k in keys], vocabulary), strict=True))


def test_slices_do_not_change_segmentations(vocabulary, monkeypatch):
    want = encode(TEXTS, list(range(len(TEXTS))), vocabulary)
    monkeypatch.setattr(piece_lattice, "SLICE", 97)
    assert all(np.array_equal(a, b) for a, b in zip(want, encode(TEXTS, list(range(len(TEXTS))), vocabulary), strict=True))


@pytest.mark.parametrize("linear", [40, 0])
def test_samples_follow_the_lattice(vocabulary, monkeypatch, linear):
    monkeypatch.setattr(piece_lattice, "LINEAR", linear)
    v = vocabulary
    weight = {v.pieces[i].decode(): w for i, w in zip(v.ids, v.weights, strict=True)}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                yield from ((s[:k], *rest) for rest in ways(s[k:]))

    mass = {w: np.exp(sum(weight[p] for p in w)) for w in ways(" there")}
    total, n = sum(mass.values()), 6000
    seen = {}
    for ids in encode(["there"] * n, [row_key(k) for k in range(n)], v):
        key = tuple(v.pieces[i].decode() for i in ids)
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(mass)
    for w, m in mass.items():
        p = m / total
        assert abs(seen.get(w, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_encode_pieces_frame(spark, vocabulary):
    docs = spark.createDataFrame([(k, t, "s", "l", 0.0, 1) for k, t in enumerate(TEXTS)] + [(None, None, None, None, None, None), (3, "hello world", "s", "l", 0.0, 1)], DOCS)
    out = encode_pieces(docs)
    rows = out.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 3}) == 1
    back = {r.doc_id: r.text for r in piece_lattice.decode_pieces(out).collect()}
    assert all(back[k] == t for k, t in enumerate(TEXTS))
    assert encode_pieces(docs.limit(0)).count() == 0


# -- token rollups


def test_rollup_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello there world", "a", "en", 0.0, 1), (2, None, "a", None, 0.0, 1), (3, "one two", None, "en", 0.0, 1), (3, "one two", None, "en", 0.0, 1)], DOCS)
    words = token_rollup.count_words(docs)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("load", token_rollup.signed(inserted=words)) and not rollup.commit("load", token_rollup.signed(inserted=words))
    state = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert state() == {("a", "en", "words"): (1, 3), ("a", None, "words"): (1, 0), (None, "en", "words"): (2, 4)}
    gone = words.where("doc_id = 2")
    old = words.where("doc_id = 1")
    rollup.commit("fix", token_rollup.signed(deleted=gone, revised=(old, old.withColumn("tokens", F.lit(10).cast("long")))))
    assert state() == {("a", "en", "words"): (1, 10), (None, "en", "words"): (2, 4)}
    (tmp_path / "r" / "_staged" / "broken").mkdir()
    want = {("a", "en", "words"): (1, 10), (None, "en", "words"): (2, 4)}
    assert state() == want
    with pytest.raises(ValueError):
        rollup.commit("../x", words)
    rollup.fold()
    assert state() == want and not rollup.commit("load", token_rollup.signed(inserted=words)) and state() == want
    assert rollup.commit("more", token_rollup.signed(inserted=gone)) and state() == want | {("a", None, "words"): (1, 0)}
    rollup.fold()
    assert rollup._folders("batch") == ["more"] and not rollup.commit("fix", token_rollup.signed(deleted=gone))
    assert state() == want | {("a", None, "words"): (1, 0)}
    # A second writer that has looked before the first one was done.
    assert rollup._put(*staged(tmp_path, "late")) and not rollup._put(*staged(tmp_path, "late"))


def staged(tmp_path, batch):
    folder = f"_staged/{batch}-{len(list((tmp_path / 'r' / '_staged').iterdir()))}"
    (tmp_path / "r" / folder).mkdir()
    return folder, f"batch={batch}"


def test_rollup_folds_by_itself(spark, tmp_path):
    words = token_rollup.count_words(spark.createDataFrame([(1, "one two", "a", "en", 0.0, 1)], DOCS))
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"), pending=2)
    for k in range(7):
        assert rollup.commit(f"b{k}", token_rollup.signed(inserted=words))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "words", 7, 14)] and len(rollup._folders("batch")) <= 4
    assert not any(rollup.commit(f"b{k}", token_rollup.signed(inserted=words)) for k in range(7))


def test_counting_edges(spark):
    frame = spark.createDataFrame([(1, None, None, None, 0.0, 1), (2, "", "a", "en", 0.0, 1), (2, "", "a", "en", 0.0, 1), (None, " " * 1_200_000 + "x", "a", "en", 0.0, 1)], DOCS).withColumn("tokens", F.lit("x")).withColumn("version", F.lit(1))
    got = [(r.doc_id, r.version, r.tokens) for r in token_rollup.count_tokens(frame).collect()]
    assert sorted(got[:3]) == [(1, "byte_bpe_50k", 0), (2, "byte_bpe_50k", 0), (2, "byte_bpe_50k", 0)] and got[3][2] > 1000
    assert token_rollup.count_tokens(frame.limit(0)).count() == 0 and token_rollup.count_words(frame).count() == 4


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [" " * 20_000 + "x", "a" + " " * 20_000, "a\n" + "\t " * 9000 + "\n1", "\u3000" * 12_000 + "b" + " " * 10_001 + "!" + "\n" * 10_000, "ab" * 50_000, " " * 10_000])
def test_long_runs_are_counted_whole(text):
    with open(token_rollup.BPE_RANKS, "rb") as f:
        encoding = token_rollup._encoding(f.read())
    assert token_rollup.tokens_of(text, encoding) == reference_tokenizer()(text)


def test_rollup_query_by_brute_force(spark, sf_dir):
    from tessella.llm.queries import op6_token_rollup

    count, words = reference_tokenizer(), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    toxic, poor = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = re.sub("[0-9]+", "", r.text) if r.doc_id in poor else r.text
        for version, n in (("byte_bpe_50k", count(text)), ("words", words(text))):
            if r.doc_id not in toxic:
                at = (r.source, r.lang, version)
                d, t = want.get(at, (0, 0))
                want[at] = d + 1, t + n
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in op6_token_rollup(spark, sf_dir).collect()} == want and toxic and poor - toxic


def test_token_counts_against_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    got = {r.doc_id: r.tokens for r in token_rollup.count_tokens(docs).collect()}
    assert got == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


# -- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>er<br>line &eacute;&#33;
<p>Two<ul><li>a<li>b</ul><script>var x = "</p><p>no";</script><!-- hidden --><form><input><label>Go</label></form>
<div id="comments"><p>First!</p></div><aside>Side</aside></article><footer>&copy; x</footer></body></html>"""


def test_extract_main():
    assert html_extract.extract_main(PAGE) == "Head & line One bolder line é! Two a b"
    assert html_extract.extract_main("") == "" and html_extract.extract_main("plain < text") == "plain < text"
    assert html_extract.extract_main("<p>open <b>tags <div>end") == "open tags end"
    assert html_extract.extract_main("<div><p>x</p></div><p><a href=/>only a link</a></p>") == "x"


def test_template_of_a_host(spark):
    page = lambda k: f"<html><body><div class=top>Welcome to the site</div><div class=body><p>Text number {k} of it</p></div><div class=end>Imprint and so on</div></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k), "x", "y") for k in range(8)] + [(20, "http://b.example/", page(20), "x", "y"), (21, None, None, "x", "y"), (None, "http://a.example/9", page(9), "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_text(frame).collect()}
    for k in range(8):
        assert got[k] == (f"Text number {k} of it", len(f"Text number {k} of it"))
    assert got[20][0] == "Welcome to the site Text number 20 of it Imprint and so on"  # one page gives no template
    assert got[21] == ("", 0) and got[None][0] == "Text number 9 of it"
    assert html_extract.extract_text(frame.limit(0)).count() == 0


def extracted(spark, pages):
    frame = spark.createDataFrame([(k, f"http://a.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_extract.extract_text(frame).collect()}


def test_template_decides_inside_articles(spark):
    got = extracted(spark, [f"<html><body><article><h1>Title {k}</h1><div class=q>Read more on our site</div><p>Text {k}</p></article></body></html>" for k in range(6)])
    assert got == {k: f"Title {k} Text {k}" for k in range(6)}
    copies = extracted(spark, ["<html><body><article><h1>One</h1><p>Two</p></article></body></html>"] * 4)
    assert set(copies.values()) == {"One Two"}  # copies of an article are no template


def test_template_of_repeated_elements(spark):
    menu = "<ul><li>Home page of us</li><li>All our news</li><li>All our news</li></ul>"
    foot = "<div><p>Made by us</p><p>Call or write</p></div>"
    got = extracted(spark, [f"<html><body>{menu}<section><p>Text {k}</p>{f'<p>More of {k}</p>' * (k % 3)}</section>{foot}</body></html>" for k in range(9)])
    assert got == {k: " ".join([f"Text {k}", *[f"More of {k}"] * (k % 3)]) for k in range(9)}


def test_template_keeps_order_and_nests(spark):
    pages = [f"<html><body>{('<p>One</p><p>Two</p>', '<p>Two</p><p>One</p>')[k % 2]}<h2>End of it</h2><div><p>Text {k}</p></div></body></html>" for k in range(6)]
    assert extracted(spark, pages) == {k: f"{('One Two', 'Two One')[k % 2]} Text {k}" for k in range(6)}  # One and Two change places
    crossed = html_extract._crossed
    assert crossed({1: [0, 5, 9], 2: [2, 3], 3: [4, 6]}, {1: 9, 2: 5, 3: 5}) == {3}  # 2 lies in a slot of 1, 3 does not
    assert crossed({1: [0, 1], 2: [2, 3]}, {1: 9, 2: 5}) == set()


def test_no_form_or_name_drops_an_article():
    main = html_extract.extract_main
    assert main("<body><form action=/><article><h1>Title</h1><p>All of the page is in a form.</p><form><label>Your name</label></form></article></form>") == "Title All of the page is in a form."
    assert main("<div class='layout has-sidebar'><article><p>Text of the article</p></article><div class=sidebar>Links</div></div>") == "Text of the article"
    assert main("<article><p>Some text of it</p><div class=adsbygoogle>Buy now</div></article>") == "Some text of it"


def test_article_text_is_not_dropped_by_name():
    main = html_extract.extract_main
    for odd in ("<div class='notice-board'><p>Of the board.</p></div>", "<div class=reply><p>A reply it was.</p></div>", "<p hidden>Not shown.</p>", "<p>Press <button>Go</button> now.</p>", "<p style='display:none'>Kept.</p>"):
        text = " ".join(re.sub("<[^>]*>", "", odd).split())
        assert main(f"<article><p>Much more text than that stands in this article, to be sure.</p>{odd}</article>") == f"Much more text than that stands in this article, to be sure. {text}"
    assert main("<p>Half of this text is <a href=/>a link to a page</a></p>") == "Half of this text is a link to a page"
    assert main("<article><p>Text</p><div class='cookie-notice'>No</div></article>") == "Text"


def test_main_slot_without_any_article(spark):
    words = lambda k, n: " ".join(f"w{(k * 31 + j * 7) % 97}" for j in range(n))
    page = lambda k: f"<html><body><div class=top><p>Buy {words(k, 4)}</p></div><div class=wrap><div class=content><h1>{words(k, 5)}</h1><p>{words(k + 3, 40)}</p><p>{words(k + 5, 30)} <a href=/>x</a></p></div><div class=more><p>{words(k + 9, 3)}</p></div></div><div class=end>{words(k + 2, 3)}</div></body></html>"
    got = extracted(spark, [page(k) for k in range(12)])
    assert got == {k: f"{words(k, 5)} {words(k + 3, 40)} {words(k + 5, 30)} x" for k in range(12)}
    lone = extracted(spark, [page(k) for k in range(2)])  # two pages agree on nothing
    assert lone[0].startswith("Buy ")


def test_the_template_alone_finds_the_articles_of_the_table(spark, monkeypatch):
    """Without article and main as evidence and without names, on hosts with enough pages."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    monkeypatch.setattr(html_extract, "MAIN", frozenset())
    monkeypatch.setattr(html_extract, "NAMES", re.compile("(?!)"))
    monkeypatch.setattr(html_extract, "INSIDE", re.compile("(?!)"))
    html_extract._attributes.cache_clear()
    hosts = {}
    for r in pages:
        hosts.setdefault(html_extract.host_of(r.url), []).append(r)
    right = total = 0
    for rows in (v for v in hosts.values() if len(v) >= 5):
        votes = Counter(html_extract.main_slot(r.html) for r in rows)
        slots = [s for s, n in votes.most_common() if s is not None and n >= 3 and 4 * n >= len(rows)]
        for r in rows:
            body = re.search("<article>(.*)</article>", r.html, re.S)[1]
            text = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", body))).split())
            right += html_extract.extract_main(r.html, None, slots) == text
            total += 1
    html_extract._attributes.cache_clear()
    print("template alone:", right, "of", total)
    assert total > 80 and right >= 0.9 * total, (right, total)


@pytest.mark.parametrize("deep", ["<div>{}" * 60_000, "<div class=notice>{}" * 60_000, "<b>{}<i>" * 30_000, "<li>{}" * 30_000 + "</x></b>" * 30_000, "<b>" * 30_000 + "<div>{}" * 30_000 + "</b>" * 30_000, "<p>{}<table>" * 20_000])
def test_deep_pages_take_linear_time(deep):
    import time

    t = time.perf_counter()
    text = html_extract.extract_main(deep.replace("{}", "x").replace("{}", ""))
    assert time.perf_counter() - t < 8 and set(text) <= {"x", " "}
    t = time.perf_counter()
    slot = html_extract.main_slot(deep.replace("{}", "x").replace("{}", ""))
    html_extract.extract_main(deep.replace("{}", "x").replace("{}", ""), None, [slot])
    assert time.perf_counter() - t < 16
    paths, blocks, marks = html_extract.read_page(deep.replace("{}", "word "))
    assert len(blocks) and len(html_extract.page_tokens(deep.replace("{}", "word "))) == len(paths) + len(blocks) + 1


def test_names_need_evidence():
    main = html_extract.extract_main
    assert main("<body><div class='post type-post tag-news'><p>A whole article of some length.</p><div class=share><a href=/>Tweet this</a></div></div></body>") == "A whole article of some length."
    assert main("<article><header class='entry-header'><h1>Title</h1></header><p>Some text of it.</p></article>") == "Title Some text of it."
    assert main("<article><div class='entry-header'><h1>Title</h1></div><p>Some text of it.</p><div class=comments-header><p>By</p></div></article>") == "Title Some text of it."
    assert main("<div class=notice>Small print</div><div><p>Text of the page and more of it</p></div>") == "Text of the page and more of it"
    assert main("<div class=menu><a href=/>a long list</a> <a href=/>of many links</a></div><p>Text</p>") == "Text"


def test_extract_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        import html

        text = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", body))).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)
