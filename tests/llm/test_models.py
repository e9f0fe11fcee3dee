"""The parts that are trained or encoded: labeller, tries, the pipeline."""

import numpy as np
import pytest

import brute
import corpus_pipeline
from nearfield.llm import htmlblocks
from nearfield.llm.eliasfano import EliasFano, Trie
from nearfield.llm.queries import QUERIES


def test_leaves_of_broken_pages():
    page = '<!-- <p>no</p> --><title>t</title><script>var t="</p>";</script><p>a &amp;amp; <b>b</b>\n c<p>d<br>e</div><ul><li>x<li>y &nbsp; z</ul><textarea>q</textarea>tail'
    assert [b.text for b in htmlblocks.leaves(page)] == ["a &amp; b c", "d e", "x", "y z", "tail"]
    assert htmlblocks.leaves("") == [] and htmlblocks.leaves("<p") != [None]
    assert [b.text for b in htmlblocks.leaves("<script>open forever <p>x")] == []


def test_leaves_without_optional_tags():
    def texts(page):
        return [b.text for b in htmlblocks.leaves(page)]

    head = '<html><head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var a="<p>";</script><noscript>n</noscript><link href="x">\n'
    assert texts(head + "<p>article</p><p>more") == ["article", "more"]
    assert texts(head + "article <b>in</b> bare text<p>more") == ["article in bare text", "more"]
    assert texts(head + "<body><p>article") == texts(head + "</head><body><p>article") == texts(head + "</head><p>article") == ["article"]
    for empty in ('<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<math />", '<svg\ndata-x="a>b" />'):
        assert texts(f"<p>before {empty}after</p><p>next</p><svg><path d=''/>no</svg><p>last</p>") == ["before after", "next", "last"]
    assert texts("<p>a</p><svg><g/><svg/>no</svg><math>x</math><p>b</p>") == ["a", "b"]
    model = htmlblocks.trained()
    story = "<article>" + "<p>The river went on past the old town.</p>" * 5 + "</article>"
    assert htmlblocks.extract(model, [head + story])[0].count("river") == htmlblocks.extract(model, [f"<body><svg/>{story}</body>"])[0].count("river") == 5


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = htmlblocks.BiLstm(width=5, hidden=3)
    m.w = {k: w.astype(np.float64) for k, w in m.w.items()}
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1.0, 1, 1, 1], [1, 1, 0, 0]])
    y = np.array([[1.0, 0, 1, 0], [0, 1, 0, 0]])
    _, grad = m.gradients(x, mask, y)
    for k, w in m.w.items():
        at = tuple(rng.integers(s) for s in w.shape)
        held, step = w[at], 1e-3
        w[at] = held + step
        up = m.gradients(x, mask, y)[0]
        w[at] = held - step
        down = m.gradients(x, mask, y)[0]
        w[at] = held
        assert grad[k][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_labeller_held_out():
    model = htmlblocks.trained()
    pages = [htmlblocks.labelled(*p) for p in htmlblocks.training_pages(120, seed=77)]
    got = np.concatenate(model.label([x for x, _ in pages])) == np.concatenate([y for _, y in pages])
    assert got.mean() > 0.97


def deep_page(outer: str, levels: int = 12) -> str:
    story = " ".join(f"river{chr(97 + i % 26)} word" + "." * (i % 9 == 8) for i in range(2500))
    replies = "".join('<div class="item level depth"><p>I quite agree with what was said above.</p>' for _ in range(levels)) + "</div>" * levels
    return f'<html><head><title>t</title></head><body><article><h1>A story of rivers</h1><p>{story}</p><p>It ends where it began, by the sea.</p></article><section class="{outer}">{replies}</section></body></html>'


def test_features_read_whole_blocks_and_paths():
    last = [htmlblocks.features(htmlblocks.leaves(deep_page(c)))[-1] for c in ("comments", "article")]
    assert (last[0] != last[1]).any()
    short, long = (htmlblocks.features(htmlblocks.leaves(f"<p>{'word ' * 400}{tail}</p>"))[0] for tail in ("word " * 4600, "other 12345 " * 2300))
    bins = slice(htmlblocks.PATH, htmlblocks.PATH + htmlblocks.WORD)
    assert (short[bins] > 0).sum() == 1 and (long[bins] > 0).sum() == 3
    assert short[htmlblocks.PATH + htmlblocks.WORD + 4] == 0 < long[htmlblocks.PATH + htmlblocks.WORD + 4]


def test_long_block_stays_and_deep_comments_go():
    for outer in ("comments", "sidebar", "footer"):
        text = htmlblocks.extract(htmlblocks.trained(), [deep_page(outer)])[0]
        assert len(text.split()) == 4 + 5000 + 8 and "agree" not in text


def test_labeller_on_tables(spark, sf):
    rows = {r["page_id"]: r["text"] for r in QUERIES["op3_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    wrong = [r["page_id"] for r in pages if rows[r["page_id"]] != brute.article(r["html"])]
    assert len(rows) == len(pages) and wrong == []


@pytest.mark.parametrize("page", ["<a " * 333_000, "<p x='" * 170_000, "<p x='>" * 150_000, "<p x=\"" * 170_000 + ">", "<div>" * 200_000, "<div>" * 90_000 + "</div>" * 90_000, "<div>" * 100_000 + "</p>" * 100_000, "<" * 1_000_000, "<svg>" * 200_000, "<select><script>" * 60_000, "<!--" * 250_000, "&" * 1_000_000])
def test_a_megabyte_of_broken_markup(page):
    import time

    model = htmlblocks.trained()
    start = time.process_time()
    htmlblocks.extract(model, [page])
    assert time.process_time() - start < 2


def test_open_quotes_end_with_their_tag():
    def texts(page):
        return [b.text for b in htmlblocks.leaves(page)]

    assert texts('<p title="x>first block</p><p class="y">second</p>') == ["first block", "second"]
    assert texts('<p title="x>only block') == ["only block"]
    assert texts('<p title="a > b" class=c>kept</p>') == ["kept"]
    assert texts("<p data-x='a > b'>one</p><p don't>two</p>") == ["one", "two"]
    assert texts('<a title="x"class="y">no space</a>') == ["no space"]
    assert texts("1 < 2 </ 3 <p>x") == ["1 < 2 </ 3", "x"]
    assert texts("<p>kept</p><select><option>a<p>b") == ["kept", "a", "b"] and texts("<p>kept<p <b") == ["kept"]


def test_extraction_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>", "x"), (2, "u", "<article>" + "<p>words of a story that goes on.</p>" * 3000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmlblocks.main_text(df).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmlblocks.main_text(df.limit(0)).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (10, 3), (1000, 10**6), (5000, 50), (20_000, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano.encode(v)
        assert (e.access(np.arange(n)) == v).all()
        q = np.r_[v, rng.integers(0, top + 5, 100)]
        at = e.find(q, np.zeros(len(q), int), np.full(len(q), n))
        held = set(v.tolist())
        assert all((a >= 0) == (x in held) and (a < 0 or v[a] == x) for a, x in zip(at, q.tolist()))
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([3, 2]))


def test_trie_of_four_levels(tmp_path):
    rng = np.random.default_rng(1)
    v, tokens = 50, rng.zipf(1.5, 4000) % 50
    grams = [np.arange(v)[:, None]]
    grams += [np.unique(np.stack([tokens[i : len(tokens) - k + 1 + i] for i in range(k)], 1), axis=0) for k in (2, 3, 4)]
    probs, backs = [rng.normal(size=len(g)) for g in grams], [rng.normal(size=len(g)) for g in grams[:-1]]
    Trie.write(str(tmp_path), grams, probs, backs, 16)
    trie = Trie(str(tmp_path))
    assert isinstance(trie.prob[0], np.memmap)
    where = [{tuple(r): i for i, r in enumerate(g.tolist())} for g in grams]
    for k, g in enumerate(grams):
        q = np.concatenate([g, rng.integers(0, v + 2, (2000, k + 1))])
        assert trie.lookup(q).tolist() == [where[k].get(tuple(r), -1) for r in q.tolist()]
    q = np.concatenate([grams[3], rng.integers(0, v, (2000, 4))])
    got, matched = trie.score(q[:, :3], q[:, 3])
    for row, value, length in zip(q.tolist(), got, matched):
        want, m = 0.0, 3
        while tuple(row[3 - m :]) not in where[m]:
            context = tuple(row[3 - m : 3])
            want += backs[m - 1][where[m - 1][context]] if context in where[m - 1] else 0
            m -= 1
        want += probs[m][where[m][tuple(row[3 - m :])]]
        assert length == m + 1 and value == pytest.approx(want, abs=2e-3)


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == docs.columns
        frames.append(spark.createDataFrame(out.collect(), docs.schema))
    quality, single, cut, mixed = ([(r["doc_id"], r["text"]) for r in f.collect()] for f in frames[1:])
    assert all(not brute.quality_base(t)[5] for _, t in quality) and len(quality) > 0.6 * docs.count()
    groups = brute.simhash(quality)
    assert sorted(i for i, _ in single) == sorted({c for _, _, c in groups})
    left = {i: t for i, t in cut}
    before = {i: t for i, t in single}
    for i, n, gone, _ in brute.substring(single):
        assert len(brute.words(left[i])) == n - gone and (gone or left[i] == before[i])
    assert {i for i, _ in mixed} <= set(left)
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == len(mixed) and "ids" in final.columns
