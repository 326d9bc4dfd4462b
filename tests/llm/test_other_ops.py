from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from longleaf.llm import ann, chat, common, graph, media, toxicity, wrapper


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 24)).astype(np.float32)
    v[10] = v[20] = v[30]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [1.0], 1), (1004, [None] * 24, 1), (50, v[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=5, block=200).collect()
    x = np.vstack([v, v[50:51]]).astype(np.float64)
    ids = np.array([*range(900), 50])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in [*range(0, 900, 50), 900]:
        cos = unit @ unit[q]
        cos[q] = -9
        want = sorted(zip(-cos.round(12), ids.tolist(), strict=True))[:5]
        mine = {(r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] == ids[q]}
        hits += sum((i, round(-c, 9)) in mine for c, i in want)
        total += 5
    assert len(got) == 19 * 5 and hits / total >= 0.99
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert len(ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()) == 2


def test_one_bit_search_sends_queries_in_rounds(spark):
    """A round holds one block of queries at least, and what is broadcast doesn't grow with blocks of queries times blocks of vectors."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(3).standard_normal((600, 16)))], "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 5 == 0
    rows = lambda d: sorted(map(tuple, d.collect()))
    once = ann.search(df, asks, block=50)
    assert rows(ann.search(df, asks, block=50, query_bytes=1)) == rows(once) and once.count() == 600


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    norm = np.sqrt(ann.in_order(v, v))
    turn = ann.rotation(64)
    about, bound = ann.estimates(turn @ (q / np.linalg.norm(q)), *ann.codes(v, norm, turn), 3.0)
    exact = v @ q / norm / np.linalg.norm(q)
    assert (np.abs(about - exact) <= bound).mean() > 0.99 and np.corrcoef(about, exact)[0, 1] > 0.7


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (None, 0, "ann", "lost"), (3, 0, None, "who"), (3, 0, None, "who")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r["conv_id"], r["part"], r["perspective"]): r for r in chat.perspectives(df).where("conv_id is not null").collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 1, "ann"), (1, 1, "bob"), (3, 0, "unknown")}
    r = got[1, 0, "ann"]
    assert r["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r["rendered"][s["start"] : s["stop"]] for s in r["mask"]] == ["hi"]
    assert [s["start"] == s["stop"] for s in got[1, 0, "bob"]["mask"]] == [True]
    assert got[3, 0, "unknown"]["n_turns"] == 2
    assert chat.perspectives(df).where("conv_id is null").count() == 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_repeated_turn_numbers_and_long_texts_are_rendered_in_pieces(spark):
    long = "word " * 200_000
    rows = [(1, 5, "ann" if i % 2 else "bob", f"t{i:04d}") for i in range(2500)] + [(2, 0, "ann", long), (2, 1, "bob", "ok")]
    got = chat.perspectives(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")).collect()
    one = sorted((r["piece"], r["n_turns"]) for r in got if r["conv_id"] == 1 and r["perspective"] == "ann")
    assert one == [(0, 1024), (1, 1024), (2, 452)]
    whole = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["piece"]))
    assert all(f"t{i:04d}" in whole for i in range(2500)) and whole.count("<|im_start|>assistant") == 1250
    r = next(r for r in got if r["conv_id"] == 2 and r["perspective"] == "ann")
    assert [r["rendered"][m["start"] : m["stop"]] for m in r["mask"]] == [long]


PAGE = '<html><head><title>t</title><style>x</style></head><body><header>Site</header><nav><ul><li>a</ul></nav><div class="ad">buy</div>{}<aside>s</aside><section class="comments"><p>first!</section><form>f</form><script>"</p>"</script><footer>&copy;</footer></body></html>'


@pytest.mark.parametrize("body,text", [
    ("<article><h1>T &amp; t</h1><p><b>One<br><p>two  <i>th</i>ree</article>", "T & t\n\nOne\n\ntwo three"),
    ('<div class="post-content"><p>a<p>b<ul><li>c<li>d</ul></div>', "a\n\nb\n\nc\n\nd"),
    ("<main><p>a<!-- no --><table><tr><td>1<td>2</table></main>", "a\n\n1\n\n2"),
    ("<div><div><p>long text here</p><p>and more</p></div></div>", "long text here\n\nand more"),
    ("", ""),
])
def test_main_text(body, text):
    assert wrapper.extract_page(PAGE.format(body), None) == text


@pytest.mark.parametrize("body,text", [
    ('<article id="part-1"><p>a</article><div><article id="part-2"><p>b</article></div>', "a\n\nb"),
    ('<div class="story-lead"><p>a</div><p>x<div class="story-body"><p>b<div class="story-text"><p>c</div></div>', "a\n\nb\n\nc"),
    ('<main id="m1"><p>a</main><main id="m2"><p>b</main>', "a\n\nb"),
    ('<article class="post tag-news"><p>a</article><article class="teaser"><p>t</article><article class="post"><p>b</article>', "a\n\nb"),
    ('<article class="related"><p>only</article>', "only"),
])
def test_all_marked_parts_are_the_article(spark, body, text):
    page = PAGE.format(body)
    assert wrapper.extract_page(page, None) == text
    assert wrapper.extract_page(page, wrapper.article(wrapper.fold(wrapper.parse(page)))) == text


def test_a_host_with_articles_in_parts(spark):
    rows = [(i, "http://h.org/", PAGE.format("".join(f'<article id="part-{k}"><p>{i} {k}</article>' for k in range(i)))) for i in range(1, 5)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(f"{i} {k}" for k in range(i)) for i in range(1, 5)}


def test_wrappers_of_hosts(spark):
    rows = [(i, f"http://H{i % 2}.org/{i}", PAGE.format(f"<article><h1>h{i}</h1>" + "<p>x</p>" * (i % 4) + "</article>"), "k") for i in range(20)] + [(20, None, None, "k"), (None, "http://h0.org", "<p>a</p", "k"), (3, "http://h1.org/", "", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"], r["n_chars"]) for r in wrapper.main_text(df).collect())
    want = [(i, "\n\n".join([f"h{i}"] + ["x"] * (i % 4))) for i in range(20)] + [(20, ""), (-1, "a"), (3, "")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    w = {r["host"]: r["wrapper"] for r in wrapper.wrappers(df).collect()}
    assert set(w) == {"h0.org", "h1.org", ""} and '"*"' in w["h0.org"]
    assert wrapper.main_text(df.limit(0)).count() == 0


def _unmarked(i):
    """A page without article, main or telling names: links, a slot for an advert, the story, a fixed line in it, terms."""
    story = "".join(f"<p>{' '.join(f's{i}p{k}w{j}' for j in range(12))}</p>" for k in range(1 + i % 3))
    return f'<div class="c1"><a href="/">Home</a> <a href="/n">News</a></div><div class="c2"><h1>Title {i}</h1>{"<p>By A</p>" if i % 2 else ""}{story}<p class="c9">Join our list today</p></div><div class="c3"><p>Terms apply to all of it</p><p>Made by hand</p></div>'


def test_slots_tell_the_article_and_the_template(spark):
    rows = [(i, f"http://h.org/{i}", _unmarked(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(9):
        want = [f"Title {i}", *(["By A"] if i % 2 else []), *(" ".join(f"s{i}p{k}w{j}" for j in range(12)) for k in range(1 + i % 3))]
        assert got[i] == "\n\n".join(want)
        assert wrapper.extract_page(rows[i][2], None) != got[i]  # the page alone does not tell


def test_pages_made_from_known_blocks_give_them_back(spark):
    """Eight hosts of their own templates, twelve pages each: the text is exactly the blocks that the page was made from."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    said = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(8):
        marked = h % 2 == 0
        tag = ("article", "main", "section", "div")[h % 4]
        own = f'{tag} class="{"x" + word()}"'
        links = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(5))
        terms, join = said(12), said(6)
        for i in range(12):
            blocks = [f"{said(3)} &amp; co", *(said(int(rng.integers(8, 30))) for _ in range(int(rng.integers(2, 6))))]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace(' ', chr(10), 1) if k % 2 else f'<b>{b}</b>'}</p>" for k, b in enumerate(blocks[1:]))
            if marked:
                body = f"<header>{body[: body.index('</h1>') + 5]}</header>{body[body.index('</h1>') + 5 :]}<aside>{said(9)}</aside><div class='share'>{said(4)}</div>"
            else:
                body += f"<p>{join}</p>"
            extra = f'<section class="comments"><p>{said(15)}</p></section>' if i % 3 == 0 else ""
            page = f"<html><head><title>{said(3)}</title></head><body><ul>{links}</ul><div class='ad'>{said(7)}</div><{own}>{body}</{tag}>{extra}<div><p>{terms}</p></div><footer>{said(3)}</footer></body></html>"
            want[len(rows)] = "\n\n".join(b.replace("&amp;", "&") for b in blocks)
            rows.append((len(rows), f"https://host{h}.org/{i}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert {r["page_id"]: r["text"] for r in wrapper.main_text(df).collect()} == want


def test_pages_that_repeat_one_article_keep_it(spark):
    rows = [(i, "http://h.org/", PAGE.format(f"<article><h1>One</h1><p>same text</p><p>again</p>{'<p>x' * (i % 2)}</article>")) for i in range(8)]
    got = {r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"One\n\nsame text\n\nagain", "One\n\nsame text\n\nagain\n\nx"}


def test_an_articles_own_header_stays_and_marked_parts_go():
    body = '<article><header><h1>Title</h1></header><p>body</p><p class="legal">small print</p><p class="notice">n</p><div class="share-links">s</div><footer>f</footer><section class="comments"><p>c</section></article>'
    assert wrapper.extract_page(PAGE.format(body), None) == "Title\n\nbody\n\nsmall print"


def test_deep_and_long_pages_are_read_whole(spark):
    deep = "<div>" * 30_000 + "<p>deep</p><aside>no</aside>" + "</div>" * 30_000
    long = "<article>" + "".join(f"<p>{k} {'w ' * 20}</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "http://a.org", deep), (2, "http://b.org", long), (3, "http://b.org", long), (4, "http://a.org", deep.replace("deep", "other"))]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id")).collect()}
    assert got[1] == "deep" and got[4] == "other" and got[2] == got[3] == "\n\n".join(f"{k} {'w ' * 20}".strip() for k in range(20_000))


def test_wrappers_survive_being_written():
    w = wrapper.fold(wrapper.parse(_unmarked(3)))
    assert wrapper.loads(wrapper.dumps(w)) == w


def test_alignment_makes_optional_and_repeated_groups():
    a, b = (wrapper.fold(wrapper.parse(x)) for x in ("<div><h1>a</h1><p>b</p><p>c</p></div>", "<div><h1>x</h1><ul><li>y</ul></div>"))
    merged = wrapper.merge(a, b)[5][0]
    assert [(c[0], c[2]) for c in merged[5]] == [("h1", "1"), ("p", "*"), ("ul", "?")]


def test_network_gradient():
    texts, labels = ["foo bar bad baz", "alpha beta", "", "bad " * 5], np.array([1, 0, 0, 1])
    x = toxicity.Inputs(texts, np.zeros(0, np.uint64))
    x.word = np.arange(len(x.hashes))
    p = {k: v.astype(np.float64) for k, v in toxicity._parameters(np.random.default_rng(0), np.zeros(len(x.hashes), np.float32)).items()}
    at, there = x.places(np.arange(len(x.text)))
    m = there[:, :, None].astype(np.float64)

    def loss(p):
        r = x.vectors(p).astype(np.float64)
        s = np.concatenate([toxicity._layer((r @ p["Wf"] + p["cf"])[at], m, p["Uf"]), toxicity._layer((r @ p["Wb"] + p["cb"])[at[::-1]], m[::-1], p["Ub"])[::-1]], axis=2)
        z = toxicity._pool(s, m, p)[3]
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    g = toxicity._learn(x, np.arange(len(x.text)), labels.astype(float), p)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.02, abs=1e-4), k


def test_toxic_words_are_learned_anywhere_in_a_text(spark):
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = rng.choice(plain, int(rng.integers(1, 260))).tolist()
        if i % 3 == 0:
            words.insert(int(rng.integers(len(words) + 1)), "vile")
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, "w1 " * 20000 + "Vile, w2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert 60 < len(held) < 180 and np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.97
    assert got[9001]["predicted"] == 1 and got[9000]["predicted"] == 0 and got[None]["held_out"] and 0 <= got[None]["score"] <= 1
    assert toxicity.keep_clean(docs, model).where("doc_id = 9001").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}


def test_layer_equals_scalar_recurrence():
    """One window, word by word, with the gates written out."""
    rng = np.random.default_rng(1)
    n = toxicity.STATE
    x, u = rng.standard_normal((9, 1, 3 * n)).astype(np.float32), rng.standard_normal((n, 3 * n)).astype(np.float32)
    h = [0.0] * n
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(9):
        a = [sum(h[i] * float(u[i, j]) for i in range(n)) for j in range(3 * n)]
        z = [sig(x[t, 0, j] + a[j]) for j in range(n)]
        r = [sig(x[t, 0, n + j] + a[n + j]) for j in range(n)]
        c = [np.tanh(x[t, 0, 2 * n + j] + r[j] * a[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
    assert np.allclose(toxicity._layer(x, np.ones((9, 1, 1), np.float32), u)[-1, 0], h, atol=1e-4)


def test_network_beats_its_word_odds(spark):
    """Texts are toxic where two words stand in one order, clean in the other: word odds tell nothing, the network does."""
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(3000):
        words = rng.choice(plain, 12).tolist()
        at = int(rng.integers(11))
        words[at : at + 2] = ("gorp", "zand") if i % 2 else ("zand", "gorp")
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).where("held_out").collect()}
    right = np.mean([r["predicted"] == rows[i][2] for i, r in got.items()])
    h, doc = toxicity.word_counts([t for _, t, _ in rows])
    label = np.array([x for _, _, x in rows])
    names, index = np.unique(h, return_inverse=True)
    toxic = np.bincount(index, label[doc])
    odds = toxicity.odds_of(toxic, np.bincount(index) - toxic, 1500, 1500)
    lexicon = np.zeros(3000)
    np.add.at(lexicon, doc, odds[index])
    guess = np.mean([(lexicon[i] >= np.median(lexicon)) == rows[i][2] for i in got])
    assert right > 0.9 > 0.65 > guess


def test_clean_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} {'vile' if i % 2 else 'kind'} w{i % 5}", i, "x", 0.5) for i in range(400)], "doc_id long, text string, id long, label string, score double")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2, "t") for i in range(400)], "doc_id long, toxic int, text string"))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(0, 400, 2))
    assert {(r["doc_id"] % 2, r["predicted"]) for r in toxicity.score(docs, model).collect()} == {(0, 0), (1, 1)}


def test_cropped_and_edited_copies_are_found(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(30):
        grey = np.kron(rng.integers(20, 235, (16, 16)), np.ones((3, 3)))
        rows.append((10 * i, media.encode(grey)))
        rows.append((10 * i + 1, media.encode(grey[3:, 2:] * 0.7 + 30)))
        rows.append((10 * i + 2, media.encode(grey)))
    rows += [(1000, None), (1001, b""), (1002, b"junk"), (1003, b"junk"), (None, rows[0][1]), (1004, media.encode(np.full((40, 40), 9.0)))]
    got = media.copies(spark.createDataFrame([(*r, 1) for r in rows], "media_id long, content binary, class_id int")).collect()
    classes = {r["media_id"]: r["class_id"] for r in got}
    assert len(got) == len(rows)
    assert all(classes[10 * i + k] == 10 * i for i in range(30) for k in range(3))
    assert [classes[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1000, 1001, 1002, 1002, 1004, 0]
    assert {r["media_id"]: r["class_size"] for r in got}[11] == 3 and {r["media_id"]: r["class_size"] for r in got}[0] == 4  # with the image without an id
    assert media.copies(spark.createDataFrame([], "media_id long, content binary")).count() == 0


def turned(grey, degrees):
    """A copy turned about its middle, by linear interpolation."""
    high, wide = grey.shape
    t, cy, cx = np.deg2rad(degrees), (high - 1) / 2, (wide - 1) / 2
    y, x = np.mgrid[0:high, 0:wide]
    sy, sx = cy + (y - cy) * np.cos(t) - (x - cx) * np.sin(t), cx + (y - cy) * np.sin(t) + (x - cx) * np.cos(t)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    at = lambda i, j: np.where((i >= 0) & (i < high) & (j >= 0) & (j < wide), grey[np.clip(i, 0, high - 1), np.clip(j, 0, wide - 1)], 128)
    return at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x0 + 1) * (1 - fy) * fx + at(y0 + 1, x0) * fy * (1 - fx) + at(y0 + 1, x0 + 1) * fy * fx


EDITS = {
    "turned by 17 degrees": lambda g: turned(g, 17),
    "turned by 8 degrees": lambda g: turned(g, 8),
    "turned by 90 degrees": np.rot90,
    "half as large": lambda g: g.reshape(g.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)),
    "cropped": lambda g: g[12:-8, 10:-20],
    "darker": lambda g: g * 0.7 + 20,
    "noisy": lambda g: g + np.random.default_rng(1).normal(0, 4, g.shape),
}


@pytest.mark.parametrize("edit", EDITS.values(), ids=EDITS)
def test_edited_copies_are_found(spark, edit):
    """40 images and an edited copy of each: nine in ten copies join their original, and no two originals meet."""
    rng = np.random.default_rng(17)
    greys = [np.kron(rng.integers(20, 235, (16, 16)), np.ones((6, 6))) for _ in range(40)]
    rows = [(2 * i + k, media.encode(f(g))) for i, g in enumerate(greys) for k, f in enumerate((lambda g: g, edit))]
    classes = {r["media_id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()}
    assert sum(classes[2 * i + 1] == 2 * i for i in range(40)) >= 36 and all(classes[2 * i] == 2 * i for i in range(40))


def test_classes_equal_those_of_all_pairs(spark):
    """60 images, among them copies that share corners with each other only: classes are those of brute force over all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        grey = np.kron(rng.integers(20, 235, (20, 20)), np.ones((5, 5)))
        rows += [(5 * i + k, media.encode(grey[a:b, c:d])) for k, (a, b, c, d) in enumerate([(0, 60, 0, 60), (0, 60, 30, 100), (30, 100, 30, 100), (40, 100, 0, 60), (10, 90, 10, 90)])]
    owner, keys, places, bits = media.describe([c for _, c in rows])
    side = lambda i: (np.array([(owner == i).sum()]), keys[owner == i], places[owner == i], bits[owner == i])
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(60):
        for j in range(i):
            if len(media.agreeing(*media.matches(*side(i), *side(j), 16), 4, 6)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["media_id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()}
    assert got == {i: root(i) for i in range(60)}


def test_a_group_of_copies_is_one_class(spark):
    rng = np.random.default_rng(8)
    grey = np.kron(rng.integers(20, 235, (24, 24)), np.ones((3, 3)))
    rows = [(i, media.encode(grey[i : 60 + i, 2 * i : 58 + 2 * i] * (1 - i / 20) + 5 * i), "x") for i in range(6)]
    got = media.copies(spark.createDataFrame(rows, "media_id long, content binary, node string")).collect()
    assert {(r["media_id"], r["class_id"], r["class_size"]) for r in got} == {(i, 0, 6) for i in range(6)}


def test_a_large_image_is_read_whole(spark):
    rng = np.random.default_rng(12)
    grey = np.kron(rng.integers(20, 235, (150, 200)), np.ones((6, 6)))
    rows = [(1, media.encode(grey)), (2, media.encode(grey[-200:, -220:])), (3, media.encode(rng.integers(0, 255, (60, 60)).astype(float)))]
    assert {(r["media_id"], r["class_id"]) for r in media.copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_images_meet_whatever_others_have_their_words(spark, monkeypatch):
    place = lambda y, x: y << 32 | x << 8
    rows = [(n, k, place(10 * k + n, 9 * k + 2 * n)) for n in (501, 502) for k in range(1, 6)]  # agree in words that 100 smaller nodes have too
    rows += [(n, k, place(n * k * 37 % 4001, n * n * k * 53 % 3989)) for n in range(100, 200) for k in range(1, 6)]
    rows += [(n, 100 + k, place(10 * k + n, 7 * k)) for n in (3, 4, 5) for k in range(6)]
    rows += [(6, k, place(10 * k, 10 * k)) for k in (9, 10, 11, 12)] + [(7, k, place(50, 50)) for k in (9, 10, 11, 12)]  # four places against one
    points = spark.createDataFrame([(*r, 0, 0) for r in rows], "node long, key long, place long, low long, high long")
    apart = points.withColumn("low", F.when(F.col("node") == 5, (1 << 17) - 1).otherwise(0))  # 17 bits off
    for block in (media.BLOCK, 7):
        monkeypatch.setattr(media, "BLOCK", block)
        for table, rest in ((points, {3, 4, 5}), (apart, {3, 4})):
            tables = common.Tables(spark)
            got = {}
            for r in graph.components(media.linked_images(table, tables, 4, 6, 16), tables).collect():
                got.setdefault(r["comp"], set()).add(r["node"])
            assert sorted(got.values(), key=min) == [rest, {501, 502}]


def test_rare_words_leave_out_fewer_places_than_a_link_needs():
    assert media.rare_words([1, 2, 3, 4, 5], [10, 20, 30, 40, 50], 4) == 2
    assert media.rare_words([1, 9, 9, 9, 9], [1, 2, 3, 4, 5], 4) == 5
    assert media.rare_words([1, 2, 3, 4], [7, 7, 8, 9], 4) == 0
