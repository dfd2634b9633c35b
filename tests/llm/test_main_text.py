import numpy as np
import pytest

from intelweave.llm import main_text, page_layouts
from intelweave.llm.html_blocks import Paths, blocks_of
from intelweave.llm.recurrent import Labeller

SCHEMA = "page_id long, url string, html string, id int, text string, n_blocks string, h int"


def table(spark, pages):
    return spark.createDataFrame([(*p, 7, "t", "n", 7) for p in pages], SCHEMA)


def texts(html):
    return [t for t, _, _ in blocks_of(html, Paths())]


def path_of(paths, node):
    out = []
    while node:
        out.append(" ".join(paths.tokens[node]))
        node = paths.parent[node]
    return " < ".join(out)


@pytest.mark.parametrize("html,want", [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("a < b <3", ["a < b <3"]), ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<div>x<p>y</p>z</div>", ["x", "y", "z"]), ("<p>one\n two&nbsp; <br>three<b>four", ["one two threefour"]),
    ("<script>var a='<p>no</p>'</script><p>yes</p><style>p{}", ["yes"]), ("<script>never ends <p>x</p>", []),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]), ("<head><title>t</title><meta a=b></head><body>b</body>", ["b"]),
    ("<head><title>t<body><p>b", []), ("<head><title>t</title><body><p>b", ["b"]), ("<p title='a > b'>x</p><p title=\"it's\">y", ["x", "y"]),
    ("<p class=\"open>x</p>", ["x"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]), ("</div></p>x</p>", ["x"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("&lt;p&gt; &#8364; &#x41; &am &quo &amp", ["<p> € A &am &quo &"]), ("<p>x<", ["x<"]), ("<p>x</", ["x</"]), ("<p>x</p", ["x"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_paths_and_links():
    paths = Paths()
    html = '<body><div class="main-Content x1" id=top role="main"><p>a <a href=x>link</a> b</p><ul><li>c<li>d</ul><h2>e</h3><p>f'
    found = blocks_of(html, paths)
    assert [(t, k) for t, _, k in found] == [("a link b", 4), ("c", 0), ("d", 0), ("e", 0), ("f", 0)]
    div = "div .1 .content .main .top .x < body"
    assert [path_of(paths, node) for _, node, _ in found] == [f"p < {div}", f"li < ul < {div}", f"li < ul < {div}", f"h2 < {div}", f"p < {div}"]


def test_long_and_deep_pages_are_linear():
    assert texts("<div>" * 20000 + "x" + "</div>" * 20000 + "<p>y" * 20000)[:2] == ["x", "y"]
    assert len(texts("<a " * 30000)) <= 1 and len(texts("<" * 100000)) == 1


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = Labeller(5, 3, 2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    lengths = np.array([4, 2, 1])
    x, y = rng.standard_normal((7, 5)), rng.integers(0, 2, 7)

    def loss():
        z, _ = net.forward(x, lengths)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    z, state = net.forward(x, lengths, keep=True)
    grads, dx = net.gradients(x, 1 / (1 + np.exp(-z)) - y, state)
    for values, grad in [*((net.p[k], grads[k]) for k in net.p), (x, dx)]:
        for at in list(np.ndindex(values.shape))[::3]:
            held, step = values[at], 1e-5
            values[at] = held + step
            up = loss()
            values[at] = held - step
            down = loss()
            values[at] = held
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5


def test_sequences_do_not_touch_each_other():
    rng = np.random.default_rng(3)
    net = Labeller(4, 3, 2)
    x = rng.standard_normal((9, 4)).astype(np.float32)
    all_at_once, _ = net.forward(x, np.array([5, 3, 1]))
    alone = [net.forward(p, np.array([len(p)]))[0] for p in (x[:5], x[5:8], x[8:])]
    assert np.allclose(all_at_once, np.concatenate(alone), atol=1e-6)


def article(i, rng):
    said = page_layouts.Dresser([], 1000 + i)
    body = [said.text(10, 60) for _ in range(rng.integers(2, 9))]
    head = said.text(2, 8)
    html = (f"<html><head><title>{head}</title></head><body><nav><ul><li><a href=/a>{said.text(1, 2)}</a></li></ul></nav><div class=ad>{said.text(4, 12)}</div><article><h1>{head}</h1>"
            + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>&copy; {said.text(3, 9)}</footer></body></html>")
    return html, "\n\n".join([head, *body])


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    return main_text.train(table(spark, [(i, f"http://x/{i}", article(i, rng)[0]) for i in range(60)]))


def test_held_out_layouts(model):
    dresser, right, blocks, whole = page_layouts.Dresser([], 77), 0, 0, 0
    for _ in range(200):
        paths = Paths()
        found, labels = page_layouts.labelled(dresser.page(), paths)
        same = (model.scores([found], paths)[0] >= 0.5) == np.array(labels, bool)
        right, blocks, whole = right + same.sum(), blocks + len(same), whole + same.all()
    assert right / blocks >= 0.985 and whole >= 170


def test_articles_of_the_sampled_layout_are_exact(spark, model):
    rng = np.random.default_rng(9)
    pages = [(i, f"http://y/{i}", *article(500 + i, rng)) for i in range(200)]
    rows = main_text.extract(table(spark, [p[:3] for p in pages]), model).collect()
    want = {p[0]: p[3] for p in pages}
    assert sum(r.text == want[r.page_id] for r in rows) >= 198


NOISE = {
    "comments": "<section class=comments><div class=comment><p>{}</p></div><div class=comment><p>{}</p></div></section>",
    "aside": "<aside><h3>{}</h3><p>{}</p></aside>", "notice": "<div class=cookie-notice><p>{}</p><p>{}</p></div>",
    "form": "<form><label>{}</label><p>{}</p></form>", "sidebar": "<div class=sidebar><p>{}</p><p>{}</p></div>",
    "header": "<header><h1>{}</h1><p>{}</p></header>", "advert": "<div class='sponsored ad'>{}<p>{}</p></div>", "menu": "<div class=menu><a>{}</a><a>{}</a></div>",
}


@pytest.mark.parametrize("kind", NOISE)
def test_parts_besides_the_article_are_left_out(model, kind):
    rng, good = np.random.default_rng(6), 0
    for i in range(40):
        html, want = article(900 + i, rng)
        said = page_layouts.Dresser([], 5000 + i)
        part = NOISE[kind].format(said.text(5, 40), said.text(5, 40))
        html = html.replace("<article>", part + "<article>") if kind in ("header", "notice", "menu") else html.replace("</article>", "</article>" + part)
        paths = Paths()
        blocks = blocks_of(html, paths)
        good += "\n\n".join(t for (t, _, _), p in zip(blocks, model.scores([blocks], paths)[0]) if p >= 0.5) == want
    assert good >= 36


def test_odd_pages_have_defined_results(spark, model):
    long = "<article>" + "<p>some words, and more of them. </p>" * 30000 + "</article>"
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<nav>x</nav>"), (3, "u", "<p>"), (3, "u", "<p>"), (4, "u", long), (5, "u", "\x00<\ud7ff")]
    rows = main_text.extract(table(spark, pages), model).collect()
    by = {(str(r.page_id), str(r.url)): r for r in rows}
    assert len(rows) == len(pages) and rows[0].asDict().keys() == {"page_id", "url", "text", "n_blocks", "n_kept"}
    assert by["1", "u"].text == "" and by["2", "None"].text == "" and by["3", "u"].n_blocks == 0
    assert by["4", "u"].n_blocks == 30000 and by["4", "u"].n_kept >= 29900
    assert main_text.extract(table(spark, []), model).count() == 0


def test_training_is_the_same_again_and_needs_no_rows(spark):
    a, b = (main_text.train(table(spark, [(1, None, None)]), drawn=30) for _ in range(2))
    assert all((a.net.p[k] == b.net.p[k]).all() for k in a.net.p)


def test_batches_change_nothing(spark, model, monkeypatch):
    rng = np.random.default_rng(8)
    pages = table(spark, [(i, "u", article(i, rng)[0]) for i in range(30)])
    want = sorted(map(str, main_text.extract(pages, model).collect()))
    monkeypatch.setattr(main_text, "_TOGETHER", 3000)
    assert sorted(map(str, main_text.extract(pages.repartition(3), model).collect())) == want
