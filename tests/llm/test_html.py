"""Block cutting by hand-made pages; the labeller by accuracy on pages it hasn't seen."""

import numpy as np
import pytest

from meshlark.llm import html_blocks as H


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;</p>", ["a & b <c> é"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- y --> z", ["x z"]),
        ("<head><title>t</title></head><body><p>x</body>", ["x"]),
        ("<p title='a>b'>x</p><p title=\"y>\">z", ["x", "z"]),
        ("1 < 2 <p>3 <b>4<i>5</b></p><table><tr><td>6<td>7<tr><td>8</table>", ["1 < 2", "3 45", "6", "7", "8"]),
        ("<p>a</p><script>never closed <p>b", ["a"]),
        ("<!-- never closed <p>b", []),
        ("<script>if (a<b) f(); x='</p>';</script><article><p>Main text.</p>", ["Main text."]),
        ("<SCRIPT>a<b</ScRiPt ><p>x", ["x"]),
        ("<p a='>x</p><p>y", ["x", "y"]),
        ("a <b", ["a <b"]),
        ("a < b <p>c", ["a < b", "c"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in H.leaf_blocks(page)] == want


@pytest.mark.parametrize("unit", ["<a ", "<p a=\"", "<script>", "<svg>", "<!--", "<div>x", "</div>", "<li><div>", "<![CDATA[", "<", "</", "<head>", "&amp", "<td><div>"])
def test_time_grows_with_length_alone(unit):
    import time

    took = []
    for size in (300_000, 1_200_000):
        page = unit * (size // len(unit))
        began = time.process_time()
        H.vectors(H.leaf_blocks(page))
        took.append(time.process_time() - began)
    assert took[1] < 0.5 or took[1] < 8 * took[0], took


def test_pages_written_by_hand():
    from . import pages

    net, both, extra, lost = H.trained(), 0, 0, 0
    for name, page in pages.PAGES.items():
        blocks = H.leaf_blocks(page)
        for p, good in zip(net.label([H.vectors(blocks)])[0], pages.marked(name, [b.text for b in blocks]), strict=True):
            both, extra, lost = both + (p >= 0.5 and good), extra + (p >= 0.5 and not good), lost + (p < 0.5 and good)
    assert both >= 0.95 * (both + lost) and both >= 0.95 * (both + extra)


def test_gradients():
    net = H.Labeller(1)
    r = np.random.default_rng(0)
    x, mask = r.standard_normal((5, 3, H.DIM)).astype(np.float32), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    x[3:, 1] = 0
    y = (r.random((5, 3)) > 0.5).astype(np.float32)

    def loss():
        p = net.probabilities(x, mask).astype(np.float64)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for name in ("wxf", "whf", "bf", "wxb", "whb", "wo", "bo"):
        v = net.p[name].reshape(-1)
        k = int(np.abs(g[name].reshape(-1)).argmax())
        old = v[k]
        v[k] = old + 1e-2
        up = loss()
        v[k] = old - 1e-2
        down = loss()
        v[k] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name].reshape(-1)[k], rel=0.05, abs=1e-4), name


def test_all_words_of_a_block_count():
    first, later = [f"a{k}" for k in range(64)], [f"b{k}" for k in range(200)]
    x = H.vectors(H.leaf_blocks(f"<p>{' '.join(first + later)}</p><p>{' '.join(first + later[::-1])}</p><p>{' '.join(first)}</p>"))[:, H.PATH_DIM : H.PATH_DIM + H.WORD_DIM]
    want = np.bincount([H._slot(w, H.WORD_DIM) for w in first + later], minlength=H.WORD_DIM) / 264
    assert np.allclose(x[0], want) and np.allclose(x[1], want) and not np.allclose(x[2], want)


def test_unseen_pages():
    net = H.trained()
    right = total = 0
    for k in range(100):
        page, marks = H.practice_page(10**9 + k)
        p = net.label([H.vectors(H.leaf_blocks(page))])[0]
        right += int(((p >= 0.5) == np.array(marks)).sum())
        total += len(marks)
    assert right >= 0.98 * total


def test_extract(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>First  words here.</p><p>More &amp; more.</p></article><div class='comments'><p>nice post</p></div><footer>copyright</footer></body></html>"
    rows = [(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5)]
    got = sorted(map(tuple, H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    text = "Title\nFirst words here.\nMore & more."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_article_of_sf001(spark):
    """In these pages the article element has the main text."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in df.collect()}
    wrong = 0
    for r in H.extract(df).collect():
        want = "\n".join(b.text for b in H.leaf_blocks(html[r["page_id"]]) if any(x.startswith("article") for x in b.path))
        wrong += r["text"] != want
    assert wrong <= 2
