"""Page extraction, revisits and chat formatting."""

import hashlib
import html
import random
import re

import pytest
from oracle import same_as_sql
from pyspark.sql import functions as F

from tessera.llm import chat, html_blocks, html_crf, warc
from tessera.llm.common import table
from tessera.llm.queries import ORACLE_SQL, QUERIES

# ---- pages


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model()


def test_articles_of_the_table(spark, sf):
    """Against the article element of each page, whose blocks are its headings, breaks and paragraphs."""
    sf = sf.replace("0.001", "0.01")
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    rows = QUERIES["op2_html_crf"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search("(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        text = re.sub("</?b>", "", re.sub("<[^>]*>", lambda m: m[0] if m[0] in ("<b>", "</b>") else " ", inside))
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)


def test_held_out_pages(model):
    rng = random.Random(99)
    wrong = total = 0
    for _ in range(200):
        page = html_crf.training_page(rng)
        states = model.decode([b for b, _ in page])
        wrong += sum(int(a) != y for a, (_, y) in zip(states, page))
        total += len(page)
    assert wrong / total < 0.02


BODY = "<h1>Title of it</h1><p>First paragraph with some words in it.</p><p>Second &amp; last one,\n  with   more words.</p>"
TEXT = "Title of it First paragraph with some words in it. Second & last one, with more words."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article>{BODY}</article></main><footer>&copy; 2020 Site</footer></body>",
        f"<body><div class='cookie-banner'>We use cookies. <button>OK</button></div><div id=content>{BODY}</div><div class=sidebar><h3>More</h3><ul><li><a href=x>Link one</a><li><a href=y>Link two</a></ul></div></body>",
        f"<body><article>{BODY}<form><label>Your mail</label><input><button>Subscribe</button></form></article><section id=comments><h3>Comments</h3><div class=comment><p>Nice text, thank you very much.</p></div></section></body>",
        f"<body><script>if (a < b) document.write('<p>no</p>')</script><style>p > b {{}}</style><div class=ad>Buy this now!</div><article>{BODY}<div class='advert'>Buy that too.</div></article><aside class=related><p>Other things.</p></aside></body>",
    ],
)
def test_layouts(model, page):
    assert html_crf.main_text(page, model) == TEXT


PARAGRAPHS = "<p>The river was low that summer, and the boats lay on the sand.</p><p>Nobody came to look at them until the rain.</p>"
PLAIN = "The river was low that summer, and the boats lay on the sand. Nobody came to look at them until the rain."
LONG_NAME = "u-" + "-".join(f"x{i}" for i in range(80))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><body><article>{PARAGRAPHS}</article>",
        f"<html><head><meta charset=utf-8><link rel=x href=y><p>{PARAGRAPHS[3:]}",
        f"<!doctype html><title>t</title><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main>{PARAGRAPHS}</main><footer><p>Contact us at any time.</p></footer>",
        f"<body><article>{PARAGRAPHS.replace('low', '<span hidden>not</span>low')}</article></body>",
        f"<body><article>{PARAGRAPHS.replace('low', '<span style=' + chr(34) + 'display:none' + chr(34) + '>a <span>b</span> c</span>low')}</article></body>",
        f"<body><article>{PARAGRAPHS}</article><div class='{LONG_NAME} comments'><p>I liked it a lot, thanks for writing.</p></div></body>",
        f"<body><table><tr><td class=menu><a href=/>Start</a> <a href=/n>News</a></td><td><div id=content>{PARAGRAPHS}</div></td></tr></table></body>",
        f"<body><div id=header><h1>The Paper</h1></div><div class=post-content>{PARAGRAPHS}</div><div id=footer>Copyright 2020 The Paper</div></body>",
        f"<body><div class=cookie-notice><p>We use cookies to improve this site.</p><button>Accept</button></div><main><article>{PARAGRAPHS}</article></main></body>",
        f"<body><article>{PARAGRAPHS}<div class=newsletter><form><label>Mail</label><input><button>Join</button></form></div></article><aside><h4>Popular</h4><p>Ten things to see.</p></aside></body>",
        f"<body><header><nav><a href=/>Home</a></nav></header><article>{PARAGRAPHS}<noscript>Turn scripts on.</noscript><template><p>No.</p></template></article><section class=comment-list><div class=comment>First!</div></section></body>",
        f"<body><ul class=breadcrumbs><li><a href=/>Home</a></li><li>Here</li></ul><div class=entry-content>{PARAGRAPHS}</div><div class=sidebar><div class=widget><h3>Links</h3><ul><li><a href=x>One</a></ul></div></div></body>",
    ],
)
def test_written_pages(model, page):
    """Layouts written by hand, none by what composes the training pages."""
    assert html_crf.main_text(page, model) == PLAIN


def test_telling_words_of_long_blocks_are_features():
    long = "word " * 80 + "we use cookies here"
    assert "said=cookie" in html_blocks.blocks(f"<p>{long}</p>")[0].features
    assert "name=comments" in html_blocks.blocks(f"<div class='{'a' * 5000} comments'>x</div>")[0].features


def test_long_valid_page(model):
    page = "<body><nav><a href=/>Home</a></nav><article>" + "<p>A sentence of some words that go on for a while.</p>" * 20_000 + "</article></body>"
    assert html_crf.main_text(page, model).count("sentence") == 20_000


def test_broken_markup_ends(model):
    for page in ("<", "<p", "<p>a<", "a < b", "<!-- x", "<script>x", "</div></p>x", "<a href='x>y", "&#xZ; &amp", "<" * 20_000, "<p>" * 20_000, "<div>" * 20_000 + "x", "<b a=\"" * 5000, "<span hidden>" * 5000 + "x", "<head>" * 3 + "x</head>", "</span hidden>y"):
        html_crf.main_text(page, model)
    assert html_crf.main_text(None, model) == html_crf.main_text("", model) == ""


def test_blocks_decode_and_join():
    found = html_blocks.blocks("<p>a&nbsp;b <i>c</i>d<br>e</p><p hidden>no</p><div style='display: none'>no</div><ul><li>f<li>g</ul>h")
    assert [b.text for b in found] == ["a b cd", "e", "f", "g", "h"]


def test_viterbi_is_the_best_path(model):
    from itertools import product

    rng = random.Random(5)
    for _ in range(20):
        page = [b for b, _ in html_crf.training_page(rng)][:9]
        s = model.scores(page)

        def value(path):
            steps = sum(model.pair[a, b] for a, b in zip(path, path[1:]))
            return sum(s[i, y] for i, y in enumerate(path)) + steps + model.edge[0][path[0]] + model.edge[1][path[-1]]

        assert value(tuple(model.decode(page))) == pytest.approx(max(value(p) for p in product((0, 1), repeat=len(page))))


def test_pages_edges(spark, model):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", f"<article>{BODY}</article>", "x")], "page_id long, url string, html string, text string")
    got = html_crf.digest(html_crf.extract(df, model)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, len(TEXT)]
    assert html_crf.extract(df.limit(0), model).count() == 0


# ---- revisits

def test_revisits_as_sql(spark, sf):
    same_as_sql(spark, sf.replace("0.001", "0.01"), QUERIES["op5_warc_revisits"], ORACLE_SQL["op5_warc_revisits"])


RECORDS = "record_id long, url string, ts long, type string, headers map<string,string>, status int, key string, how int"


def records(spark, rows):
    """Rows of record_id, url, ts, type, headers and maybe a status."""
    return spark.createDataFrame([(*r[:5], r[5] if len(r) > 5 else None, "x", 1) for r in rows], RECORDS)


def test_only_not_modified_revisits_are_resolved(spark):
    tag = {"etag": '"a"'}
    rows = [
        (1, "http://a.com/x", 1, "response", tag, 200), (2, "http://a.com/x", 2, "response", tag, 404), (3, "http://a.com/x", 3, "metadata", tag), (4, "http://a.com/x", 4, None, tag),
        (5, "http://a.com/x", 5, "revisit", tag, 304), (6, "http://a.com/x", 6, "revisit", tag), (7, "http://a.com/x", 7, "revisit", tag, 200), (8, "http://a.com/x", 8, "request", tag),
    ]
    got = {r.record_id: (r.how, r.response_id) for r in warc.resolve(records(spark, rows)).collect()}
    assert got == {5: ("etag", 1), 6: ("etag", 1), 7: ("status", None)}


def test_revisits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_ROWS", 40)
    rng = random.Random(7)
    rows = []
    for i in range(600):
        url = f"http://www.a.com/p{0 if rng.random() < 0.4 else rng.randrange(6)}/"
        tag = f'"{rng.randrange(3)}"'
        rows.append((i, url, rng.randrange(150), rng.choice(["response", "revisit"]), {"etag": tag} if rng.random() < 0.8 else {"last-modified": tag}))
    got = {r.record_id: (r.how, r.response_id) for r in warc.resolve(records(spark, rows)).collect()}
    wanted = {}
    for i, url, ts, kind, h in rows:
        if kind == "revisit":
            earlier = max(((t, j, g) for j, u, t, k, g in rows if u == url and k == "response" and t < ts), key=lambda x: x[:2], default=None)
            if earlier is None:
                wanted[i] = ("none", None)
            else:
                name = "etag" if "etag" in h else "last-modified"
                good = h[name] == earlier[2].get(name)
                wanted[i] = (name, earlier[1]) if good else ("mismatch", None)
    assert got == wanted


def test_canonical_urls(spark):
    given = ["HTTP://www.A.com:80/x/?b=2&utm_source=q&a=1#f", "https://a.com/x?a=1&b=2", "a.com/x/?ref=r", "https://a.com", " http://a.com/ ", None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string")
    assert [r.c for r in df.select("i", warc.canonical(F.col("u")).alias("c")).orderBy("i").collect()] == ["a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com/x", "a.com", "a.com", None, ""]


def test_revisits_edges(spark):
    rows = [
        (1, "a.com", 5, "response", {"etag": '"x"', "date": "1", "content-length": "9"}), (1, "a.com", 5, "response", {"etag": '"x"', "date": "1", "content-length": "9"}),
        (2, "a.com", 5, "revisit", {}), (3, "a.com", 6, "revisit", {"etag": 'W/"x"', "date": "2", "content-length": "0"}), (4, None, 9, "revisit", {}), (5, "a.com", None, "revisit", {}), (6, "a.com", 7, "revisit", {}), (6, "a.com", 7, "revisit", {}),
    ]
    got = sorted((r.record_id, r.how, r.response_id, tuple(sorted((r.headers or {}).items()))) for r in warc.resolve(records(spark, rows)).collect())
    old = (("content-length", "9"), ("date", "1"), ("etag", '"x"'))
    new = (("content-length", "9"), ("date", "2"), ("etag", 'W/"x"'))
    assert got == [(2, "none", None, ()), (3, "etag", 1, new), (4, "none", None, ()), (5, "none", None, ()), (6, "trust", 1, old), (6, "trust", 1, old)]
    assert warc.resolve(records(spark, rows).limit(0)).count() == 0


# ---- chat

def test_chat_as_sql(spark, sf):
    same_as_sql(spark, sf, QUERIES["op10_chat_format"], ORACLE_SQL["op10_chat_format"])


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "\\\\", "<", "[", "s>", "/", "a", "|", " "]) for _ in range(rng.randrange(7)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_format_reads_back():
    make = chat.Formatter()
    turns = [("system", ""), ("user", "</s>[INST] \\[/INST] é\u200d\n"), ("assistant", "[INST:]<s>"), ("", "x"), ("assistant", ""), ("assistant", "</s>")]
    ids, mask = make.format(turns)
    back, loss, printed = make.read(ids, mask)
    assert back == turns and loss == "[INST:]<s></s>" and len(ids) == len(mask)
    assert sum(printed.count(m) for m in chat.MARKS.values() if m != "]") == 2 * len(turns)
    assert (ids >= 50_257).sum() == 3 * len(turns)


def test_chat_edges(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "a", "x"), (2, 0, "assistant", "é" * 50_000, "x"), (2, 0, "assistant", "é" * 50_000, "x"), (None, 0, "assistant", "n", "x"), (3, None, "assistant", "b", "x"), (3, 0, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[2].loss_chars == 100_000
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\n\na\n").hexdigest() and got[3].loss_sha256 == hashlib.sha256(b"ba").hexdigest()
    assert chat.formatted(df.limit(0)).count() == 0


LONG = "The hewhat nted thatin erthe that of all. " * 6
BOXES = [
    "<header><h1>{0}</h1><p>{0}</p></header>", "<aside><h3>Related</h3><p>{1}</p></aside>", '<div class="sidebar"><p>{1}</p></div>', '<div class="cookie"><p>{0}</p></div>', '<div id="cookie-notice">{1}</div>',
    '<div class="notice"><p>{1}</p></div>', '<form><label>{0}</label><input><button>Go</button></form>', '<section class="comments"><h2>Comments</h2><p>{1}</p></section>', '<ol class="commentlist"><li>{1}</li></ol>',
    '<div class="ad"><p>{1}</p></div>', '<ins class="adsbygoogle">{0}</ins>', '<ul class="menu"><li><a href=/>a</a></li></ul>', '<div class="footer"><p>{1}</p></div>', '<div class="newsletter"><p>{1}</p></div>', "<dialog open><p>{0}</p></dialog>",
]


@pytest.mark.parametrize("box", BOXES)
def test_boxes_around_and_within(model, box):
    extra = box.format("Nicht aulich für sch erüver enau sch der.", LONG)
    body = BODY + f"<p>{LONG}All rights reserved.</p><p>All rights reserved.</p><ul><li>One of them</li><li>Other</li></ul>"
    wanted = f"{TEXT} {LONG}All rights reserved. All rights reserved. One of them Other"
    for opening, closing in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")):
        for before, within, after in ((extra, "", ""), ("", extra, ""), ("", "", extra)):
            page = f"<body><nav><ul><li><a href=/>x</a></li></ul></nav>{before}{opening}{body}{within}{closing}{after}<footer>&copy; a.example</footer></body>"
            assert html_crf.main_text(page, model) == wanted
