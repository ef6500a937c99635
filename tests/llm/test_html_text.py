import itertools
import random

from rasterway.llm import html_text as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy this</div>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First   para<br><p>Second &lt;b&gt; <i>it</i>alic &#233;</p><p>Sh.</p>
<aside>side</aside><form>name <input></form></article><div id="comments"><p>reader says something very long indeed here</p></div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert op.main_text(PAGE) == "Title & more First para Second <b> italic é Sh."


def test_without_article_tag():
    long = "Running text of an article goes on and on for many words, as it does in a page of news. "
    page = f"<body><div><a href=a>menu one</a></div><div>tiny</div><div><a href=b>menu two</a></div><div>x</div><div>y</div><p>{long}</p><p>short one.</p><p>{long}</p><div><a href=c>m</a></div><div><a href=c>m</a></div><div>z</div></body>"
    text = op.main_text(page)
    assert text.startswith("Running") and "short one." in text and "menu" not in text and "z" not in text.split()


def test_surge_and_dive():
    assert op.spans_of([0, 5, 0, 0, 200, 3, 90, 0, 0, 4, 0]) == [(4, 7)]
    assert op.spans_of([]) == []


def test_windows_decide_beside_and_inside_articles():
    long = "Running text of an article goes on and on for many words, as it does in a page of news. "
    teasers = "".join(f"<article><h3>Teaser {i}</h3></article><div><a href=m>more</a></div>" for i in range(3))
    links = "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li><li><a href=c>three</a></li></ul>"
    assert op.main_text(f"<body><div><p>{long}</p><p>{long}</p></div>{links}{teasers}</body>") == (long * 2).strip()
    readers = f"<article class='comment'><p>A reader. {long * 3}</p></article>"
    assert op.main_text(f"<body><div><p>{long}</p></div>{readers}</body>") == long.strip()
    # A list of links makes the windows dive inside an article too.
    assert op.main_text(f"<article><h1><a href=t>Title</a></h1><p>{long}</p><p>Sh.</p>{links}</article><p>{long}</p>") == f"Title {long}Sh."


def test_marks_of_wrappers_do_not_hold():
    story = "Running text of an article goes on and on for many words, as it does in a page of news."
    for mark in ("class='content no-sidebar'", "id='page-widget'", "class='widget'", "class=search"):
        assert op.main_text(f"<div {mark}><article><p>{story}</p></article></div><p>Short</p>") == story
        assert op.main_text(f"<div {mark}><div class='share'>Share it</div><p>{story}</p></div>").endswith(story)
        assert op.main_text(f"<div {mark}><div {mark}><p>{story}</p><p>{story}</p></div></div>") == f"{story} {story}"
    assert op.main_text(f"<article><p>{story}</p><div class='share-price'>It fell.</div><section id='related-work'>Others.</section></article>") == f"{story} It fell. Others."
    # Marks of parts hold, also where readers write more than the article has.
    rest = f"<div class='sidebar widget'><p>{story}</p></div><ol class='comment-list'><li>{story * 4}</ol><div class='site-footer'>me</div>"
    assert op.main_text(f"<article><p>Short story.</p></article>{rest}") == "Short story."
    assert op.main_text(f"<p>{story}</p><p>{story}</p>{rest}") == f"{story} {story}"
    assert op.main_text("<div class='cookie-banner'>We use cookies</div>") == ""


def test_attributes_are_read_by_name():
    story = "Running text of an article goes on and on for many words, as it does in a page of news."
    for a in ('title="hidden gem"', 'data-id="share"', 'aria-hidden="false"', "data-class='sidebar'", 'alt="class=menu"', "data-style='display:none'"):
        assert op.main_text(f"<article><p>{story}</p><p {a}>Also {story}</p></article>") == f"{story} Also {story}"
    for a in ("hidden", "HIDDEN=''", "style='color:red; display: none'", 'CLASS="sidebar"', "id = share"):
        assert op.main_text(f"<article><p>{story}</p><p {a}>Also {story}</p></article>") == story
    # A letter that grows in lower case does not move the end of a script.
    assert op.main_text(f"<p>{'İ' * 30}</p><script>x</SCRIPT ><p>{story}</p>").endswith(story)
    assert op.main_text(f"<article><script>a</scripture></script><p>{story}</p></article>") == story


def test_spans_equal_plain_windows():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 3, 8, 15, 40, 90, 200]) for _ in range(rng.randint(0, 30))]
        over = [sum(x for k, x in enumerate(lengths) if abs(k - i) <= op.WINDOW // 2) > op.SURGE for i in range(len(lengths))]
        want = []
        for on, run in itertools.groupby(range(len(lengths)), lambda i: over[i]):
            run = list(run)
            strong = [i for i in run if lengths[i] >= op.SHORT]
            if on and strong:
                want.append((strong[0], strong[-1] + 1))
        assert op.spans_of(lengths) == want


def plain_article(blocks, links):
    """Kept words of an article of paragraphs (None: a link in a list), by windows of three written out."""
    n = len(blocks)
    weight = [0 if b is None else len(b) for b in blocks]
    window = [sum(weight[k] for k in (i - 1, i, i + 1) if 0 <= k < n) for i in range(n)]
    least = min(op.SURGE, max(window, default=0) / 2)
    edge = min(op.SHORT, max(weight, default=0))
    keep = set()
    for i in range(n):
        if window[i] > least:  # the surge around i, as far as windows have text
            lo = hi = i
            while lo > 0 and window[lo - 1] > least:
                lo -= 1
            while hi < n - 1 and window[hi + 1] > least:
                hi += 1
            strong = [k for k in range(lo, hi + 1) if weight[k] >= edge]
            if strong:
                lo, hi = strong[0], strong[-1]
                while lo > 0 and window[lo - 1] > 0:
                    lo -= 1
                while hi < n - 1 and window[hi + 1] > 0:
                    hi += 1
                text = [k for k in range(lo, hi + 1) if weight[k]]
                keep.update(range(text[0], text[-1] + 1))
    return " ".join(links[k] if blocks[k] is None else blocks[k] for k in sorted(keep))


def test_whole_articles_equal_plain_windows():
    rng = random.Random(4)
    windows = 0
    for _ in range(400):
        blocks = [rng.choice([None, None, "a", "short one", "words of a line " * rng.randint(1, 3), "running text " * rng.randint(4, 20)]) for _ in range(rng.randint(1, 25))]
        blocks = [b and b.strip() for b in blocks]
        links = [f"link {i}" for i in range(len(blocks))]
        body = "".join(f"<ul><li><a href=x>{links[i]}</a></li></ul>" if b is None else f"<p>{b}</p>" for i, b in enumerate(blocks))
        page = f"<body><nav><a href=a>Home</a></nav><div>Menu</div><article>{body}</article><div>tail</div></body>"
        if sum(len(b or "") for b in blocks) < 20:
            continue
        want = plain_article(blocks, links)
        assert op.main_text(page) == want
        windows += want != " ".join(b or links[i] for i, b in enumerate(blocks))
    assert windows > 100  # windows, not the tag, decide


def test_short_pages_and_ends_of_texts():
    story = "Running text of an article goes on and on for many words, as it does in a page of news."
    # Without articles: title, first and last short paragraphs are siblings of the surge.
    page = f"<div id=nav><a href=a>m</a></div><div>Menu of things</div><div><h1>Hi</h1><p>Oh no.</p><p>{story}</p><p>{story}</p><p>The end.</p></div><div>Home</div><div>x</div>"
    assert op.main_text(page).endswith(f"Hi Oh no. {story} {story} The end.") and "Home" not in op.main_text(page)
    # A short page has the same rule: no menu comes back with it.
    assert op.main_text("<p>He said.</p><p>Go.</p><p>Now.</p><div>Home</div><div>Menu</div>") == "He said. Go. Now."
    assert op.main_text("<article><p>He said.</p></article><div>Home</div><div>Menu</div>") == "He said."
    assert op.main_text("<div><a href=a>Home</a></div><div><a href=b>Menu</a></div>") == ""
    # One-character blocks at the start of an article, and a paragraph that is a link at its end.
    assert op.main_text(f"<article><p>A</p><p>B</p><p>{story}</p><p><a href=s>Source</a></p></article>") == f"A B {story} Source"


def test_readers_words_in_nested_articles():
    story = "Running text of an article goes on and on for many words, as it does in a page of news."
    assert op.main_text(f"<article><p>{story}</p><article><p>I read it. {story}</p></article></article>") == story
    assert op.main_text(f"<main><article><p>{story}</p><section><article>Me too, at length: {story * 3}</article></section><p>End.</p></article></main>") == f"{story} End."
    assert op.main_text(f"<article><p>{story}</p><div id='user-reviews'><p>{story * 2}</p></div></article>") == story
    # A frame around the only story is not one of readers.
    assert op.main_text(f"<article><article><p>{story}</p></article></article>") == story


def test_cut_and_odd_markup():
    assert op.main_text(None) == op.main_text("") == op.main_text("<html><body></body>") == ""
    assert op.main_text("<article><p>one <b>two</p><p>three") == "one two three"
    assert op.main_text("<article><p>one</p><p cla") == "one"
    assert op.main_text("<article>a < b and c > d &am</article>") == "a < b and c > d &am"
    assert op.main_text("<article>x<script>never closed") == "x"
    assert op.main_text("<article><p>" + "w " * 100000 + "</p></article>") == " ".join(["w"] * 100000)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article>é\n x</article>", "old", 3), (1, "u", "<article>é\n x</article>", "old", 3), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((r.page_id or 0, r.text, r.n_chars) for r in op.extract(df).collect())
    assert out == [(0, "", 0), (1, "é x", 3), (1, "é x", 3)]
    assert op.extract(df.limit(0)).collect() == []
