import pytest

from sightline.llm import html as h

from ..conftest import DATA


@pytest.fixture(scope="module")
def forest(spark):
    return h.train(spark)


def read(forest, page):
    return h.main_texts([page], forest)[0]


def test_pages_of_the_tables(spark, forest):
    import html
    import re

    rows = h.extract(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet"), forest).collect()
    wrong = 0
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        inside = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inside))
        wrong += r["text"] != " ".join(html.unescape(inside).split())
    assert wrong == 0


def test_held_out_layouts(forest):
    right = found = wanted = 0
    for page in h.made_pages(120, seed=99):
        tree = h.survey(page)
        labels, chosen = h.labels(tree), h.decode(tree, forest.likely(tree.features))
        for label, kept, text in zip(labels, chosen, tree.texts, strict=True):
            right += len(text) * (label == 1 and kept)
            found += len(text) * kept
            wanted += len(text) * (label == 1)
    assert right / found > 0.95 and right / wanted > 0.9


def test_no_contradictions(forest):
    for page in h.made_pages(60, seed=5):
        tree = h.survey(page)
        chosen = h.decode(tree, forest.likely(tree.features))
        for k, up in enumerate(tree.parents):
            # Below content only content or what is dropped; nothing is content again below what was dropped.
            if chosen[k] and up >= 0 and not chosen[up]:
                above = up
                while above >= 0:
                    assert not chosen[above]
                    above = tree.parents[above]


def test_markup_of_all_kinds(forest):
    page = (
        "<html><head><title>t</title><script>if (a<b) document.write('</p><p>no')</script><style>p{}</style></head><body>"
        "<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class='cookie-notice'>We use cookies.<button>OK</button></div>"
        "<article><h1>Title &amp; more</h1><!-- <p>no</p> --><p>First <b>bold</b>text&nbsp;with   space\n<p>Second &#233;&lt;x&gt;<br>line</p>"
        "<div class='ad'>Buy this now.</div><ul><li>one<li>two</ul><p>Last one, with a comma.</article>"
        "<section class=comments><div class=comment><p>Great article, thanks.</p></div></section><footer>&copy; me</footer></body></html>"
    )
    assert read(forest, page) == "Title & more First boldtext with space Second é<x> line one two Last one, with a comma."


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav><a href=/>x</a></nav>", "<p", "</p></div>", "<!-- x", "<script>never closed"])
def test_pages_without_text(forest, page):
    assert read(forest, page) == ""


def test_deep_and_long_pages(forest):
    assert isinstance(read(forest, "<div>" * 5000 + "x" + "</div>" * 5000), str)
    body = "".join(f"<p>Sentence number {i}, with some words in it.</p>" for i in range(4000))
    assert read(forest, f"<nav><a>m</a></nav><article>{body}</article><footer>f</footer>").count("Sentence") == 4000


def test_other_columns_and_repeats(spark, forest):
    rows = spark.createDataFrame([(1, "<article><p>a b c, d.</p></article>", "old"), (1, "<article><p>a b c, d.</p></article>", "old"), (None, None, None)], "page_id long, html string, text string")
    got = h.extract(rows, forest).collect()
    assert len(got) == 3 and len({(r["page_id"], r["text"]) for r in got}) == 2
    assert h.extract(rows.limit(0), forest).isEmpty()


ARTICLE = "<article><h1>Title</h1><p>First sentence, with some words in it.</p><p>Second sentence, with some more words.</p></article>"
SAID = "Title First sentence, with some words in it. Second sentence, with some more words."


def spoken(node):
    return " ".join("".join(f" {spoken(p)} " if isinstance(p, h.Node) else " " if p is None else p if isinstance(p, str) else p[0] for p in node.parts).split())


@pytest.mark.parametrize(("picture", "said"), [("<svg class='i'/>", ""), ("<svg/>", ""), ("<math display='block' />", ""), ("<svg><svg><a/></svg><text>x</text></svg>", "x"), ("<svg><svg/><text>x</text></svg>", "x"), ("<svg><svg></svg></svg>", ""), ("<svg><style>.a{}</style></svg>", ""), ("<svg><text>x", "x")])
def test_text_of_and_after_foreign_elements(picture, said):
    for page in (f"<body>{picture}<div>{ARTICLE}</div></body>", f"<p>{picture}</p>{ARTICLE}"):
        assert spoken(h.parse(page)) == f"{said} {SAID}".strip()


@pytest.mark.parametrize("depth", [10, 160, 1000])
def test_an_advert_is_left_out_however_deep(forest, depth):
    body = "<div>" * depth + ARTICLE[9:-10] + "<div class='ad'>Buy this product now, it is cheap.</div>" + "</div>" * depth
    assert read(forest, f"<nav><a href=/>Home</a></nav><article>{body}</article><footer>foot</footer>") == SAID


def test_text_of_all_elements_but_code_is_read(forest):
    extra = "<p>Let <math><mi>x</mi></math> be, and <svg><text>y</text></svg> too, here.</p><noscript><p>Shown without scripts, that is.</p></noscript><xmp><b>as it stands, all of it</b></xmp>"
    page = f"<nav><a href=/>Home</a></nav><article>{ARTICLE[9:-10]}{extra}<script>no()</script><style>p{{}}</style><p>The end, after all of that.</p></article><footer>foot</footer>"
    assert read(forest, page) == f"{SAID} Let x be, and y too, here. Shown without scripts, that is. <b>as it stands, all of it</b> The end, after all of that."


@pytest.mark.parametrize("hidden", ["", " hidden", " style='display: none'"])
def test_hidden_text_of_an_article_is_judged_like_other_text(forest, hidden):
    page = f"<nav><a href=/>Home</a></nav><article>{ARTICLE[9:-10]}<p{hidden}>A third sentence, with a few words more.</p><p>And the last one, of some length.</p></article><footer>foot</footer>"
    assert read(forest, page) == f"{SAID} A third sentence, with a few words more. And the last one, of some length."


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<!--", "<div>", "</x>", "<p></x>", "</title ", "<title>", "<script>", "<svg>", "<![CDATA[", "<a b='\"", "< ", "<ul><li>", "<td></p>"])
def test_reading_costs_as_much_as_the_page_is_long(piece):
    import time

    start = time.perf_counter()
    h.survey("<article>" + piece * (1_000_000 // len(piece) // 8))
    h.parse("<article>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_end_tags_close_their_own_blocks_however_deep():
    deep = "<div>" * 400 + "<p>x<p>y" + "</div>" * 400
    root = h.parse(f"<main><div class='wrap'>{deep}<p>after</p></div><p>outside</p></main>")
    main = root.parts[0]
    wrap, outside = main.parts
    assert main.tag == "main" and wrap.tag == "div" and outside.parts == ["outside"]
    assert wrap.parts[-1].tag == "p" and wrap.parts[-1].parts == ["after"]


def test_broken_markup():
    assert spoken(h.parse("a < b, 1 <2 <p>c</p")) == "a < b, 1 <2 c"
    assert spoken(h.parse("<p>a<!--->b<!-- x --!>c<!>d</>e</ x>f<?y?>g")) == "abcdefg"
    assert spoken(h.parse("<p title='a>b' data-x = \"c>d\">e</p><a href=\"x>f</a>")) == "e f"
