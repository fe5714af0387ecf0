import random
import re

from lexhound.llm.html_text import (
    BAD, BRIEF, GOOD, LONG, MOST_LINKED, NEAR, SHORT, STOP_SHARE, STOP_TIMES, STOPS_HIGH, STOPS_LOW, Block, densities, extract, judge, main_text, read, settle,
)

STORY = "The river was low that year, and the people of the town had to carry water from the old well in the hills, which took them most of the day."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p {{}}</style></head><body>
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav></header>
<div class="cookie-notice"><p>We and our partners use cookies to give you the best of the web. Please accept all of them.</p></div>
<article><h1>A dry year</h1><p>{STORY}</p><p>Short &amp; plain.</p><!-- <p>hidden</p> --><p>{STORY.replace("river", "<b>lake</b>  in\n the &eacute;ast")}</p></article>
<aside class="sidebar"><p>Read also of the other things that have been in the news of the week and of the day before.</p></aside>
<div id="comments"><p>I was there and it was not like that at all, for the well is new and the hills are far.</p></div>
<form><label>Name</label><input></form><footer><p>All rights of the site are with the owners of it and with those that they name.</p></footer></body></html>"""


def test_article():
    assert main_text(PAGE).split("\n") == ["A dry year", STORY, "Short & plain.", STORY.replace("river", "lake in the éast")]


def test_hostile():
    for page in ("", None, "<", "<<<<" * 1000, "<p", "</p></div>" * 100, "<script>", "<!--", "<div>" * 5000, "&amp;" * 1000, "<a href='x>" * 50, "plain text of no tags"):
        assert isinstance(main_text(page), str)
    assert main_text(f"<p>{STORY}") == STORY
    assert main_text("<article>" + f"<p>{STORY}</p>" * 20_000 + "</article>") == "\n".join([STORY] * 20_000)
    assert main_text(f"<article><p>{STORY * 5_000}</p></article>") == STORY * 5_000


def test_frames(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r["url"] or "", r["text"]) for r in got.collect()) == [("", ""), ("u", main_text(PAGE)), ("u", main_text(PAGE)), ("v", "")]
    assert extract(df.limit(0)).count() == 0


def test_languages_without_stop_words():
    story = "Następnego ranka rolnik wrócił na pole i zobaczył, że deszcz zniszczył całe zbiory, a woda z rzeki zalała drogę do miasteczka. "
    links = "".join(f'<a href="/{k}">Wiadomości lokalne numer {k}</a> ' for k in range(9))
    for body in (story, story * 2):
        page = f"<html><body><nav><a href='/'>Strona</a></nav><p>{body}</p><p>{body}</p><div>{links}</div><footer><p>{story}</p></footer></body></html>"
        assert main_text(page) == "\n".join([body.strip()] * 2)
    # a page with a block of a known language is judged as before
    assert main_text(f"<p>{STORY * 2}</p><p>{story * 2}</p>") == STORY * 2


def test_self_closed_svg_and_math():
    for empty in ('<svg class="a>b" />', "<math/>", "<SVG width='1'/>"):
        assert main_text(f"<article><p>{STORY}</p>{empty}<p>{STORY}</p></article>") == f"{STORY}\n{STORY}"
        assert main_text(f"<article><p>{STORY}</p>{empty}<p>{STORY}</p><svg><path d='M0'/><text>no</text></svg></article>") == f"{STORY}\n{STORY}"
    assert main_text(f"<article><p>{STORY}<svg><g/><text>no</text></svg></p></article>") == STORY


LINKS = "<nav><a href='/'>Home</a><a href='/a'>About</a></nav>"


def test_containers_do_not_decide_alone():
    both = f"{STORY}\n{STORY}"
    two = f"<p>{STORY}</p><p>{STORY}</p>"
    # a wrapper of an outside name, around an article or not
    assert main_text(f"<body>{LINKS}<div class='has-sidebar'><article>{two}</article><div class='sidebar'><p>{STORY[:90]}</p></div></div>") == both
    assert main_text(f"<body>{LINKS}<div id='social-contract'>{two}</div><footer><p>{STORY}</p></footer>") == both
    assert main_text(f"<form id='page'>{LINKS}{two}</form>") == both
    # an article that is not where the prose is
    assert STORY * 2 in main_text(f"<article><p>Teaser text.</p></article><div><p>{STORY * 2}</p><p>{STORY * 2}</p></div>")
    # comments that are longer than the article, and an advert that is
    assert main_text(f"<article>{two}</article><div id='comments'>{two * 9}</div>") == both
    assert main_text(f"<article><p>Short.</p></article><div class='ad'><p>{STORY}</p></div>") == "Short."
    assert main_text(f"<article><header><h1>A title</h1><p>By someone</p></header><p>{STORY * 2}</p></article>") == f"A title\n{STORY * 2}"


def test_without_containers():
    """Length, links and stop words decide where a page says nothing of its parts."""
    plain = f"<div><a href='/'>Home</a></div><div>Short one.</div><div>{STORY * 2}</div><div>Between.</div><div>{STORY * 2}</div><div><a href='/x'>{STORY}</a></div>"
    assert main_text(plain) == f"{STORY * 2}\nBetween.\n{STORY * 2}"
    # the same lengths without stop words among sentences go
    words = " ".join(f"zork{k}" for k in range(50))
    assert main_text(f"<div>{STORY * 2}</div><div>{STORY * 2}</div><div>{words}</div>") == f"{STORY * 2}\n{STORY * 2}"
    # unless the page is of nothing else
    assert main_text(f"<div>{words}</div><div><a href='/'>Home</a></div>") == words
    assert main_text("<p>Hello world</p>") == "Hello world"
    russian = "Река в том году была мелкой, и людям города приходилось носить воду из старого колодца в горах, на что уходила большая часть дня."
    japanese = "その年は川の水位が低く、町の人々は山の中にある古い井戸から水を運ばなければならず、それに一日の大半を費やしていた。そして冬が来るまで誰も雨を見ることはなく、畑は乾いたままであった。"
    for text in (russian, japanese):
        assert main_text(f"{LINKS}<p>{text}</p><p>{text}</p>") == f"{text}\n{text}"


def test_links_hold_through_blocks():
    assert main_text(f"<a href='/x'><div>{STORY}</div><p>{STORY}</p></a><p>{STORY * 2}</p>") == STORY * 2
    # an anchor without a target is none, and characters count as they are read
    assert main_text(f"<p><a name='x'>{STORY * 2}</a></p>") == STORY * 2
    page = read(f"<p>{'&amp;' * 30}<a href='/'>{'&amp;' * 10}</a></p>")
    assert [(len(b.text), b.linked) for b in page.blocks] == [(40, 10)]


def test_silent_and_optional_tags():
    both = f"{STORY}\n{STORY}"
    for empty in ("<iframe src='a'>", "<iframe src='a'/>", "<video src='a'>", "<object data='x'>", "<canvas>", "<select>", "<textarea/>", "<noscript>"):
        assert main_text(f"<article><p>{STORY}</p>{empty}<p>{STORY}</p></article>") == both, empty
    assert main_text(f"<article><p>{STORY}<video src='a'></p><p>{STORY}</p><video src='b'><p>No {STORY}</p></video></article>") == both
    assert main_text(f"<object><object>a</object>{STORY}</object><p>{STORY}</p>") == STORY
    assert main_text(f"<html><head><title>T</title><meta charset='x'><body><p>{STORY}<p>{STORY}") == both
    assert main_text(f"<title>T</title><p>{STORY}<p>{STORY}") == both
    assert main_text(f"<p>{STORY}</p><script>if (a < b) '{STORY}'") == STORY
    # a list item or paragraph of an outside name ends where HTML ends it
    assert main_text(f"<p class='copyright'>{STORY}<p>{STORY}<div>{STORY}</div>") == both
    assert main_text("<svg>" * 20_000 + STORY) == STORY


def _label(kinds, inside, heading, i):
    """The second pass for one block, by looking at all others."""
    if kinds[i] in (GOOD, BAD):
        return kinds[i] == GOOD
    counts = []
    for j, k in enumerate(kinds):
        if k not in (GOOD, BAD):
            continue
        if inside[i] and not inside[j] and k == BAD:
            continue
        if inside[j] and not inside[i] and k == GOOD and kinds[i] == BRIEF:
            continue
        counts.append((abs(i - j), k))
    if not counts:
        return inside[i] or kinds[i] == NEAR or not any(k in (GOOD, BAD) for k in kinds)
    labels = {k for d, k in counts if d == min(counts)[0]}
    return GOOD in labels if len(labels) == 1 else kinds[i] == NEAR or inside[i] or heading[i]


def test_neighbours_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(12)
        kinds = [rng.choice((GOOD, BAD, NEAR, BRIEF, BRIEF)) for _ in range(n)]
        a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        inside = [rng.random() < 0.8 and a <= k < b for k in range(n)]
        heading = [rng.random() < 0.2 for _ in range(n)]
        assert settle(kinds, inside, heading) == [_label(kinds, inside, heading, i) for i in range(n)]


def test_first_pass_against_brute_force():
    """Every combination of length, links and density at its bounds."""
    prose = Block("x" * 400, 0, False, 0)
    for n in (SHORT - 1, SHORT, LONG, LONG + 1):
        for linked in (0, int(MOST_LINKED * n), int(MOST_LINKED * n) + 1, n):
            for share in (0.0, STOPS_LOW - 0.01, STOPS_LOW, STOPS_HIGH - 0.01, STOPS_HIGH, 1.0):
                if linked > MOST_LINKED * n:
                    want = BAD
                elif n < SHORT:
                    want = BRIEF
                elif share < STOPS_LOW:
                    want = BAD
                elif n > LONG:
                    want = GOOD
                else:
                    want = NEAR if share >= STOPS_HIGH else BRIEF
                assert judge([prose, Block("y" * n, linked, False, 0)], [1.0, share]) == [GOOD, want], (n, linked, share)


def test_densities_against_brute_force():
    rng = random.Random(6)
    words = ["the", "of", "na", "wo", "zu", "longer", "words", "1", "kra"]
    for _ in range(200):
        blocks = []
        for _ in range(rng.randrange(6)):
            text = " ".join(rng.choices(words, k=rng.randrange(1, 40)))
            blocks.append(Block(text, rng.choice((0, 0, len(text))), False, 0))
        long = [b for b in blocks if len(b.text) >= SHORT]
        total = sum(len(b.text.split()) for b in long)
        stops = {"the", "of", "zu"}
        for w in ("na", "wo", "kra"):
            n = sum(b.text.split().count(w) for b in long if not b.linked)
            if n >= max(STOP_TIMES, STOP_SHARE * total):
                stops.add(w)
        want = [sum(w in stops for w in b.text.split()) / len(b.text.split()) if len(b.text) >= SHORT else 0.0 for b in blocks]
        assert densities(blocks) == want


def test_pages_stripped_of_names(spark):
    """Without class, id, article and main the two passes still find most of the text."""
    same = whole = 0
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").toLocalIterator():
        text = main_text(page).split("\n")
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", re.sub(r"\s(?:class|id)=\"[^\"]*\"", "", page))
        found = main_text(bare).split("\n")
        common = sum(len(x) for x in text if x in set(found))
        same += common
        whole += sum(map(len, text)) + sum(len(x) for x in found if x not in set(text))
    assert same > 0.9 * whole
