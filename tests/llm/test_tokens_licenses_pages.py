"""Row-wise operators against the library, plain loops and hand-written pages."""

import html
import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import html_text, licenses, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _library(texts):
    own = Tokenizer.from_file(PATH)
    return [len(own.encode(t or "", add_special_tokens=False)) for t in texts]


def test_token_counts_are_the_librarys(spark, documents):
    rows = {r.doc_id: r for r in tokens.token_counts(documents, PATH, table_entries=50).collect()}
    texts = documents.select("doc_id", "text").collect()
    for r, n in zip(texts, _library([r.text for r in texts]), strict=True):
        got = rows[r.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(r.text.encode()), n, n > 512)


def test_token_counts_awkward(awkward, empty):
    got = tokens.token_counts(awkward, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(_library([r.text for r in awkward.collect()]))
    assert sorted(r.n_tokens for r in got.collect()) == want
    assert tokens.token_counts(empty, PATH).collect() == []


def test_sure_characters_split_as_the_library_does():
    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    for point in range(0x3000):
        c = chr(point)
        if not tokens.UNSURE.search(c):
            text = f"a{c}b 1{c} {c}. {c}{c} 's {c}s{c}"
            assert [b - a for _, (a, b) in split(text)] == [len(p) for p in tokens.PATTERN.findall(text)], hex(point)


def test_license_base_columns_by_plain_search(documents):
    phrases = {tuple(p.split()): label for p, label in licenses.BASE_PHRASES.items()}
    got = {r.doc_id: r for r in licenses.license_scan(documents).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r in documents.collect():
        words = word.findall((r.text or "").translate(lower))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        have = got[r.doc_id]
        assert (have.n_words, have.n_base) == (len(words), len(places))
        assert have.base_labels == ",".join(sorted({label for _, label in places}))
        assert (have.first_word, have.last_word) == (
            (min(i for i, _ in places), max(i for i, _ in places)) if places else (None, None)
        )
        assert set(filter(None, have.base_labels.split(","))) <= set(have.labels.split(","))


def test_license_fuzzy_labels(spark, awkward, empty):
    texts = {
        1: "Relesed under the MIT Licens today",
        2: "under the gnu genral pubic license v3",
        3: "the apache license",
        4: "summit licences and permits",
        5: None,
        6: "cc by by cc by",
    }
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0 < got[1].score < 1
    assert got[2].labels == "gpl" and got[2].n_base == 0
    assert got[3].labels == got[3].base_labels == "apache" and got[3].score == 1
    assert got[4].labels == "" and got[5].n_words == 0 and got[5].spans == []
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 3)
    assert licenses.license_scan(awkward).count() == awkward.count()
    assert licenses.license_scan(empty).collect() == []


def _brute_matches(phrase, f, text):
    """All places at word gaps within the errors, the best first and none across another."""
    gaps = [i for i, c in enumerate(text) if c == 0x20]
    options = []
    for a in gaps:
        for b in gaps:
            if f.size - f.errors <= b - a - 1 <= f.size + f.errors:
                options.append((_edits(phrase.encode(), text[a + 1 : b]), a + 1, b))
    kept = []
    for e, a, b in sorted(options):
        if e <= f.errors and all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, e))
    return sorted(kept)


def test_pigeonhole_finds_every_match_of_the_bounded_pattern(documents):
    rng = random.Random(1)
    typed = ["a gnu generl publc license x mit licens y apachelicense z gnu general public licence mit lizense"]
    for _ in range(60):
        words = " ".join(rng.choice(["mit", "license", "licence", "apache", "gnu general public license", "gnu", "genera", "x"]) for _ in range(14))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(words))
            words = words[:p] + rng.choice(["", "e", " "]) + words[p + rng.randrange(2) :]
        typed.append(words)
    phrases = {p: label for p, label in licenses.BASE_PHRASES.items()}
    fuzzy = list(zip(phrases, licenses._fuzzy(phrases, 8), strict=True))
    n = 0
    for text in typed + [r.text[:400] for r in documents.limit(20).collect()]:
        words = b" " + b" ".join(text.encode().lower().translate(licenses._WORD_BYTES).split()) + b" "
        for phrase, f in fuzzy:
            if f.errors:
                got = f.matches(words)
                assert got == _brute_matches(phrase, f, words)
                n += len(got)
    assert n > 100


def test_repeated_notices_take_time_in_proportion():
    taken = []
    for times in (1_000, 8_000):
        text = "mit licence and released under the mit licenze or " * times
        started = time.time()
        (n_words, n_base, first, _, _, labels, _, spans), = licenses_scan([text])
        taken.append(time.time() - started)
        assert (n_words, n_base, first, labels) == (9 * times, 0, None, "mit") and len(spans) == 3 * times
    assert taken[0] < 2 and taken[1] < 24 * max(taken[0], 0.05)


def licenses_scan(texts):
    base = [(b" " + p.encode() + b" ", label, p.count(" ") + 1) for p, label in licenses.BASE_PHRASES.items()]
    exact = re.compile(b"|".join(re.escape(p) for p, _, _ in base))
    fuzzy = [f for f in licenses._fuzzy(licenses.BASE_PHRASES | licenses.NOTICES, 8) if f.errors]
    return [licenses.scan(t, base, exact, fuzzy) for t in texts]


def _article(page):
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())


def test_pages_give_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.page_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == _article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=#>a</a></nav></header>
<div class="cookie-notice"><p>We use cookies, and more cookies, because this site needs them to work well.</p></div>
<div id="content" class="content with-sidebar"><div class="post-body"><h2>Head &amp; line</h2>
<p>This is a long paragraph, with several commas, and enough text to count as an article, certainly.
<p>Second one, also <a href="x">linked</a> text, long enough for the scoring of this tree, I think.</div>
<div class="related-posts"><ul><li><a href=a>Other story, one</a></li><li><a href=b>Other story two</a></li></ul></div></div>
<div class="sidebar"><p>Sidebar text, with commas, that is also long enough to be taken as a paragraph by itself.</p></div>
<section id="comments"><p>Great article, I liked it a lot, thanks for writing this long piece, really.</p></section>
<form><p>Subscribe to our newsletter, get mails, every day of the week, or month.</p></form><footer>&copy; x</footer></body></html>"""


def test_page_without_article_element():
    assert html_text.main_text(PAGE) == (
        "Head & line This is a long paragraph, with several commas, and enough text to count as an article, "
        "certainly. Second one, also linked text, long enough for the scoring of this tree, I think."
    )


def test_names_with_header():
    body = "<p>A paragraph that is long enough to be scored, with a comma, and then a bit more text.</p>"
    assert html_text.main_text(f'<div class="page with-header">{body}</div>').startswith("A paragraph")
    page = f'<div class="site-header"><p>Welcome to our site, which has a long and friendly claim, as you see.</p></div><div>{body}</div>'
    assert html_text.main_text(page).startswith("A paragraph")


LONG_P = "<p>A paragraph that is long enough to be scored, with a comma, and then a bit more text.</p>"


@pytest.mark.parametrize(
    "name",
    "ad-content ad-body promo-text sidebar-content newsletter-body cookie-text related-entry sponsored-post adslot share-page notice-story".split(),
)
def test_boxes_named_as_noise_go_inside_the_article_and_beside_it(name):
    box = f'<div class="{name}"><p>Buy this now, it is cheap, and it is good, and there are only a few of them left.</p></div>'
    want = html_text.main_text(f"<body><article>{LONG_P}{LONG_P}</article></body>")
    assert html_text.main_text(f"<body><article>{LONG_P}{box}{LONG_P}</article></body>") == want
    assert html_text.main_text(f"<body><article>{LONG_P}{LONG_P}</article>{box}</body>") == want
    assert html_text.main_text(f"<body><div>{box}<div>{LONG_P}{LONG_P}</div></div></body>") == want


def test_frames_named_after_noise_keep_the_article():
    page = f'<body><div class="sidebar-layout"><div class="ads-wrapper"><article>{LONG_P}</article></div><div class="sidebar">{LONG_P}</div></div>'
    assert html_text.main_text(page) == html_text.main_text(LONG_P)
    assert html_text.main_text(f'<div class="sidebar-wrapper">{LONG_P}</div><div>x {LONG_P}</div>').startswith("x A paragraph")


def test_long_attributes_and_stray_quotes():
    for value in ("x" * 6_000 + " > LEAK", "x" * 200_000 + "<p>LEAK</p>"):
        for quote in "\"'":
            assert "LEAK" not in html_text.main_text(f"<article data-j={quote}{value}{quote}>{LONG_P}</article>")
    page = f'<article><p title=5">{LONG_P[3:]}<p class="a"b>{LONG_P[3:]}</article>'
    assert html_text.main_text(page).count("A paragraph") == 2
    started = time.time()
    html_text.main_text('<a b="' * 50_000 + "<a b='" * 50_000)
    assert time.time() - started < 5


@pytest.mark.parametrize("depth", [1, 10, 70, 700])
def test_headers_inside_the_article_at_any_depth(depth):
    page = f"<article>{'<div>' * depth}<header><h1>Head of it</h1></header>{LONG_P}{'</div>' * depth}</article>"
    assert html_text.main_text(page).startswith("Head of it A paragraph")


def test_extraction_does_not_depend_on_article_and_main_tags(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html)
        assert html_text.main_text(plain) == html_text.main_text(r.html)


def test_a_very_long_page_with_name_traps():
    trap = f'<div class="ad-content">{LONG_P}</div><div class="story">{LONG_P}</div>'
    got = html_text.main_text(f"<body><div>{trap * 3_000}</div></body>")
    assert got.count("A paragraph") == 3_000


def test_awkward_pages(spark):
    deep = "<div>" * 5000 + "text in a deep place, with a comma" + "</div>" * 5000
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "plain & simple"), (None, "u", "<p>a<b>b</b>c<br>d"), (5, "u", "<script>x"),
        (6, "u", deep), (7, "u", "<a <b ' \" <p>x" * 50), (7, "u", "<a <b ' \" <p>x" * 50), (8, "u", "<!-- open"), (9, "u", "</div></p>&nbsp;&#228;"),
    ]
    got = html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert texts[:5] == [(1, ""), (2, ""), (3, "plain & simple"), (None, "abc d"), (5, "")]
    assert texts[5][1] == "text in a deep place, with a comma" and texts[6] == texts[7]
    assert texts[8:] == [(8, ""), (9, "ä")]
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.page_text(none).collect() == []


def test_license_misspelt_mentions_before_an_exact_one():
    fuzzy = {f.size: f for f in licenses._fuzzy({"mit license": "mit", "permission is hereby granted free of charge": "mit"}, 8)}
    mit, notice = fuzzy[11], fuzzy[43]
    for phrase, f, text in (
        ("mit license", mit, " the mit licence and the mit license "),
        ("mit license", mit, " mit licence or mit licence or mit license or mit licens "),
        ("permission is hereby granted free of charge", notice, " permision is hereby granted fre of charge x permission is herby granted free of charg permission is hereby granted free of charge "),
    ):
        words, want = text.encode(), set()
        gaps = [i for i, c in enumerate(text) if c == " "]
        near = lambda a, b: _edits(phrase, text[a + 1 : b])  # noqa: B023, E731
        options = sorted((near(a, b), a, b) for a in gaps for b in gaps if 0 < b - a <= f.size + f.errors + 1)
        for e, a, b in options:  # the best first, none across another
            if e <= f.errors and all(b <= x or y <= a for x, y, _ in want):
                want.add((a, b, e))
        assert {(a - 1, b, e) for a, b, e in f.matches(words)} == want and len(want) > 1


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
