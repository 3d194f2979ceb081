"""Operators do the whole job: cases that earlier versions cut short."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import ctw, html_extract, pieces


def test_each_occurrence_draws_its_own_dropout(spark):
    enc, word = pieces.Encoder(pieces.MODEL, 0.1, 2), " information"
    plain = pieces.Encoder(pieces.MODEL).encode("information").tobytes()
    rng, p = random.Random(1), pieces.load(pieces.MODEL)
    free = [p.merge(pieces.SPACE + "information", 0.1, rng.getrandbits(64)) == list(pieces.Encoder(pieces.MODEL).encode("information")) for _ in range(4000)]
    seen: dict[bytes, int] = {}
    for t in range(4000):  # a text a draw, by document
        x = enc.encode(word.strip(), t).tobytes()
        seen[x] = seen.get(x, 0) + 1
    assert len(seen) > 10 and abs(seen[plain] - sum(free)) < 160
    a, b = (enc.encode_many([word.strip() + word * 200], [7], [k])[0].tolist() for k in (1, 2))
    assert a != b and enc.pieces.decode(a) == enc.pieces.decode(b)
    cold = pieces.Encoder(pieces.MODEL, 0.1, 2)  # what is kept changes nothing
    assert cold.encode_many([word.strip() + word * 200], [7], [1])[0].tolist() == a
    text = "the information that everyone understands " * 20
    twice = spark.createDataFrame([(1, text, "en", "s", len(text))] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.encode(spark, twice, "").collect()
    assert got[0].ids != got[1].ids and got[0].decoded_sha256 == got[1].decoded_sha256


def test_contexts_are_kept_however_large_the_corpus():
    rare, common, once = (int.from_bytes(x, "big") for x in (b"abcdef", b"uvwxyz", b"ghijkl"))
    code, n = np.array([rare, once, common], dtype=np.uint64), np.array([2, 1, 1 << 40])
    ids = ctw.subtrees(code, n, 2)[0][ctw.DEPTH, 0][0].tolist()
    assert ids == [rare >> 8 << 8 | 1, common >> 8 << 8 | 1]
    assert len(ctw.subtrees(code, n, 1)[0][ctw.DEPTH, 0][0]) == 3


def test_title_and_lead_stay_beside_a_long_body():
    long = lambda i: " ".join(f"word{i}x{k}" for k in range(300))
    pages = [f"<body><p>Site wide line</p><div><div class='top'><h1>Title {i}</h1><p>Lead {i}</p></div><div class='body'><p>{long(i)}</p></div></div></body>" for i in range(8)]
    assert html_extract.extract_group(pages) == [f"Title {i}\nLead {i}\n{long(i)}" for i in range(8)]


STORY = "<body><p>Welcome to our site</p><div><p>Story {0} of {1}</p><p>More on {0}</p></div><p>Call us today</p></body>"


def test_every_page_of_a_host_meets_the_same_wrapper(spark):
    """Of hosts of any size; also pages that the wrapper was not learned from."""
    for n in (html_extract.SUPPORT, 33, 2 * html_extract.SAMPLE + 1):
        rows = [(i, f"https://one.org/{i}", STORY.format(i, "abc " * (i % 5 + 1))) for i in range(n)]
        got = html_extract.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {i: f"Story {i} of {'abc ' * (i % 5 + 1)}".strip() + f"\nMore on {i}" for i in range(n)}


def test_a_hot_host_is_many_tasks(spark):
    """Pages are extracted where they are read, not where their host is."""
    rows = [(i, "https://one.org/x", STORY.format(i, "abc")) for i in range(2000)]
    out = html_extract.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8)).withColumn("part", F.spark_partition_id())
    assert out.groupBy("part").count().where("count > 300").count() == 0


def test_induction_decides_inside_an_article():
    notice = "<p>This site is free; please support our work.</p>"
    pages = [f"<body><article><h1>Title {i}</h1>{notice}<p>Text of {i}</p><p>{'Shared by a few' if i % 4 == 0 else f'Own {i}'}</p></article></body>" for i in range(20)]
    want = [f"Title {i}\nText of {i}\n" + ("Shared by a few" if i % 4 == 0 else f"Own {i}") for i in range(20)]
    assert html_extract.extract_group(pages) == want
    alone = [html_extract.main_text(html_extract.parse(p), html_extract.Wrapper()) for p in pages]
    assert all("please support" in t for t in alone)


def test_layouts_of_a_host_are_told_apart():
    story = [STORY.format(i, "abc") for i in range(12)]
    shop = [f"<body><table><tr><td>Our shop's terms</td><td>Item {i}</td></tr><tr><td>All prices in euro</td><td>{i} pieces</td></tr></table></body>" for i in range(8)]
    assert html_extract.extract_group(story + shop) == [f"Story {i} of abc\nMore on {i}" for i in range(12)] + [f"Item {i}\n{i} pieces" for i in range(8)]


def test_near_copies_are_no_template():
    """Of a host's pages a third are copies but for a word; their text is not what all pages share."""
    same = " ".join(f"w{k}" for k in range(200))
    pages = [f"<body><p>Site line</p><div><h1>T{i}</h1><p>{same if i % 3 == 0 else f'own {i} ' * 50}</p></div></body>" for i in range(24)]
    got = html_extract.extract_group(pages)
    assert all("Site line" not in t for t in got) and all(same in got[i] for i in range(0, 24, 3))


def test_names_count_whole_and_confirmed():
    page = "<body><article><div class='entry-header'><h1>Title {0}</h1></div><p>Lead {0}</p><div class='related-work'>Others {0}</div><p class='notice-period'>Two weeks {0}</p><div id='hidden-figures'>Figures {0}</div>{1}</article></body>"
    want = "Title {0}\nLead {0}\nOthers {0}\nTwo weeks {0}\nFigures {0}"
    for n in (1, 12):
        assert html_extract.extract_group([page.format(i, "") for i in range(n)]) == [want.format(i) for i in range(n)]
    comments = "<div class='comments'><p>Reader {0} says hi</p></div>"
    many = [page.format(i, comments.format(i) if i % 2 else "") for i in range(12)]
    assert html_extract.extract_group(many) == [want.format(i) for i in range(12)]
    # one article with a section of that name, on a host where nothing else has it, is no boilerplate
    once = [page.format(i, "<section class='social'><p>On social history</p></section>" if i == 5 else "") for i in range(12)]
    assert html_extract.extract_group(once)[5].endswith("On social history")


def test_wide_and_deep_pages():
    wide = ["<body><ul>" + "".join(f"<li>{i} {k}</li>" for k in range(1500)) + "<li>End of list</li></ul></body>" for i in range(5)]
    got = html_extract.extract_group(wide)
    assert [t.count("\n") for t in got] == [1499] * 5
    deep = ["<div>" * 3000 + f"text {i}" for i in range(5)]
    assert html_extract.extract_group(deep) == [f"text {i}" for i in range(5)]


def test_slugs_inside_an_article_are_no_boilerplate():
    page = "<body><article class='post ad-free'><h2 id='social'>Social</h2><h2 id='social-history'>History</h2><section id='related-work'><p>Work</p></section><div class='ads'>Buy</div><p>End</p></article></body>"
    assert html_extract.extract_group([page]) == ["Social\nHistory\nWork\nEnd"]


def test_a_wrapper_counts_all_pages_of_its_host(spark):
    """Also those of a layout that few pages have, and those over 1 MiB."""
    shop = "<body><table><tr><td>Our shop's terms</td><td>Item {0}</td></tr><tr><td>All prices in euro</td><td>{0} pieces</td></tr></table></body>"
    rows = [(i, "https://one.org/x", STORY.format(i, "abc")) for i in range(1500)] + [(2000 + i, "https://one.org/x", shop.format(i)) for i in range(5)]
    long = [" ".join(f"w{i}x{k}" for k in range(150_000)) for i in range(4)]
    rows += [(3000 + i, "https://two.org/x", f"<body><p>Site wide line</p><div><h1>T{i}</h1><p>{x}</p></div></body>") for i, x in enumerate(long)]
    assert all(len(x) > 1 << 20 for x in long)
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows + rows[:1] * 3, "page_id bigint, url string, html string")).collect()}
    want = {i: f"Story {i} of abc\nMore on {i}" for i in range(1500)} | {2000 + i: f"Item {i}\n{i} pieces" for i in range(5)}
    assert got == want | {3000 + i: f"T{i}\n{x}" for i, x in enumerate(long)}


def test_shares_are_of_all_pages(spark):
    """A line that 13 in 20 pages share goes, one that 11 in 20 share stays, whichever pages have small hashes."""
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>{'Often' if i % 20 < 13 else f'a {i}'}</p><p>{'Less' if i % 20 >= 9 else f'b {i}'}</p><p>End {i}</p></article></body>"
    rows = [(i, f"https://h{h}.org/x", page(h * 10_000 + i)) for h in range(12) for i in range(400)]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert not any("Often" in r.text for r in got) and sum("Less" in r.text for r in got) == 12 * 220


def test_wrappers_of_a_table_are_those_of_its_hosts(spark):
    rng = random.Random(3)
    layouts = [[rng.choice(["div", "section", "ul", "table"]) + str(k) for k in range(rng.randint(2, 9))] for _ in range(7)]

    def page() -> str:
        parts = []
        for k, name in enumerate(rng.choice(layouts)):
            tag = name.rstrip("0123456789")
            words = rng.choice([f"Fixed {name} line", f"Own {rng.random()}", f"Often {name}" if rng.random() < 0.8 else f"Rare {rng.random()}"])
            parts.append(f"<{tag} class='{name} {'social' if k == 3 and rng.random() < 0.2 else ''}'><p>{words}</p><p>{rng.random()}</p></{tag}>")
        return f"<body><main>{''.join(parts)}</main></body>"

    hosts = {f"h{n}.org": [page() for _ in range(n)] for n in (1, 3, 4, 17, 60, 150)}
    hosts["copies.org"] = [f"<body><p>Site</p><div><p>{'same ' * 50 if i % 3 else f'own {i} ' * 50}</p><p>{i}</p></div></body>" for i in range(30)]
    rows = [(i, f"https://{h}/x", x) for h, xs in hosts.items() for i, x in enumerate(xs + xs[:2])]
    got = {r.host: (r.template, r.confirmed) for r in html_extract.learn_wrappers(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    want = {}
    for h, xs in hosts.items():
        w = html_extract.induce({html_extract._sign(xxhash.xxh64_intdigest(x, 42)): html_extract.parse(x) for x in xs})
        if w.confirmed is not None:
            want[h] = (html_extract._signed(w.template), html_extract._signed(w.confirmed))
    assert {h: (sorted(t), sorted(c)) for h, (t, c) in got.items()} == want
    assert sum(bool(t) for t, _ in want.values()) >= 3 and any(c for _, c in want.values())


def plain_match(a, b) -> int:
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(x, y))
    return 1 + (a.text is not None and a.text == b.text) + best[-1][-1]


def test_long_lists_match_by_the_definition(monkeypatch):
    rng = random.Random(5)
    row = lambda: f"<tr>{''.join(f'<td>{rng.choice('abcdefgh')}</td>' for _ in range(rng.randint(1, 3)))}</tr>" if rng.random() < 0.8 else f"<tr><td><ul>{'<li>x</li>' * rng.randint(0, 3)}</ul></td></tr>"
    for cells in (html_extract.CELLS, 50):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(8):
            a, b = (html_extract._unpack(html_extract._pack(html_extract.parse(f"<body>{'<p>x</p>' * rng.randint(0, 12)}<table>{''.join(row() for _ in range(rng.randint(9, 20)))}</table></body>"))) for _ in range(2))
            pairs = list(html_extract.aligned(a, b))
            assert html_extract.match(a, b) == plain_match(a, b) == len(pairs) + sum(x.text is not None and x.text == y.text for x, y in pairs)


def test_deep_pages_are_learned_from():
    pages = ["<div>" * 300 + f"<p>Site wide line</p><p>text {i}</p>" for i in range(5)]
    assert html_extract.extract_group(pages) == [f"text {i}" for i in range(5)]


def test_what_markup_drops_makes_no_layout():
    """Two layouts under the same long menu: each has lines of its own."""
    menu = f"<nav><ul>{''.join(f'<li>Go {k}</li>' for k in range(30))}</ul></nav>"
    one = [f"<body>{menu}<article><p>Line of one</p><p>Story {i}</p></article></body>" for i in range(12)]
    two = [f"<body>{menu}<main><article><p>Line of two</p><p>Item {i}</p></article></main></body>" for i in range(9)]
    assert html_extract.extract_group(one + two) == [f"Story {i}" for i in range(12)] + [f"Item {i}" for i in range(9)]


def test_lines_of_every_layout_are_found():
    """A line on two thirds of a layout's pages goes, though it is on few of the host's pages and not on all sizes."""
    page = "<body><{0}><article><h1>Title {1}</h1>{2}<p>{3}</p><p>Part {4}</p></article></{0}></body>"
    tags = ("main", "div", "section", "center", "table")
    pages = [page.format(t, f"{t} {i}", f"<p>Line of {t}</p>" if i % 3 else "", f"text {i} " * (2, 60, 4)[i % 3 - 1], i % 5) for t in tags for i in range(60)]
    got = html_extract.extract_group(pages)
    assert not any("Line of" in x for x in got) and all("Part " in x for x in got)


def test_a_line_of_few_pages_is_no_template():
    """Pages without it have fewer blocks, so that it aligns with its like only."""
    pages = [f"<body><article><h1>Title {i}</h1><p>Text of {i}</p>{'<p>Said by some</p>' if i % 5 == 0 else ''}</article></body>" for i in range(70)]
    assert sum("Said by some" in x for x in html_extract.extract_group(pages)) == 14
