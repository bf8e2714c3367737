"""HTML extraction, edit-aware counts, queries and the pipeline."""

import os
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from vecloom.llm import queries as Q
from vecloom.llm.editcount import CountTree, apply_edits, build_trees, counter
from vecloom.llm.html import Page, extract_main_text, host_paths

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="content post-17"><article><header><h1>Title &amp; more</h1></header><p>First <b>bo</b>ld
 line<p>Second &lt;x&gt; &copy; 5 < 6<ul><li>one<li>two</ul><form><input value=x><button>Go</button></form><div class=ad>Buy</div>
<table><tr><td>cell<td>other</table></article><section class="comments"><p>I disagree a lot</p></section></div>
<aside><p>Side bar text</p></aside><div class="sidebar-left">more side</div><footer>&copy; us</footer><p style="display:none">hidden</p></body></html>"""


def text_of(page):
    return Page(page).text()


def test_blocks():
    assert text_of(PAGE) == "Title & more First bold line Second <x> © 5 < 6 one two cell other"


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain words", "plain words"), ("<p>a<br>b</p>c", "a b c"), ("<p>cut off &am", "cut off &am"), ("<p>x<!-- never closed", "x"), ("<p>x<b", "x"), ("<div><p>a</div>b", "a b"),
    ("<p>a&nbsp;&#x41;&#66;</p>", "a AB"), ("<script>x", ""), ("<p title='a>b'>q</p>", "q"), ("<P>Upper</P><DIV>İ case</DIV>", "Upper İ case"), ("<p>1 << 2 </> 3", "1 << 2 3"),
])
def test_odd_pages(page, want):
    assert text_of(page) == want


def test_best_container():
    page = Page(f"<body><section><a href=x>{'x' * 10}</a></section><div class='main n1'>{'y' * 100}<div>{'z' * 50}</div></div></body>")
    assert page.path_name(page.best()[0]) == "/body/div.main"
    assert Page("").best() is None


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "<p>words of a block" * 20_000, "<div class=social>" * 20_000 + "<p>words of a block</p>" * 20_000, "".join(f"<div class=c{'x' * (n % 50)}><p>words {n}" for n in range(20_000)), "<b>" * 20_000 + "</i><p>x</p>" * 20_000,
    "<ul>" + "<div>" * 20_000 + "<li>x</li></u>" * 20_000, "<p>" + "word " * 1_000_000, "<a href='" * 20_000, "<" * 200_000, "&#" * 200_000,
])
def test_deep_and_long_pages_take_linear_time(page):
    start = time.time()
    Page(page).text(["/div/div", "/body/div.main"])
    assert time.time() - start < 5


LONG = "<p>" + "the body of the story goes on and on here " * 20 + "</p>"


@pytest.mark.parametrize("inside", ["<div class='entry-content'>%s</div>", "<blockquote>%s</blockquote>", "<table><tr><td>%s</td></tr></table>", "<section>%s</section>"])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<main><div>%s</div></main>", "<div class=post>%s</div>"])
def test_whole_article(inside, around):
    """Heading, introduction and end outside the part with most of the text belong to the article."""
    page = "<body><nav>Home</nav>" + around % ("<h1>Title</h1><p>intro</p>" + inside % LONG + "<p>The end.</p>") + "<div class=x><a href='/more'>More of it</a></div></body>"
    text = text_of(page)
    assert text.startswith("Title intro the body") and text.endswith("The end.")


@pytest.mark.parametrize("part", [
    "<section id='discussion'><p>kept</p></section>", "<h2 id='side-effects'>kept</h2>", "<div class='related-work'><p>kept</p></div>", "<h2 id='search-results'>kept</h2>", "<div class='notice'>kept</div>",
    "<div class='header'><h1>kept</h1></div>", "<section class='social-history alert-levels'>kept</section>", "<section id=tags-in-html>kept</section>", "<section id=cookies><p>kept" + LONG + "</section>", "<div class=related>kept" + LONG + "</div>",
])
def test_names_in_articles(part):
    assert "kept" in text_of(f"<body><article><p>before</p>{part}<p>after</p></article></body>")


@pytest.mark.parametrize("part", ["<section id='discussion-of-results'><p>kept</p></section>", "<h2 id='side-effects' class='search-title'>kept</h2>", "<div class='discussion'>kept" + LONG + "</div>", "<div class='has-sidebar'>kept</div>"])
def test_names_outside_articles(part):
    assert "kept" in text_of(f"<body><p>before</p>{part}<p>after</p></body>")


@pytest.mark.parametrize("part", ["<div class=ad>gone</div>", "<div class='share-buttons'>gone</div>", "<div class=comments>gone" + LONG + "</div>", "<div id=disqus_thread>gone</div>", "<span class=share>gone</span>", "<div class=related>" + "<a href='/x'>gone is this and that</a> " * 40 + "</div>", "<div id=cookie-notice>gone" + LONG + "</div>"])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>"])
def test_furniture_by_name(part, around):
    text = text_of("<body>" + around % f"<p>before</p>{part}<p>after</p>" + "</body>")
    assert "gone" not in text and text.startswith("before") and text.endswith("after")


def test_whole_article_in_parts(spark):
    """A part of some length in a container of its own is kept, also by the votes of a host."""
    page = "<body><div class=post><div class=intro><p>An introduction of ten words stands in its own box.</p></div><div class=entry>" + LONG + "</div></div></body>"
    rows = [(n, f"https://c.example/{n}", page) for n in range(3)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("An introduction of ten words") and r.text.endswith("on here") for r in got)


def test_hosts_agree(spark):
    def page(n, teaser):
        return f"<body><div class='x{n}'><p>{teaser}</p></div><div class='story s{n}'><p>{'story words ' * 10}{n}</p></div></body>"

    rows = [(n, f"https://a.example/{n}", page(n, "short")) for n in range(9)]
    rows += [(9, "https://a.example/9", page(9, "a very long teaser " * 30))]  # on its own it would take the teaser
    rows += [(10, "https://b.example:8080/x", "<body><p>other</p></body>"), (11, None, None), (12, "odd url", "<p>t</p>"), (12, "odd url", "<p>t</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("paths", F.lit(2))
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[9] == ("story words " * 10 + "9").strip() and got[3].endswith("words 3")
    assert (got[10], got[11], got[12]) == ("other", "", "t")
    assert extract_main_text(df).count() == 14 and extract_main_text(df.limit(0)).count() == 0


class Article(HTMLParser):
    """Brute force for pages whose text is all in article: its text, block by block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.deep, self.skip, self.parts = 0, 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.deep += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in ("p", "h1", "br", "article"):
            self.parts.append("\0")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.parts.append("\0")
        self.deep -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.deep and not self.skip:
            self.parts.append(data)

    def text(self):
        return " ".join(x for x in (" ".join(p.split()) for p in "".join(self.parts).split("\0")) if x)


def test_all_pages_like_a_parser(spark):
    """Every row of the pages table, by the query, against the standard library's parser."""
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    got = {r.page_id: (r.text, r.n_chars) for r in Q.op3_extract_html(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        want = Article(r.html or "").text()
        assert got[r.page_id] == (want, len(want))


def test_hosts_judge_doubtful_names(spark):
    """A short element of a doubtful name stays where its text differs from page to page, and goes where it repeats or links."""
    def page(n):
        return f"<body><article><p>story {n} {'words ' * 20}</p><div class=toc>part {n}</div><div class=share>tell others</div><div class=related><a href=/x>see {n}</a></div></article></body>"

    rows = [(n, f"https://a.example/{n}", page(n)) for n in range(5)] + [(9, "https://few.example/", page(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[3].startswith("story 3 words") and got[3].endswith("words part 3") and got[9].endswith("words")
    told = {r.host: r for r in host_paths(df).collect()}
    assert {x.path: x.fine for x in told["a.example"].verdicts} == {"/body/article/div.toc": True, "/body/article/div.share": False, "/body/article/div.related": False}
    assert told["few.example"].verdicts is None


def test_winners_of_a_hot_host_meet_its_pages_in_parts(spark):
    page = "<body><div class=story><p>%s words of a story here</p></div><div class=x><a href=/y>more</a></div></body>"
    df = spark.range(400).selectExpr("id as page_id", "case when id % 3 > 0 then 'https://hot.example/' else concat('https://', id, '.example/') end as url").withColumn("html", F.format_string(page, F.col("page_id")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = extract_main_text(df).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.page_id, r.text) for r in got) == [(n, f"{n} words of a story here") for n in range(400)]


# --- edit-aware counts


def edited(text, edits):
    for s, e, new in edits:
        s = min(max(s, 0), len(text))
        e = min(max(e, s), len(text))
        text = text[:s] + new + text[e:]
    return text


def test_edits_count_like_the_whole_text():
    r, count = random.Random(4), counter()
    letters = "abc de.f'st 12 \n\t  é漢\x1c!?"
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 400)))
        tree = CountTree(text, count, leaf=4)
        edits = []
        for _ in range(r.randint(1, 6)):
            s = r.randint(-2, len(text) + 2)
            edits.append((s, s + r.choice([0, 0, 1, 5, 60, -3]), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 30, 200])))))
            tree.edit(*edits[-1])
        want = edited(text, edits)
        assert tree.text == want and tree.total == len(count.encode(want))
        again = CountTree(tree.text, count, 4, (tree.chars, tree.tokens))
        again.edit(1, 2, " x ")
        assert again.total == len(count.encode(edited(want, [(1, 2, " x ")])))


def test_edits_touch_few_leaves():
    tree = CountTree(" ".join(f"word{k}" for k in range(6400)), counter())
    tree.edit(20_000, 20_005, "changed it")
    assert tree.encoded <= 3


def test_apply_edits(odd, empty):
    trees = build_trees(odd)
    edits = F.expr("array(named_struct('start', 3L, 'end', 9L, 'text', ' new '), null, named_struct('start', cast(null as bigint), 'end', cast(null as bigint), 'text', cast(null as string)), named_struct('start', 100000000L, 'end', 0L, 'text', 'tail'))")
    got = sorted(((r.doc_id, r.text, r.n_tokens, r.n_edits) for r in apply_edits(trees.withColumn("edits", edits)).collect()), key=repr)
    count = counter()
    want = [(r.doc_id, t, len(count.encode(t)), 3) for r in odd.collect() for t in [edited(r.text or "", [(3, 9, " new "), (10**8, 0, "tail")])]]
    assert got == sorted(want, key=repr)
    assert sorted((r.n_tokens for r in trees.collect())) == sorted(len(count.encode(r.text or "")) for r in odd.collect())
    none = apply_edits(trees.withColumn("edits", F.lit(None)))
    assert none.where("n_edits = 0 and n_encoded = 0").count() == odd.count()
    assert apply_edits(build_trees(empty).withColumn("edits", edits)).count() == 0


# --- queries


def test_queries_run(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, "http://x.example/", PAGE)], "page_id long, url string, html string").write.parquet(f"{sf_dir}/pages.parquet")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in Q.queries().items():
        assert query(spark, sf_dir).count() == (1 if name.startswith("op3") else n), name
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in Q.queries()} == set(range(1, 11))


def test_revision_counts_like_the_whole_texts(spark, sf_dir):
    """op9 against encoding every text before and after its three edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    starts = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.char_length("t").cast("long") + 1).alias(f"s{k}") for k in (1, 2, 3)]
    count, want = counter(), []
    for r in docs.select("doc_id", "t", *starts).collect():
        text = edited(r.t, [(r.s1, r.s1, " an added remark,"), (r.s2, r.s2 + 40, ""), (r.s3, r.s3 + 5, "word")])
        want.append((r.doc_id, len(count.encode(r.t)), len(count.encode(text)), len(text), 3))
    got = [(r.doc_id, r.n_before, r.n_tokens, r.n_chars, r.n_edits) for r in Q.op9_edit_aware_counts(spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names, name
    last = C.run(spark, sf_dir).collect()
    assert sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_like_brute_force(spark, sf_dir, tmp_path):
    """Every stage against brute force, and the files of a run that is kept; a second run reads them."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    from test_exact import contaminated, expected_components, quality_score, rules
    from vecloom.llm.tokenids import tokenizer_path

    out = f"{tmp_path}/out"
    last = C.run(spark, sf_dir, out).collect()
    tables = [spark.read.parquet(f"{out}/{n}-{name}").collect() for n, (name, _) in enumerate(C.STAGES[:-1])]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()

    def keys(rows):
        return sorted(((r.doc_id, r.text, r.source) for r in rows), key=repr)

    score = quality_score(docs, labels)
    want = [r for r in docs if not rules(r.text)[-1] and score(r.text) >= -0.15]
    assert keys(want) == keys(tables[0]) and 0 < len(want) < len(docs)
    _, comp, _ = expected_components(want)
    first = {}
    for r, c in zip(want, comp):
        first[c] = min(first.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in tables[1]) == sorted(first.values()) and len(tables[1]) < len(want)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [r for r in tables[1] if not contaminated([r], bench)[0][2]]
    assert keys(want) == keys(tables[2]) and len(want) < len(tables[1])
    # the mix: whole rows, none over three times, sources in proportion as far as whole documents allow
    times = {k: keys(tables[3]).count(k) for k in keys(tables[2])}
    assert set(keys(tables[3])) <= set(keys(tables[2])) and max(times.values()) <= 3
    sizes = {}
    for r in tables[2]:
        sizes.setdefault(r.source, []).append(len(r.text.split()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}
    target, rest, free = {}, sum(map(sum, sizes.values())), list(order)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sum(sizes[s])]
        for s in full or free:
            target[s] = 3 * sum(sizes[s]) if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    for s in order:
        taken = sum(len(r.text.split()) for r in tables[3] if r.source == s)
        assert abs(taken - target[s]) <= max(sizes[s])
    # tokens: the library's, in order of ids
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, at = [], 0
    for r in sorted(tables[3], key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text.encode())):
        n = len(library.encode(r.text, add_special_tokens=False).ids) + 1
        want.append((r.doc_id, at, n))
        at += n
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in last), key=lambda x: x[1]) == want
    made = {p: os.path.getmtime(f"{out}/{p}") for p in os.listdir(out)}
    os.remove(f"{out}/4-tokenize/_SUCCESS")
    again = C.run(spark, sf_dir, out).collect()
    assert sorted(again) == sorted(last) and all(os.path.getmtime(f"{out}/{p}") == x for p, x in made.items() if not p.startswith("4"))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    root = str(tmp_path)
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{table}.parquet")
    assert C.run(spark, root).count() == 0
