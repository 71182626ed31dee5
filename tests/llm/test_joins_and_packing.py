"""The Jaccard join, packing, WARC archives and HTML extraction."""

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import common, components, html_extract, jaccard_join, packing, warc
from tests.llm.conftest import words


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def corpus(spark):
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = words(g, r.randint(30, 300)).split()
        for _ in range(r.randint(1, 40)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(w), "c"))
    common = words(99, 30)
    rows += [(len(rows) + i, words(500 + i, 120) + " " + common, "c") for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string"), {i: shingle_set(t) for i, t, _ in rows}


def brute(sets):
    ids = sorted(sets)
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            n = len(x & y)
            if n >= 0.8 * (len(x) + len(y) - n):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return links, {i: root(i) for i in ids}


def test_join_finds_every_link(spark):
    docs, sets = corpus(spark)
    links, root = brute(sets)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect()}
    assert got == {i: (root[i], links[i]) for i in sets}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_join_splits_large_buckets_and_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    docs, sets = corpus(spark)
    links, root = brute(sets)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect()}
    assert got == {i: (root[i], links[i]) for i in sets}


def test_join_of_odd_rows(odd, none):
    rows = jaccard_join.similarity_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[3].n_links == 2
    assert by[5].class_id == by[6].class_id == by[7].class_id == 5 and by[4].n_links == 1
    assert jaccard_join.similarity_classes(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    kept = [r.doc_id for r in jaccard_join.keep_one(odd).collect()]
    assert Counter(k for k in kept if k is not None) == Counter([1, 4, 5, 8, 9, 10, 11, 12, 13])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (7, 200), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 200: 0, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_plan(histogram, capacity=2048):
    plan = packing.make_plan(histogram, capacity)
    assert {k: v for k, v in plan.used.items() if v} == {k: v for k, v in histogram.items() if v}
    spots = {}
    for length, _, count, sequence, offset in plan.runs:
        for k in range(count):
            spots.setdefault(sequence + k, []).append((offset, length))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(spots) == plan.sequences
    return plan.sequences, -(-sum(k * v for k, v in histogram.items()) // capacity)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 60), max_size=40))
def test_plans_are_whole_and_gapless(histogram):
    check_plan(histogram)


def test_plan_is_near_the_bound():
    r = np.random.default_rng(1)
    n = np.clip(r.lognormal(6, 1, 20000).astype(int), 1, 2048)
    used, bound = check_plan(dict(Counter(n.tolist())))
    assert used <= bound * 1.01 + 2
    assert check_plan({1000: 1001})[0] == 501 and check_plan({}) == (0, 0)


def test_packing_of_odd_rows(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in odd.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    rows = packing.packed(odd).collect()
    assert Counter(want) == Counter(tuple(r)[:5] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        ends = [0, *(a + b for a, b in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert packing.packed(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_word_tokens_are_the_texts_tokens(texts):
    import pyarrow as pa

    tok = packing.WordTokenizer(packing.default_tokenizer())
    ids, starts = tok.encode_batch(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids


def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "u\r\nv", None), (7, "http://é", "é" * 600), (7, "http://é", "é" * 600), (None, "n", big), (8, "", "")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    df = pages(spark)
    rows = warc.archive_round_trip(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == Counter(
        (p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", 3 if rev else None) for p, b, rev in ((r.page_id, (r.html or "").encode(), r.page_id in (1, 2, None)) for r in df.collect())
    )
    assert all(r.intact for r in rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Top</header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this page, all of them, to make it better.</div><div class="ad">Buy this</div>
    <article><h1>Title &amp; more</h1><p><b>First   line<br>goes on.<p>Second &copy; paragraph with some more words in it, as text has.</p><p>Hm.</p><form><input>Search</form></article>
    <aside>Related</aside><section id="comments"><p>Nice article, I liked it very much indeed, thank you.</p></section><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Title & more\nFirst line goes on.\nSecond © paragraph with some more words in it, as text has.\nHm."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("just text, no tags") == "just text, no tags"
    plain = "<html><body><div id=menu><a href=1>a</a> <a href=2>b</a></div><div id=content>" + "".join(f"<p>Paragraph {i} with a good number of plain words in it.</p>" for i in range(6)) + "</div><div class=sidebar>side</div></body></html>"
    assert html_extract.main_text(plain).count("\n") == 5


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>x y</p></article>"), (2, "u", "<div>" * 3000 + "deep"), (2, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == Counter([(1, "", 0), (None, "x y", 3), (2, "deep", 4), (2, "deep", 4)])
    assert html_extract.extract(df.limit(0)).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    near = words(7, 80).split()
    near[40] = "changed"
    rows = [(1, words(1, 60)), (1, words(2, 60)), (1, words(2, 60)), (None, words(7, 80)), (None, " ".join(near)), (None, words(7, 80)), (None, words(8, 30))]
    docs = spark.createDataFrame([(*r, k, True) for k, r in enumerate(rows)], "doc_id long, text string, __id int, __mark boolean")
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_join.similarity_classes(docs).collect())
    assert got == Counter([(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 1, 2), (None, None, 2, 2), (None, None, 2, 2), (None, None, 2, 1), (None, None, 0, 1)])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect() if r.doc_id) == Counter([words(1, 60), words(2, 60)])
    left = [r.text for r in kept.collect() if r.doc_id is None]
    assert len(left) == 2 and words(8, 30) in left


def test_small_staged_tables_are_few_files(spark):
    """Each file that an executor writes to a local folder costs it a process, so tables of few rows must not have a file for each
    shuffle partition; the rows are the same."""
    docs, sets = corpus(spark)
    links, root = brute(sets)
    folder = pathlib.Path(common.scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    were = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect()}
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == {i: (root[i], links[i]) for i in sets}
    files = [(d.name.rpartition("-")[0], len(list(d.glob("part-*")))) for d in set(folder.iterdir()) - before]
    assert {"sets", "candidates", "lowest", "members", "classes"} <= {label for label, _ in files}
    few = spark.sparkContext.defaultParallelism  # tables whose rows are worked on by tiles keep their tasks
    assert all(n <= few for label, n in files if label not in ("sketches", "verified")), files


def test_recall_on_the_drivers_documents(spark):
    """Every link of the documents whose id is divisible by 50, found by an inverted index over all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect()}
    want, ends = 0, 0
    for i in (i for i in sets if i % 50 == 0):
        shared = Counter(j for g in sets[i] for j in index[g])
        linked = [j for j, n in shared.items() if j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
        linked += [j for j in sets if j != i and not sets[i] and not sets[j]]
        assert got[i][1] == len(linked) and all(got[j][0] == got[i][0] for j in linked), i
        want, ends = want + 1, ends + len(linked)
    assert want >= 10 and ends > 0


def test_archives_are_read_and_kept_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://x/{i}", (f"page {i % 7} " + words(i % 7, 400)) if i % 3 else f"small {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "kept")
    got = warc.archive_round_trip(df, folder=folder).collect()
    assert len(got) == 60 and all(r.intact for r in got)
    last = {k: max(i for i in range(60) if i % 7 == k and i % 3) for k in range(7)}
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {i: last[i % 7] for i in range(60) if i % 3 and i != last[i % 7]}
    archives = list((tmp_path / "kept" / "archives").glob("*.warc.gz"))
    assert len(archives) > 3 and not list((tmp_path / "kept" / "archives").glob("*.open"))
    import gzip

    heads = b"".join(gzip.decompress(a.read_bytes()) for a in archives)
    assert heads.count(b"WARC-Type: response") == 27 and heads.count(b"WARC-Type: revisit") == 33


def plain_article(html):
    """The article's blocks by a plain tree walk: what a page without trick markup must give."""
    from html.parser import HTMLParser

    skip, block = {"script", "style", "nav", "footer", "aside", "form"}, {"p", "h1", "h2", "li", "div", "article", "ul"}

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.text, self.deep, self.inside = [], [], 0, False

        def cut(self):
            t = " ".join("".join(self.text).split())
            self.out += [t] if t else []
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in block:
                self.cut() if self.inside else None
            self.inside |= tag == "article"
            self.deep += tag in skip

        def handle_endtag(self, tag):
            if tag in block:
                self.cut() if self.inside else None
            self.inside &= tag != "article"
            self.deep -= tag in skip

        def handle_data(self, data):
            if self.inside and not self.deep:
                self.text.append(data)

    tree = Tree()
    tree.feed(html)
    return "\n".join(tree.out)


def random_page(seed):
    r = random.Random(seed)
    parts = [f"<h1>{words(seed, 5)}</h1>"]
    for k in range(r.randint(2, 9)):
        kind = r.choice(["p", "p", "p", "short", "list", "inner", "form", "aside"])
        text = words(1000 * seed + k, r.randint(20, 90))
        parts.append({"p": f"<p>{text} &amp; <b>bold</b> end</p>", "short": "<p>Hm.</p>", "list": "<ul><li>one two</li><li>three</li></ul>", "inner": f"<div>{text}</div>", "form": "<form><p>Your name</p></form>", "aside": f"<aside><p>{text}</p></aside>"}[kind])
    menu = "".join(f'<li><a href="/{k}">{words(k + seed, 2)}</a></li>' for k in range(r.randint(3, 30)))
    return f"<html><head><title>x</title><script>a('</p>')</script></head><body><nav><ul>{menu}</ul></nav><div class='top-banner ad-slot'>{words(seed + 5, 9)}</div><article>{''.join(parts)}<p>{words(seed, 60)}</p></article><section id='comments'><p>{words(seed + 9, 70)}</p></section><footer>{words(seed + 2, 12)}</footer></body></html>"


def test_html_against_a_tree_walk():
    for seed in range(60):
        html = random_page(seed)
        assert html_extract.main_text(html) == plain_article(html), seed


def test_clusters_decide_what_no_name_tells(monkeypatch):
    story = [words(k, 60) for k in range(4)]
    menu = "".join(f'<a href="/{k}">{words(k, 2)}</a> ' for k in range(8))
    page = f"<body><div class=x1>{menu}</div><div class=x2><p>{story[0]}</p><p>{story[1]}</p></div><div class=x3>{menu}</div><div class=x4><p>{story[2]}</p><p>{story[3]}</p></div><div class=x5>{menu}</div></body>"
    assert html_extract.main_text(page) == "\n".join(story)
    monkeypatch.setattr(html_extract, "two_cluster_threshold", lambda values: float("-inf"))
    assert html_extract.main_text(page).count("\n") == 6
    assert "Foot" in html_extract.main_text(f"<body><article><p>{story[0]}</p></article><footer>Foot</footer></body>")


def test_html_of_any_depth_and_odd_markup():
    import time

    for n in (2000, 16000):
        for html in ("<div>" * n + "</b>" * n, "<div>x" * n, "<ul><li class=share><ul>" + "<div>" * n + "<li>" * n):
            start = time.perf_counter()
            html_extract.main_text(html)
            assert time.perf_counter() - start < 2 + n * 2e-4
    for odd in ("<![foo[x]]>", "<p>a<![foo[x]]>b", "<![", "<!doctype", "<a href='", "&#x110000;", "<p>x<![CDATA[y]]>z"):
        assert isinstance(html_extract.main_text(odd), str)
    long = words(3, 50)
    assert html_extract.main_text(f"<body><form action=x><nav>Menu</nav><article><p>{long}</p></article></form></body>") == long
    assert html_extract.main_text(f"<body><nav>Menu of the site</nav><footer>{long}</footer></body>") == ""
    for name, want in (("site-footer", 2), ("ad-slot", 2), ("main-nav", 1), ("has-sidebar", 0), ("content-sidebar-wrap", 0), ("menu-open", 0), ("cookieBanner", 2), ("page-with-comments", 0)):
        assert html_extract.name_mark(name) == want, name


def test_equal_pieces_are_spread_and_placed_once(spark):
    """A third of all rows equal, without ids: their ranks come from many salts, and no place is given twice."""
    rows = [(None, "")] * 3000 + [(i, words(i, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cut = packing.pieces(docs, "doc_id", "text")
    salts = packing.ranked(cut, "length", *[cut[c] for c in ("doc_id", "piece", "start", "ids_crc32", "number")])
    assert sorted(r[0] for r in salts.where("length = 1").select("__rank").collect()) == list(range(3000))
    by = {}
    for r in packing.packed(docs).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, by.values())) == 3060
    for own in by.values():
        ends = [0, *(a + b for a, b in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
