"""Page extraction on pages laid out by hand and on the given table; source divergence against brute force."""

import collections
import html
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glimmer.llm import divergence as D
from glimmer.llm import html_extract as H
from glimmer.llm import html_tree as T
from glimmer.llm import queries as Q

TABLES = "/root/testdata/sf0.001"
STORY = "The river rose again on Monday, and the ferry stayed at its pier. Nobody in the village was surprised by that."
MORE = "By noon the water had reached the second step of the mill, where a mark is cut for the year of the great flood."


@pytest.fixture(scope="module")
def model():
    return H.fitted(H.labelled_pages("the river rose again on monday and nobody was surprised by it although water reached old mill".split()))


def read(model, page):
    t, f = T.chunk([page])
    return T.block_text(t, 0, model.messages(f)[0][f.leaf] > 0.5)


AROUND = [
    ("<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<footer>&copy; 2024 The Paper. All rights reserved.</footer>"),
    ('<div id="header"><h1>The Paper</h1></div><div class="top-menu"><a href=/a>Home</a> | <a href=/b>News</a></div>', '<div class="footer"><p>Imprint and contact.</p></div>'),
    ('<div class="cookie-banner"><p>We use cookies to make this site better. Do you agree to that?</p><button>Yes</button></div><header><a href=/>The Paper</a></header>',
     f'<section id="comments"><h2>3 Comments</h2><div class="comment"><p>{MORE[::-1]} I do not agree with this at all, and I said so before.</p></div><form><textarea name=c></textarea><button>Send</button></form></section>'),
    ('<form class="search"><label>Search</label><input name=q></form><div class="ad">Buy two, get three. Only this week, only here.</div>',
     '<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Another story about rivers</a></li><li><a href=/y>Mills of the north</a></li></ul></aside>'),
    ('<div role="alert">A storm warning is in force for the coast until Tuesday.</div>', '<div class="newsletter-signup"><p>Get our letter every morning.</p><input type=email></div>'),
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", '<div class="article-body">{}</div>', '<main><article class="post">{}</article></main>'])
def test_layouts_by_hand(model, around, box):
    inside = f'<h1>High water</h1><p>{STORY}<div class="advert">Sale! Sale!</div><p>{MORE} <a href=/m>The mill</a> stands.</p><aside><h3>More</h3><a href=/x>Floods of the past</a></aside><p>So it goes.</p>'
    page = f"<!doctype html><html><head><title>High water</title><style>p{{}}</style></head><body>{around[0]}{box.format(inside)}{around[1]}<script>x='<p>no</p>'</script></body></html>"
    assert read(model, page) == f"High water\n{STORY}\n{MORE} The mill stands.\nSo it goes."


def test_held_out_layouts(model):
    t, f = T.chunk(H.labelled_pages("one two three four five six seven eight nine".split(), 200, seed=1234))
    wrong = H.labels(f)[f.leaf] != (model.messages(f)[0][f.leaf] > 0.5)
    assert wrong.mean() < 0.01


def test_markup(model):
    wrap = lambda x: read(model, f"<article><h1>T</h1><p>{STORY}</p>{x}</article>").removeprefix(f"T\n{STORY}").lstrip("\n")
    assert wrap("<p>a &lt;b&gt; &amp;amp; &#233;&#x4e2d; AT&amp;T &nbsp; x\n\t y</p>") == "a <b> &amp; é中 AT&T x y"
    assert wrap("<p>one<br>two <b>th</b>ree<i>!</i></p>") == "one two three!"
    assert wrap("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert wrap('<p title="a > b" data-x=\'"\'>quoted</p>') == "quoted"
    assert wrap("<p>before<!-- <p>gone</p> -->after</p>") == "beforeafter"
    assert wrap("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert wrap("<p>x</div></section></b>y</p>") == "x\ny"
    assert wrap("<p>kept<script>if (a < b) document.write('</p>')</script> too</p>") == "kept too"
    assert wrap("<p>kept<!-- open <p>gone") == "kept"


def test_messages_are_exact(model):
    """Marginals against the sum over all states of a small page."""
    t, f = T.chunk(["<div class=nav><a>x</a></div><p>some text here.</p>"])
    p, _ = model.messages(f)
    n = len(f.parent)
    score = f.features @ model.node
    weight, total = np.zeros(n), 0.0
    for s in range(1 << n):
        y = [s >> i & 1 for i in range(n)]
        e = sum(score[i] for i in range(n) if y[i])
        e += sum((model.child[f.kind[i]] + model.above[f.kind[f.parent[i]]])[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        weight += np.exp(e) * np.array(y)
        total += np.exp(e)
    assert np.allclose(p, weight / total, atol=1e-9)


def test_long_and_deep_pages(model):
    assert read(model, "") == "" and read(model, "<") == "<"
    deep = "<div>" * 3000 + STORY
    assert read(model, f"<article>{deep}") == STORY
    assert read(model, "<b>" * 20000 + STORY) == STORY
    for junk in ("<a " * 20000, "<a b='" * 20000, "<!--" * 20000, "<p" * 20000, "<li>" * 5000, "</div>" * 20000):
        read(model, junk)
    long = "<article>" + "".join(f"<p>{STORY} {i}</p>" for i in range(4000)) + "</article>"
    assert read(model, long).count("\n") == 3999


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"</?\w+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = Q.op11_html_extract(spark, TABLES).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)


def test_awkward_pages(spark, model):
    rows = [(1, "u", None), (None, None, "<p>" + STORY), (1, "u", ""), (7, "u", f"<article><p>{STORY}</article>"), (7, "u", f"<article><p>{STORY}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1)).withColumn("HTML_", F.lit(2))
    got = sorted(map(tuple, H.extract(df, model).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (None, None, STORY, len(STORY)), (1, "u", "", 0), (7, "u", STORY, len(STORY)), (7, "u", STORY, len(STORY))], key=repr)
    assert H.extract(df.limit(0), model).collect() == []


def test_training_on_an_empty_table(spark):
    assert H.train(spark.createDataFrame([], "page_id long, url string, html string")).node.any()


# --- divergence ---------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=3, top=200):
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = sum(n.values())
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (whole + v) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def test_divergence_of_given_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("lang", "source", "text")
    got = Q.op12_source_divergence(spark, TABLES)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs.collect()])


ODD = [
    ("en", "a", "Ab ab AB x1y É É ét é"), ("en", "b", "ab x y\x00é é é"), ("en", "b", "ab x y é \U0001f600 naïve"), ("en", "b", "ab x y é \U0001f600 naïve"), ("en", None, "ab \U0001f600 é"),
    ("en", "c", None), ("en", "d", ""), ("en", "d", "12 34 _ []"), (None, "a", "w w w"), (None, None, "w"), ("", "", "w q q"), ("de", "only", "eins zwei"), ("fr", "a", None), ("fr", "b", ""),
    ("en", "a", "q" * 5000 + " " + "ab " * 3000), ("en", "a", "ab"), ("en", "a", "ab"),
]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_awkward_documents(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    df = spark.createDataFrame(ODD, "lang string, source string, text string").withColumn("term", F.lit("t")).withColumn("n", F.lit(5)).withColumn("value", F.lit(1))
    assert sorted(map(tuple, D.divergence(df).collect())) == brute(ODD)
    assert sorted(map(tuple, D.divergence(df, 2, 3).collect())) == brute(ODD, 2, 3)
    assert D.divergence(df.limit(0)).collect() == []


def test_hash_collisions_are_told_apart():
    words = [w.encode() for w in "ab cd ab e fgh cd zz ab e".split()]
    data = b" ".join(words)
    start = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    end = start + [len(w) for w in words]
    for digest in (lambda b: 1, lambda b: len(b), xxhash.xxh3_64_intdigest):
        number, first = D.grouped_slices(data, start, end, digest)
        assert [words[first[k]] for k in number] == words
        assert len(first) == len(set(words))


def test_shares_are_exact():
    counts = [1, 7, 10**6, 10**12, 8 * 10**15]
    got = D.share(np.array(counts), np.int64(9 * 10**15))
    assert got.tolist() == [1 + 10**9 * c // (9 * 10**15) for c in counts]
