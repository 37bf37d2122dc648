import json
from collections import Counter, defaultdict
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapwise.llm import html_extract
from gapwise.llm.html_extract import LEAST, LEAST_INSIDE, SHARE, blocks_of, choose, main_text, parse, tree_of

PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    return {r["id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


def by_hand(rows):
    """Every host's mold, counts and choice with dictionaries over all pages."""
    seen, out = defaultdict(dict), {}
    for number, url, page in rows:
        host = url.split("://")[1].split("/")[0]
        root = parse(page)
        tree, places = tree_of(root)
        blocks, marked = blocks_of(root, places)
        seen[host][number] = (json.dumps(tree), tree, blocks, marked)
    for host, pages in seen.items():
        mold = json.loads(Counter(p[0] for p in pages.values()).most_common(1)[0][0])
        texts, different = defaultdict(Counter), set()
        for shape, tree, blocks, _ in pages.values():
            to, at = html_extract.aligned(tree, mold), defaultdict(list)
            for _, place, text in blocks:
                at[place].append(text)
            once = (shape, repr(sorted(at.items())))
            if once not in different:
                different.add(once)
                for place, held in at.items():
                    texts[to[place]][tuple(held)] += 1
        for number, (_, tree, blocks, marked) in pages.items():
            to, at = html_extract.aligned(tree, mold), defaultdict(list)
            for _, place, text in blocks:
                at[place].append(text)

            def template(n, inside):
                place = blocks[n][1]
                counts = texts[to[place]]
                held, same = counts.most_common(1)[0]
                return (to[place] >= 0 and tuple(at[place]) == held and same >= SHARE * sum(counts.values())
                        and same >= (LEAST_INSIDE if inside else LEAST))
            out[number] = choose(blocks, marked, template)
    return out


def site(n, kind, extra=""):
    body = f"<h1>Title</h1><p>first {n}</p><p>second {n}</p><div class=x>Share this article</div><div class=y>by {n}</div>"
    if kind == "article":
        return f"<body><div>Welcome</div><article>{body}</article>{extra}<div>All rights</div></body>"
    return f"<body><div>Welcome</div><div class=post-{n}>{body}</div>{extra}<div>All rights</div></body>"


def test_wrapper_against_dictionaries(spark):
    rows = []
    for n in range(40):
        rows.append((n, "http://hot.com/a", site(n, "article", "<div><i>x</i></div>" if n % 7 == 0 else "")))
    rows += [(100 + n, "http://open.org/", site(n, "open", "<ul><li>a<li>b</ul>" if n % 3 == 0 else "")) for n in range(11)]
    rows += [(200 + n, "http://few.net/", site(n, "article")) for n in range(3)]
    rows += [(300 + n, "http://copies.net/", site(1, "article")) for n in range(20)]
    got = texts_of(spark, rows)
    assert got == by_hand(rows)
    assert got[5] == "Title\n\nfirst 5\n\nsecond 5\n\nby 5"  # the line that all articles share is template
    assert got[101] == "first 1\n\nsecond 1\n\nby 1"
    assert "Share this article" in got[200] and "Share this article" in got[300]  # too few different pages to tell


def test_a_hot_host_is_dealt_over_tasks(spark):
    df = spark.createDataFrame([(n, "http://h/", site(n, "article")) for n in range(50)], PAGES)
    hot = spark.createDataFrame([("h", 7)], "host string, parts long")
    rows = df.withColumn("host", html_extract.host_of("url"))
    salts = html_extract.dealt(rows, hot, "page_id").groupBy("salt").count().collect()
    assert len(salts) > 3 and sum(r["count"] for r in salts) == 50 and {r["salt"] for r in salts} <= set(range(7))
    assert html_extract.spread(rows.where("page_id = 1"), hot).select("salt").distinct().count() == 7


def test_cards_and_telling_classes():
    long = "words of the body " * 20
    assert main_text(f"<article>card</article><div><p>{long}</p></div><article>next</article>") == \
        f"card\n\n{long.strip()}\n\nnext"
    assert main_text(f"<article><div class='entry has-sidebar no-comments'>{long}</div></article>") == long.strip()
    assert main_text("<article><p>a</p><div class='comment-list'>c</div></article><p>z</p>") == "a"
    assert main_text("<article></article><p>menu</p>") == ""


def test_rows_without_a_page_and_repeats(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "x", "<p>b</p>"), (2, "http://h/", None), (3, "http://h/", "")]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("salt", F.lit(2))
    got = sorted((r["id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()
                 if r["id"] != 1)
    assert got == [(0, "x", "b", 1), (2, "http://h/", "", 0), (3, "http://h/", "", 0)]
    assert html_extract.extract(df).where("id = 1").count() == 2


trees = st.recursive(st.sampled_from("ab").map(lambda k: [k, []]), lambda kids: st.tuples(
    st.sampled_from("ab"), st.lists(kids, max_size=3)).map(list), max_leaves=7)


@settings(max_examples=150, deadline=None)
@given(trees, trees)
def test_match_is_the_largest_ordered_one(a, b):
    def frozen(t):
        return t[0], tuple(map(frozen, t[1]))

    @cache
    def best(x, y):
        if x[0] != y[0]:
            return 0

        @cache
        def forest(i, j):
            if i == len(x[1]) or j == len(y[1]):
                return 0
            return max(forest(i + 1, j), forest(i, j + 1), best(x[1][i], y[1][j]) + forest(i + 1, j + 1))
        return 1 + forest(0, 0)
    assert html_extract.match(a, b)[0] == best(frozen(a), frozen(b))
    to = html_extract.aligned(a, b)
    assert len(to) == html_extract.weight(a) and len({t for t in to if t > 0}) == sum(t > 0 for t in to)
