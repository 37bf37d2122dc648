"""Main text of web pages by wrapper induction.

Pages of one host come from one template.  A page's outline is the tree of its
elements without texts; the most common outline of a host is its mold.  Every
different outline of the host is aligned with the mold by simple tree matching,
so that each text of each page belongs to a place of the mold.  Over all
different pages of the host Spark counts how often a place holds which text: a
place that (nearly) always holds the same one is constant, hence template, the
others are slots.  A page's content is what stands in slots and, where it has
them, in its article or main element; a few short article cards beside a long
body do not count as the article.  Inside an article a place must repeat on
more pages to be template, and its title never is.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are known by their element, role, class or id, and are never content.

Runs of like neighbours (paragraphs, list items) count as one place, so
outlines stay small however long a page is.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import bound_batches, keep, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
                   r"|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE = re.compile(r"\s+")
NUMBER = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
                   "ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe svg button select option "
                  "textarea menu dialog head title object canvas audio video map input".split())
#: words of a class, id or role that mark something other than the article
OTHER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside "
                  "menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo complementary search "
                  "cookie cookies consent notice popup modal newsletter subscribe social share sharing related "
                  "comment comments reply replies disqus masthead toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
#: beginnings and ends of a class that tell of the page, not of the element: "has-sidebar"
TELLING = re.compile(r"^(?:has|no|with|without)[-_]|[-_](?:enabled|disabled)$")
DEPTH = 100  #: texts of elements nested deeper belong to the place above
SHARE = 0.9  #: of a host's pages with some text at a place, to make it constant
LEAST, LEAST_INSIDE = 2, 8  #: different pages that must agree, outside and inside an article
TEASER = 4  #: times as much text beside it makes an article a mere card
HOT = 1000  #: a host with more than this part of all pages is dealt over several tasks
ARTICLE, MAIN, ARTICLE_DOUBT, MAIN_DOUBT, BODY, TITLE = 1, 2, 4, 8, 16, 32
INSIDE = ARTICLE | MAIN | ARTICLE_DOUBT | MAIN_DOUBT


class Node:
    __slots__ = ("tag", "key", "other", "firm", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, words, whole, self.key = tag, [], [], [], tag
        role = ""
        if attributes and "=" in attributes:
            for name, a, b, c in MARKS.findall(attributes):
                value = (a or b or c).lower()
                words += [w for c in value.split() if not TELLING.search(c) for w in re.split(r"[_-]+", c)]
                whole += value.split()
                if name.lower() == "role":
                    role = value
                else:
                    self.key += "." + NUMBER.sub("0", value)
        if role == "main":
            self.tag = "main"
        self.other = tag in NEVER or (tag not in ("html", "body", "main", "article") and not OTHER.isdisjoint(words)) \
            or (tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(words)) \
            or role in ("banner", "alert", "form")
        # marked by more than a part of a name such as "has-sidebar"
        self.firm = self.other and (tag in NEVER or tag == "article" or role in ("banner", "alert", "form")
                                    or not OTHER.isdisjoint(whole))


def parse(page: str) -> Node:
    """The page's tree; tags that HTML lets go unclosed are closed as browsers do."""
    root = Node("html")
    stack, at, length = [root], 0, len(page)
    while at < length:
        found = TOKEN.search(page, at)
        text = page[at:found.start() if found else length]
        if text:
            stack[-1].kids.append(html.unescape(text))
        if not found:
            break
        at, name = found.end(), found.group(1)
        if not name:
            continue
        tag = name.lower()
        if page[found.start() + 1] == "/":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag or stack[depth].key.split(".", 1)[0] == tag:
                    del stack[depth:]
                    break
            else:
                if tag in ("br", "p"):
                    stack[-1].kids.append(Node("br" if tag == "br" else "p"))
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        if tag not in INLINE:
            closes, limits = CLOSES.get(tag, ()), LIMITS.get(tag, ())
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth].tag
                if open_ == "p" or open_ in closes:
                    del stack[depth:]
                    if open_ != "p":
                        break
                elif open_ in limits or (open_ not in INLINE and open_ not in CLOSES and not closes):
                    break
        node = Node(tag, found.group(2))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = length if not end or close < 0 else close + 1
        elif tag not in VOID and not (found.group(2) or "").rstrip().endswith("/"):
            stack.append(node)
    return root


def tree_of(root: Node) -> tuple[list, dict[int, int]]:
    """The outline, [key, children], and the place (its number in preorder) of every element.

    Inline elements belong to their block's place, like neighbours share one.
    Built bottom-up without recursion.
    """
    done: dict[int, tuple[list, list]] = {}
    work = [(root, 0, False)]
    while work:
        here, depth, ready = work.pop()
        inner = [k for k in here.kids if isinstance(k, Node) and k.tag not in INLINE and k.tag != "br"
                 and not k.firm] if depth < DEPTH else []
        if not ready:
            work.append((here, depth, True))
            work.extend((k, depth + 1, False) for k in inner)
            continue
        kids, groups = [], []
        for kid in inner:
            tree = done[id(kid)][0]
            if kids and kids[-1] == tree:
                groups[-1].append(kid)
            else:
                kids.append(tree)
                groups.append([kid])
        done[id(here)] = ([here.key, kids], groups)
    places: dict[int, int] = {}
    todo, number = [[root]], 0
    while todo:
        alike = todo.pop()
        for node in alike:
            places[id(node)] = number
        number += 1
        groups = [done[id(node)][1] for node in alike]
        todo.extend([n for own in groups for n in own[k]] for k in reversed(range(len(groups[0]))))
    return done[id(root)][0], places


def blocks_of(root: Node, places: dict[int, int]) -> tuple[list[tuple[int, int, str]], bool]:
    """((flags, place, text) of every block in page order, is there an article or main element at all?).

    White space inside a block is one space.  Flags tell the elements around it;
    what is beyond doubt no content is left out.
    """
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    owner, marked = (0, 0), False

    def end() -> None:
        text = WHITE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append((*owner, text))

    work = [(root, 0, BODY, False, 0)]
    while work:
        here, i, flags, doubt, place = work.pop()
        while i < len(here.kids):
            kid = here.kids[i]
            i += 1
            if isinstance(kid, str):
                if flags:
                    if not run or not owner[0] or not "".join(run).strip():
                        owner = (flags, place)
                    run.append(kid)
            elif kid.tag == "br":
                run.append(" ")
            elif kid.firm or kid.other and flags & INSIDE:
                if kid.tag not in INLINE:
                    end()
            else:
                inner, unsure = flags, doubt or kid.other
                if not flags & INSIDE and (kid.other or kid.tag == "header"):
                    inner = 0
                if kid.tag in ("article", "main"):
                    marked = True
                    inner |= {("article", False): ARTICLE, ("main", False): MAIN,
                              ("article", True): ARTICLE_DOUBT, ("main", True): MAIN_DOUBT}[kid.tag, unsure]
                elif kid.tag == "h1" and flags & INSIDE:
                    inner |= TITLE
                if kid.tag not in INLINE:
                    end()
                work.append((here, i, flags, doubt, place))
                work.append((kid, 0, inner, unsure, places.get(id(kid), place)))
                break
        else:
            if here.tag not in INLINE:
                end()
    end()
    return out, marked


def choose(blocks: list[tuple[int, int, str]], marked: bool, template: Callable[[int, int], bool]) -> str:
    """The content among the blocks; ``template(n, inside)`` tells whether block n is constant.

    The first of these that has text and is no mere card: articles, main
    elements, then either inside elements that only a part of a class name
    speaks against; else everything in slots.  Content that is constant
    throughout stays, as does an empty article's page empty.
    """
    slots = [n for n, (flags, _, _) in enumerate(blocks)
             if flags & TITLE or not template(n, bool(flags & INSIDE))]
    around = sum(len(blocks[n][2]) for n in slots if blocks[n][0] & BODY)
    any_inside = False
    for kind in (ARTICLE, MAIN, ARTICLE_DOUBT, MAIN_DOUBT):
        whole = [n for n, b in enumerate(blocks) if b[0] & kind]
        any_inside |= bool(whole)
        own = [n for n in slots if blocks[n][0] & kind] or whole
        if own and TEASER * sum(len(blocks[n][2]) for n in own) >= around:
            return "\n\n".join(blocks[n][2] for n in own)
    if marked and not any_inside:
        return ""
    return "\n\n".join(blocks[n][2] for n in slots if blocks[n][0] & BODY)


def main_text(page: str) -> str:
    """The main text of a page whose host has no wrapper."""
    blocks, marked = blocks_of(parse(page), {})
    return choose(blocks, marked, lambda n, inside: False)


def match(a: list, b: list) -> tuple[int, list[tuple[int, int, list]]]:
    """Simple tree matching: size of the largest top-down match and the matched children."""
    if a[0] != b[0]:
        return 0, []
    if a == b:
        pairs = [(i, i, match(k, k)[1]) for i, k in enumerate(a[1])]
        return 1 + sum(map(weight, a[1])), pairs
    m, n = len(a[1]), len(b[1])
    size = [[0] * (n + 1) for _ in range(m + 1)]
    inner = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            if a[1][i - 1][0] == b[1][j - 1][0]:
                inner[i, j] = match(a[1][i - 1], b[1][j - 1])
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + inner.get((i, j), (0,))[0])
    pairs, i, j = [], m, n
    while i and j:
        got = inner.get((i, j))
        if got and size[i][j] == size[i - 1][j - 1] + got[0]:
            pairs.append((i - 1, j - 1, got[1]))
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size[m][n] + 1, pairs[::-1]


def weight(tree: list) -> int:
    return 1 + sum(map(weight, tree[1]))


def numbered(tree: list, first: int = 0) -> tuple[int, list]:
    """[place, children] of an outline and the place after its last."""
    kids, after = [], first + 1
    for kid in tree[1]:
        after, made = numbered(kid, after)
        kids.append(made)
    return after, [first, kids]


def aligned(tree: list, mold: list) -> list[int]:
    """For every place of an outline its place in the mold, or -1."""
    count, own = numbered(tree)
    found = [-1] * count
    work = [(own, numbered(mold)[1], match(tree, mold)[1])]
    found[0] = 0
    while work:
        here, there, pairs = work.pop()
        for i, j, inner in pairs:
            found[here[1][i][0]] = there[1][j][0]
            work.append((here[1][i], there[1][j], inner))
    return found


def host_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"://([^/?#]*)", 1), F.lit(""))


def text_hash(texts: Iterable[str]) -> int:
    made = blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(made, "big", signed=True)


def packed(texts: Iterable[str]) -> bytes:
    return zlib.compress("\n".join(texts).encode("utf-8", "replace"))


def unpacked(data: bytes, count: int) -> list[str]:
    return zlib.decompress(data).decode().split("\n") if count else []


def held_at(places: Iterable[int], texts: Iterable[str]) -> dict[int, int]:
    """The hash of all text of every place that has some."""
    at: dict[int, list[str]] = {}
    for place, text in zip(places, texts):
        at.setdefault(place, []).append(text)
    return {place: text_hash(own) for place, own in at.items()}


def survey(pages: DataFrame) -> DataFrame:
    """(id, url, host, outline, marked, flags, spots, packed, held) of every page, parsed once.

    ``spots`` are the blocks' places and ``packed`` their texts, one a line (no
    block has a line feed), compressed, because they travel twice; ``held`` pairs each place that has text
    with a hash of all its text.
    """
    kind = dict(pages.dtypes)["id"]
    schema = (f"id {kind}, url string, host string, outline string, marked boolean, flags array<int>, "
              "spots array<int>, packed binary, held array<struct<place: int, hash: long>>")
    types = [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(),
             pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 4 << 20):
            rows = []
            for page in batch.column(3).to_pylist():
                root = parse(page or "")
                tree, places = tree_of(root)
                blocks, marked = blocks_of(root, places)
                at = held_at((b[1] for b in blocks), (b[2] for b in blocks))
                rows.append((json.dumps(tree, separators=(",", ":")), marked, [b[0] for b in blocks],
                             [b[1] for b in blocks], packed(b[2] for b in blocks),
                             [{"place": p, "hash": h} for p, h in at.items()]))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made],
                                             ["id", "url", "host", "outline", "marked", "flags", "spots", "packed", "held"])
    return pages.select("id", "url", "host", "html").mapInArrow(run, schema)


def wrappers(known: DataFrame, hot: DataFrame) -> DataFrame:
    """(host, shape, to_mold, constant) of every outline of every host, from all surveyed pages.

    ``to_mold`` are the mold's places for those of the outline; ``constant``
    lists the mold's constant places with their text's hash and the pages that
    have it.  Equal pages of a host count once.
    """
    shapes = known.groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("outline").alias("outline"))
    molds = shapes.groupBy("host").agg(F.max_by("outline", F.struct("n", "shape")).alias("mold"))
    pairs = dealt(shapes, hot, "shape").join(spread(molds, hot), ["host", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            found = [aligned(json.loads(a), json.loads(b))
                     for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             ["host", "shape", "to_mold"])
    fitted = keep(pairs.select("host", "shape", "outline", "mold").mapInArrow(
        run, "host string, shape long, to_mold array<int>"), "outlines")
    different = known.groupBy("host", "shape", F.xxhash64("held").alias("print")).agg(F.first("held").alias("held"))
    placed = dealt(different, hot, "print").join(spread(fitted, hot), ["host", "shape", "salt"]).select(
        "host", "to_mold", F.explode("held").alias("one")).select(
        "host", F.element_at("to_mold", F.col("one.place") + 1).alias("place"), F.col("one.hash").alias("hash")).where("place >= 0")
    texts = placed.groupBy("host", "place", "hash").agg(F.count("*").alias("n"))
    constant = texts.groupBy("host", "place").agg(
        F.sum("n").alias("pages"), F.max("n").alias("same"), F.max_by("hash", "n").alias("hash")).where(
        (F.col("same") >= LEAST) & (F.col("same") >= SHARE * F.col("pages"))).groupBy("host").agg(
        F.collect_list(F.struct("place", "hash", "same")).alias("constant"))
    return dealt(fitted, hot, "shape").join(spread(constant, hot), ["host", "salt"]).select(
        "host", "shape", "to_mold", "constant")


def dealt(rows: DataFrame, hot: DataFrame, *by: str) -> DataFrame:
    """``rows`` with a salt: a hash of ``by`` within the parts of their host."""
    return rows.join(F.broadcast(hot), "host", "left").withColumn(
        "salt", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1)))).drop("parts")


def spread(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` once for every part of their host."""
    return rows.join(F.broadcast(hot), "host", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    ``text`` is the main text of the whole page, blocks in page order joined by
    two line feeds, character references decoded and white space inside a block
    made one space; empty for null or empty pages.  Pages whose url is null or
    has no host share the empty host.  A host with one page has no template to
    learn; pages that are equal count as one.  Repeated rows are each answered;
    other columns are not read.

    Pages are parsed once; no html is shuffled.  A host with more than a
    thousandth of all pages is dealt over tasks in proportion, so at most a
    thousand hosts are broadcast for that.
    """
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                      F.col(f"`{html_col}`").alias("html"))
    bound_batches(df.sparkSession, "8m")
    known = keep(survey(pages.withColumn("host", host_of("url"))), "survey").withColumn("shape", F.xxhash64("outline"))
    total = known.count()
    hot = keep(known.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select(
        "host", F.ceil(F.col("n") * HOT / max(1, total)).cast("long").alias("parts")), "hot_hosts")
    learned = wrappers(known, hot)
    joined = dealt(known, hot, "packed", "id").join(spread(learned, hot), ["host", "shape", "salt"], "left").select(
        "id", "url", "marked", "flags", "spots", "packed", "to_mold", "constant")
    kind = dict(joined.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5, 1 << 20):
            texts = []
            for marked, flags, spots, data, to_mold, constant in zip(*(c.to_pylist() for c in batch.columns[2:])):
                own = unpacked(data, len(spots))
                pages_with = {(c["place"], c["hash"]): c["same"] for c in constant or ()}
                same = {p: pages_with.get((to_mold[p], h), 0) for p, h in held_at(spots, own).items()} if constant else {}
                texts.append(choose(list(zip(flags, spots, own)), marked, lambda n, inside: same.get(
                    spots[n], 0) >= (LEAST_INSIDE if inside else LEAST)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
