"""HTML extraction by equivalence-class template deduction.

The pages of a host are made from templates. A page is read as a sequence of template tokens: an
element's path of tags (with class and id names), or a text block under such a path, each with
the number of its occurrence on the page. Tokens that stand in the same pages of the host form an
equivalence class. A class counts if it is large and frequent enough; its tokens must keep their
place among each other on all its pages, and it must nest: of two classes, one lies in a slot of
the other or beside it. What the template leaves open are slots: the text below each path. A text
block that is itself a token of such a class, in at least half of the pages that have its path,
is a fixed slot.

Page sets are never gathered: a token sums up a 64-bit additive fingerprint of its pages, and
equal sums make a class. A host with a third of all pages is therefore pre-aggregated in every
task like any other. Classes without a fixed text have nothing to cut and are not ordered or
nested.

The fixed slots of the host's template are cut out of every page first. What is left is the
page's own text, and the slot that holds it is the main slot: the innermost container with
four fifths of a page's own text, if at least MIN_PAGES of the host's pages, and a quarter of all, agree
on it. Everything outside of the main slot is cut. An article or main element, which HTML defines,
is the main slot of its page; without either and without a main slot (a host with few pages),
names of elements and the share of links are what is left as evidence.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._base import small_batches, text_or_empty, written

# Element kinds and the names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside select option input menu dialog head script style noscript template textarea title iframe svg math object".split())
MAIN = frozenset(["article", "main"])
#: Elements of text, which are no container of a page's content.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary address hgroup".split())
#: Names that count inside an article or a main slot: adverts, reader comments, sidebars, notices.
INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|adsby\w*|advert\w*|sponsor\w*|comments?|commentlist|sidebar\w*)(?:$|[\s_-])|(?:^|[\s_-])notices?(?:$|\s)", re.I)
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adsby\w*|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|cookie\w*|consent|notice\w*|alert|gdpr|newsletter\w*|subscrib\w*|signup|login|search\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|popular|trending|widget\w*|comments?|commentlist|disqus|replies|reply|respond|reader-?\w*|popup|modal|overlay|paywall|toolbar|pagination|pager|tags?|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A class counts when it has so many tokens and stands in so many pages.
MIN_TOKENS, MIN_PAGES = 2, 3
#: A text is fixed if it stands in this share of the pages that have its path; a block with this share of links is no content.
VARIES = 0.5
#: Share of a page's own text that its main slot holds; share of links from which a block without any other evidence is a menu.
HOLDS, LINKED = 0.8, 0.8

_TOKEN = re.compile(r"""[^<]+|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: A start tag on the left ends open elements on the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), {"p"})


@lru_cache(maxsize=50_000)
def _attributes(name: str, rest: str) -> tuple[str, str, bool, bool]:
    """Of a start tag: its label, its role, whether its name marks boilerplate, and whether it does inside an article."""
    named = {k.lower(): (v or "").strip("\"'") for k, v in _NAMED.findall(rest)} if rest else {}
    label = re.sub(r"\d+", "0", " ".join(filter(None, (named.get("class"), named.get("id")))))
    role = named.get("role", "").lower()
    # A form is dropped like what a name marks: some hosts put the whole page in one.
    form = name == "form" or role == "form"
    told = name not in INLINE | MAIN | {"body", "html"}
    marks = [form or (told and bool(label and names.search(label))) for names in (NAMES, INSIDE)]
    return label, role, *marks


@lru_cache(maxsize=50_000)
def _path(up: int, name: str, label: str) -> int:
    return _h("p", up, name, label)


class _Open:
    """An open element: boilerplate by kind (dropped), inside the main element, the marked element around it, the block element around it."""

    __slots__ = ("name", "path", "dropped", "main", "mark", "block", "blocks", "closed")

    def __init__(self, name, path, dropped, main, mark, block, blocks):
        self.name, self.path, self.dropped, self.main, self.mark, self.blocks, self.closed = name, path, dropped, main, mark, blocks, False
        self.block = block or self


class _Block:
    __slots__ = ("path", "parts", "linked", "state", "main", "at", "mark")

    def __init__(self, path, state, main, at, mark):
        self.path, self.parts, self.linked, self.state, self.main, self.at, self.mark = path, [], 0, state, main, at, mark


class _Stack:
    """The open elements; every step takes constant time on average, however deep the page is."""

    def __init__(self):
        self.items = [_Open("", 0, False, False, -1, None, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.links = 0

    def push(self, item: _Open) -> None:
        self.places[item.name].append(len(self.items))
        self.items.append(item)
        self.links += item.name == "a"

    def last(self, names) -> int:
        """Where the innermost open element of these names stands; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, at: int) -> None:
        """Close all from there on."""
        while len(self.items) > at or (len(self.items) > 1 and self.items[-1].closed):
            item = self.items.pop()
            if not item.closed:
                self.places[item.name].pop()
                self.links -= item.name == "a"

    def close(self, at: int) -> None:
        """Close one element only; the ones inside stay open."""
        item = self.items[at]
        item.closed = True
        self.places[item.name].pop()
        self.links -= item.name == "a"
        self.cut(len(self.items))


def read_page(source: str, around: dict[int, tuple[int, bool]] | None = None) -> tuple[list[int], list[tuple[int, str, int, bool, bool, int, int]], list[int]]:
    """(element paths in page order, text blocks in page order, marks).

    A block is (path, text, linked characters, dropped, main, elements before it, mark); mark is
    the number of the innermost element around it whose name marks boilerplate, or -1, and marks
    has the number of the next one around each. Paths are hashes; `around` is filled with the path
    around each and whether it is a container.

    Any input is read: unclosed elements end where HTML says they do or with the page, stray end
    tags are passed over, and what is no tag is text.
    """
    paths: list[int] = []
    blocks: list[_Block] = []
    marks: list[int] = []
    stack = _Stack()
    block: _Block | None = None
    raw = ""

    def text(value: str) -> None:
        nonlocal block
        top = stack.items[-1]
        if block is None:
            at = top.block
            block = _Block(at.path, top.dropped, at.main, len(paths), at.mark)
            blocks.append(block)
        elif block.state != top.dropped:
            block = _Block(block.path, top.dropped, block.main, len(paths), block.mark)
            blocks.append(block)
        block.parts.append(value)
        if stack.links:
            block.linked += len(value)

    for match in _TOKEN.finditer(source):
        closing, name, rest = match.groups()
        if name is None:
            token = match[0]
            if raw:
                continue
            if token.startswith("<![CDATA["):
                text(html.escape(token[9:].removesuffix("]]>")))
            elif token[0] != "<" or len(token) == 1:
                text(token)
            continue
        name = name.lower()
        if raw:
            if closing and name == raw:
                raw = ""
            continue
        if closing:
            at = stack.last((name,))
            if at and (name not in INLINE or at == len(stack.items) - 1):
                # A block element ends what is open in it; an inline one only itself.
                if stack.items[-1].blocks > stack.items[at].blocks or name not in INLINE:
                    block = None
                stack.cut(at)
            elif at:
                if stack.items[-1].blocks > stack.items[at].blocks:
                    block = None
                stack.close(at)
            elif name in ("p", "br"):
                block = None
            continue
        if name == "br" or name == "hr":
            if block is not None and name == "br":
                block.parts.append(" ")
            else:
                block = None
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            block = None
            at = stack.last(_ENDS.get(name, ()))
            if at and stack.last(("table", "ul", "ol", "dl")) <= at:
                stack.cut(at)
        if name in RAW and not rest.endswith("/"):
            raw = name
            continue
        up = stack.items[-1]
        label, role, marked, marked_inside = _attributes(name, rest)
        dropped = up.dropped or role in ROLES or (name in DROPPED and not (name == "header" and up.main))
        main = up.main or ((name in MAIN or role == "main") and not dropped)
        mark = up.mark
        paths.append(_path(up.path, name, label))
        if around is not None:
            around[paths[-1]] = up.path, name not in TEXTUAL
        if marked_inside if up.main else marked:
            mark = len(marks)
            marks.append(up.mark)
        inline = name in INLINE
        stack.push(_Open(name, paths[-1], dropped, main, mark, up.block if inline else None, up.blocks + (not inline)))
    return paths, [(b.path, t, min(b.linked, len(t)), b.state, b.main, b.at, b.mark) for b in blocks if (t := " ".join(html.unescape("".join(b.parts)).split()))], marks


def _h(*parts) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def text_tokens(blocks: list[tuple]) -> list[int]:
    """The template token of each text block: its path, its text and how often both stood before on the page."""
    seen: Counter = Counter()
    out = []
    for path, text, *_ in blocks:
        seen[path, text] += 1
        out.append(_h("t", path, text, seen[path, text]))
    return out


def page_tokens(source: str) -> list[tuple[int, int, bool]]:
    """The template tokens of a page in page order: (token, first token of its path, whether it is a text)."""
    paths, blocks, _ = read_page(source)
    seen: Counter = Counter()
    out = [(_h("e", "", 1), _h("e", "", 1), False)]
    texts = list(zip(blocks, text_tokens(blocks), strict=True))[::-1]
    for at in range(len(paths) + 1):
        while texts and texts[-1][0][5] <= at:
            block, token = texts.pop()
            out.append((token, _h("e", block[0], 1), True))
        if at < len(paths):
            path = paths[at]
            seen[path] += 1
            out.append((_h("e", path, seen[path]), _h("e", path, 1), False))
    return out


def _host_column(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _crossed(places: dict[int, list[int]], pages: dict[int, int]) -> set[int]:
    """Of classes with their tokens' places on a page: those that cross a class of more pages."""
    out = set()
    inside = lambda a, b: bisect_left(a, b[-1]) > bisect_left(a, b[0])
    for a, b in combinations(sorted(places, key=lambda c: (-pages[c], c)), 2):
        if inside(places[a], places[b]) and inside(places[b], places[a]):
            out.add(b)
    return out


def deduce_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, token, class): the fixed text tokens of each host's template.

    Pages are read once, to a written table of their tokens. Tokens are summed by (host, token):
    the additive fingerprint of their pages, in two halves of 32 bits, and their number; then they
    are put in classes by (host, fingerprint). Of hosts with a fixed text, each token's place
    within its class is taken on each page, and classes that cross; a token keeps order if its
    place is the same on all pages. All classes with a fixed text are listed for each host: a
    fixed text stands in half of its path's pages, so there are at most two for each numbered path
    of the host, whatever the number of its pages.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_tokens(source) for source in batch["html"]]
            yield pd.DataFrame({"host": [host_of(u) for u in batch["url"]], "mark": [_h(i, u) for i, u in zip(batch["id"], batch["url"], strict=True)], **{c: [[t[k] for t in f] for f in found] for k, c in enumerate(("token", "under", "text"))}})

    known = written(rows.mapInPandas(read, "host string, mark long, token array<long>, under array<long>, text array<boolean>"))
    each = known.select("host", "mark", F.explode(F.arrays_zip("token", "under", "text")).alias("t")).select("host", "mark", "t.*")
    low, high = F.sum(F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned("mark", 32))
    tokens = each.groupBy("host", "token").agg(F.xxhash64(low, high).alias("print"), F.count("*").alias("pages"), F.first("under").alias("under"), F.first("text").alias("text"))
    tokens = written(tokens.where(F.col("pages") >= MIN_PAGES).withColumn("class", F.xxhash64("print", "pages")).drop("print"))
    under = tokens.where("NOT text").select("host", F.col("token").alias("under"), F.col("pages").alias("of"))
    fixed = tokens.where("text").join(under, ["host", "under"]).where(F.col("pages") >= VARIES * F.col("of")).select("host", "token", F.lit(True).alias("fixed"))
    marked = tokens.join(fixed, ["host", "token"], "left")
    classes = marked.groupBy("host", "class").agg(F.count("*").alias("size"), F.count("fixed").alias("n_fixed")).where((F.col("size") >= MIN_TOKENS) & (F.col("n_fixed") > 0))
    members = written(marked.join(classes.select("host", "class"), ["host", "class"]).select("host", "token", "class", "pages", F.col("fixed").isNotNull().alias("fixed")))
    listed = members.groupBy("host").agg(F.collect_list(F.struct("token", "class", "pages")).alias("m"))
    listed = written(listed.select(F.col("host").alias("t_host"), "m.token", "m.class", "m.pages"))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts: dict = {}
            got: dict = {}
            for host, tokens, of_token, cls, n in zip(batch["t_host"], batch["tokens"], batch["token"], batch["class"], batch["pages"], strict=True):
                if host not in hosts:
                    hosts[host] = dict(zip(map(int, of_token), map(int, cls), strict=True)), dict(zip(map(int, cls), map(int, n), strict=True))
                of, support = hosts[host]
                places: dict = defaultdict(list)
                ranks = []
                for at, t in enumerate(map(int, tokens)):
                    if t in of:
                        ranks.append((t, len(places[of[t]])))
                        places[of[t]].append(at)
                crossed = _crossed(places, support)
                for t, rank in ranks:
                    first, last, bad = got.get((host, t), (rank, rank, False))
                    got[host, t] = min(first, rank), max(last, rank), bad or of[t] in crossed
            yield pd.DataFrame([(*k, *v) for k, v in got.items()], columns=["host", "token", "low", "high", "crossed"])

    again = known.select("host", F.col("token").alias("tokens")).join(listed, F.col("host") == F.col("t_host")).select("t_host", "tokens", "token", "class", "pages")
    seen = again.mapInPandas(order, "host string, token long, low long, high long, crossed boolean")
    good = seen.groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("crossed").alias("crossed")).where("low = high AND NOT crossed").select("host", "token")
    kept = written(members.join(good, ["host", "token"]))
    large = kept.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_TOKENS).select("host", "class")
    return kept.where("fixed").join(large, ["host", "class"]).select("host", "token", "class")


def main_slot(source: str, fixed: set[int] | None = None) -> int | None:
    """The innermost container that holds most of the page's own text, as a path; None if it has none."""
    around: dict[int, tuple[int, bool]] = {}
    _, blocks, _ = read_page(source, around)
    tokens = text_tokens(blocks) if fixed else ()
    held: Counter = Counter()
    for k, b in enumerate(blocks):
        if not b[3] and not (fixed and tokens[k] in fixed):
            held[b[0]] += len(b[1]) - b[2]
    total = sum(held.values())
    depth: dict[int, int] = {}
    for path, (up, _) in around.items():  # an element stands before those in it
        depth[path] = depth.get(up, 0) + 1
    for path, (up, _) in reversed(around.items()):
        held[up] += held[path]
    enough = [p for p, (_, container) in around.items() if container and total and held[p] >= HOLDS * total]
    return max(enough, key=depth.__getitem__, default=None)


def extract_main(source: str, fixed: set[int] | None = None, slots: list[int] | None = None) -> str:
    """The main text of one page; `fixed` are the fixed text tokens of its host's template, `slots` its main slots.

    Fixed slots are cut out, inside and outside of articles. With an article or main element,
    what is left in it is the main text; else what is left in the first of the main slots that the page
    has; else all that is not mostly links. An article with nothing but fixed text stays whole: its
    page is a copy, and no template.

    An element whose name marks boilerplate, or a form, is dropped if what is left in it is mostly links, or
    less than half of what the page has left without links; one that holds more is its content. Inside
    an article only names of adverts, comments, sidebars and notices count.
    """
    around: dict[int, tuple[int, bool]] = {}
    _, blocks, marks = read_page(source, around)
    cut = {b for b, t in enumerate(text_tokens(blocks)) if t in fixed} if fixed else ()
    own, size, linked = 0, [0] * len(marks), [0] * len(marks)
    for k, b in enumerate(blocks):
        if not b[3] and k not in cut:
            own += len(b[1]) - b[2]
            if b[6] >= 0:
                size[b[6]] += len(b[1])
                linked[b[6]] += b[2]
    for m in range(len(marks) - 1, -1, -1):  # an element has a higher number than the one around it
        if marks[m] >= 0:
            size[marks[m]] += size[m]
            linked[marks[m]] += linked[m]
    kept: list[bool] = []
    for m, up in enumerate(marks):
        kept.append(linked[m] < VARIES * size[m] and size[m] - linked[m] >= VARIES * own and (up < 0 or kept[up]))
    left = [(k, b) for k, b in enumerate(blocks) if not b[3] and (b[6] < 0 or kept[b[6]])]
    inside = [b for _, b in left if b[4]]
    open_slots = [b for k, b in left if k not in cut]
    if inside:
        return " ".join(b[1] for b in [b for b in open_slots if b[4]] or inside)
    slot = next((s for s in slots or () if s in around), None)
    if slot is not None:
        under: dict[int, bool] = {}
        for path, (up, _) in around.items():  # an element stands before those in it
            under[path] = path == slot or under.get(up, False)
        if within := [b[1] for b in open_slots if under.get(b[0])]:
            return " ".join(within)
    return " ".join(b[1] for b in open_slots if b[2] < LINKED * len(b[1]))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    The template of each host is deduced over all pages first; its fixed text tokens
    come to the pages by a join on the host, the pages vote for main slots, and those that a host's pages
    agree on come to them likewise. The first table holds a list of tokens for each host; it
    is written in the shared folder so that Spark broadcasts it only if it is small. Null html
    counts as empty and gives an empty text; pages without a host form one host; repeated rows
    are extracted each; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    constant = deduce_templates(pages, id_col, url_col, html_col)
    fixed = written(constant.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixed")).withColumnRenamed("host", "t_host"))
    as_set = lambda x: set(map(int, x)) if x is not None else None

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter((h, s) for h, source, tokens in zip(batch["t_key"], batch["html"], batch["fixed"], strict=True) if (s := main_slot(source, as_set(tokens))) is not None)
            yield pd.DataFrame([(h, s, n) for (h, s), n in found.items()], columns=["host", "slot", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [extract_main(source, as_set(tokens), [int(s) for s in slots] if slots is not None else None) for source, tokens, slots in zip(batch["html"], batch["fixed"], batch["slots"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    kind = pages.schema[id_col].dataType
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), url.alias("url"), text_or_empty(html_col).alias("html"))
    known = rows.withColumn("t_key", _host_column("url")).join(fixed, F.col("t_key") == F.col("t_host"), "left")
    votes = written(known.select("t_key", "html", "fixed").mapInPandas(vote, "host string, slot long, n long").groupBy("host", "slot").agg(F.sum("n").alias("n")))
    every = votes.groupBy(F.col("host").alias("v_host")).agg(F.sum("n").alias("total"))
    good = votes.join(every, F.col("host") == F.col("v_host")).where((F.col("n") >= MIN_PAGES) & (4 * F.col("n") >= F.col("total")))  # at most four for each host
    slots = written(good.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "slot"))), lambda x: x["slot"]).alias("slots")).withColumnRenamed("host", "s_host"))
    known = known.join(slots, F.col("t_key") == F.col("s_host"), "left").select("id", "url", "html", "fixed", "slots")
    got = known.mapInPandas(run, "id string, url string, text string, n_chars long")
    return got.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
