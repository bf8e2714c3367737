"""Main text of web pages by consensus paths of their hosts.

A page is read in one pass into a tree of generalised paths (tags with their first class, digits masked), which have integer
ids and parent links; every block of text belongs to one. Each page scores its containers by the text in them that no menu,
notice or the like claims, and votes for the deepest container with all of it but labels and lists of links, widened to the
article around it. It also votes on its doubtful elements, whose names both furniture and articles use: how much text and
how much of it in links each path holds, and what text that is. Votes are summed by host in Spark. A host's winning
containers are those that many of its pages chose; a doubtful path is the article's on a host where it holds other text on
most pages and few links. Pages are then extracted with their host's winners; a page that has none of them uses its own
best container, and doubtful paths that fewer than VOTERS pages of a host have are judged by each page on its own.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Share of a page's text that its best container must hold, and share of a host's pages that makes a path win too.
MOST, WINS = 0.7, 0.25
#: Words from which on a block is no label.
LABEL = 8
#: Pages of a host that have to have a doubtful path before their votes decide about it.
VOTERS = 3
#: Parts into which each host's pages are split where they meet their winners.
SALT = 16

_CONTAINERS = frozenset("html body main article section div td table tbody tr blockquote center".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre figure figcaption header footer nav aside form fieldset address details summary th thead tfoot caption hr br option button legend".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements that never belong to an article.
_OUT = frozenset("nav footer aside form menu button select option dialog head title script style noscript iframe svg math template textarea canvas audio video object label input".split())
#: Roles, class and id words of page furniture.
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_CLEAR = (
    "ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|cookies?|consent|gdpr|popup|modal|overlay|toast|sidebar|nav|navbar|navigation|breadcrumbs?|pagination|pager|"
    "footer|masthead|topbar|toolbar|comments?|commentlist|disqus|newsletter|subscribe|subscription|signup"
)
#: Words that articles use as well: their elements are furniture unless they hold much text and few links.
_MAYBE = "promo(?:tion)?|banner|notices?|alert|side|aside|widget|menu|foot|header|respond|replies|discussion|share|sharing|social|related|recommend(?:ed|ations)?|login|search|skip|tags|toc"
_CLEAR_PART, _MAYBE_PART = (re.compile(rf"(?:^|[_-])(?:{x})(?=$|[_-])", re.I) for x in (_CLEAR, _MAYBE))
#: In an article, and of ids, only whole names count: a word of furniture, alone or with words of layout.
_CLEAR_INSIDE = "ads?|adverts?|advertisement|advertising|adsense|sponsored|sidebar|navbar|breadcrumbs?|pagination|pager|footer|comments?|commentlist|disqus|newsletter"
_BEFORE, _AFTER = "(?:(?:site|page|post|article|entry|blog|main)[_-])*", "(?:[_-](?:box|block|area|section|list|links?|buttons?|bar|wrap(?:per)?|container|posts?|articles?|notice|banner|thread|form|slot|unit|left|right|top|bottom|[0-9]+))"
_NAME_INSIDE = re.compile(rf"{_BEFORE}(?:(?P<clear>{_CLEAR_INSIDE}){_AFTER}*|(?:cookies?|consent|gdpr|nav|navigation|menu|modal|overlay|popup|toast|banner|widget|login|signup|subscribe|share|sharing|social|related|recommended|recommendations|promo|tags|toc)(?P<more>{_AFTER}*))", re.I)
_NAME_OUTSIDE = re.compile(rf"{_BEFORE}(?:(?P<clear>{_CLEAR}){_AFTER}*|(?:{_MAYBE})(?P<more>{_AFTER}*))", re.I)
#: Names that only say what a container has, or that are the article's own heading block.
_NO_NAME = re.compile(r"(?:has|with|without|no)[_-].*|[\w-]*(?:article|post|entry)[_-]?header", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters that make much text, and the share of them in links that is few.
MUCH, FEW = 300, 0.2
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_DIGITS = re.compile(r"\d+")
#: What a start tag closes if it is open: an element, and how far up it is looked for.
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_ENDS_P = _BLOCKS - {"br", "button", "legend", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends the tag starting at `at`, quotes minded; -1 if there is none."""
    end = page.find(">", at)
    if end < 0 or ('"' not in page[at:end] and "'" not in page[at:end]):
        return end
    quote = ""
    for k in range(at, len(page)):
        c = page[k]
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return k
        elif c in "\"'" and page[k - 1] in "= \t\n\r":
            quote = c
    return end


def _furniture(classes: str, ids: str, inside: bool) -> int:
    """What the names of an element, in an article or not, say: 2 page furniture, 1 furniture unless it has much text, 0 nothing."""
    found = 0
    for names, whole in ((classes, inside), (ids, True)):
        for name in names.split():
            if _NO_NAME.fullmatch(name):
                continue
            if whole:
                if m := (_NAME_INSIDE if inside else _NAME_OUTSIDE).fullmatch(name):
                    found = max(found, 2 if m["clear"] or m["more"] else 1)
            elif _CLEAR_PART.search(name):
                found = 2
            elif _MAYBE_PART.search(name):
                found = max(found, 1)
    return found


class Page:
    """A page as blocks of text in a tree of paths.

    Paths are numbered; 0 is the page, `parent` of a path is less than the path, `name` its last step. Sibling elements with
    equal steps share a path. `blocks` are (path, text, characters of it in links, doubtful element) of all text that isn't
    page furniture, in order. Doubtful elements are numbered like paths: `doubt_parent` (-1: none) and `doubt_path`.

    Tags need not be closed; text after an unfinished tag's < is dropped as a browser would. Character references are
    decoded and white space within a block becomes one space. Reading takes time in proportion to the page's length.
    """

    def __init__(self, page: str):
        self.parent, self.name = [0], [""]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.doubt_parent: list[int] = []
        self.doubt_path: list[int] = []
        self._steps: dict[tuple[int, str], int] = {}
        self._read(page)

    def _path(self, parent: int, step: str) -> int:
        found = self._steps.setdefault((parent, step), len(self.name))
        if found == len(self.name):
            self.parent.append(parent)
            self.name.append(step)
        return found

    def _read(self, page: str) -> None:
        low = page.lower()
        if len(low) != len(page):
            low = page.translate({c: c + 32 for c in range(65, 91)})
        # open elements, root first: (tag, path, furniture, in a link, in an article, doubtful element); where each tag is
        # among them, and where containers are, so that nothing is looked for element by element
        top = ("", 0, False, False, False, -1)
        stack = [top]
        places: dict[str, list[int]] = {}
        walls = [0]
        parts: list[str] = []
        links, where = 0, top

        def flush() -> None:
            nonlocal parts, links
            if parts and (text := " ".join("".join(parts).split())):
                self.blocks.append((where[1], text, links, where[5]))
            parts, links = [], 0

        def cut(depth: int) -> None:
            """Closes all elements from this depth on."""
            while len(stack) > depth:
                places[stack.pop()[0]].pop()
            while walls[-1] >= depth:
                walls.pop()

        at, size = 0, len(page)
        while at < size:
            here = stack[-1]
            lt = page.find("<", at)
            if lt < 0:
                lt = size
            if lt > at and not here[2]:
                piece = _html.unescape(page[at:lt])
                if not parts:
                    where = here
                parts.append(piece)
                if here[3]:
                    links += len(piece)
            if lt == size:
                break
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            c = page[lt + 1 : lt + 2]
            if c in ("!", "?"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            closing = c == "/"
            m = _NAME.match(low, lt + 1 + closing)
            if not m:
                if closing:
                    end = page.find(">", lt)
                    at = size if end < 0 else end + 1
                else:  # a < in text
                    if not here[2]:
                        if not parts:
                            where = here
                        parts.append("<")
                    at = lt + 1
                continue
            tag = m[0]
            end = _tag_end(page, m.end())
            if end < 0:
                break
            at = end + 1
            if tag in _BLOCKS:
                flush()
            if closing:
                depth = places[tag][-1] if places.get(tag) else 0
                # an inline end tag doesn't close blocks
                if depth and (tag in _BLOCKS or depth > walls[-1]):
                    e, up = stack[depth], stack[depth - 1]
                    if tag not in _BLOCKS and (e[2] != up[2] or e[5] != up[5]):
                        flush()
                    cut(depth)
                continue
            if tag in _RAW:
                stop = low.find(f"</{tag}", at)
                if stop < 0:
                    at = size
                else:
                    stop = page.find(">", stop)
                    at = size if stop < 0 else stop + 1
                continue
            if tag in _ENDS_P or tag in _CLOSES:
                names, until = _CLOSES.get(tag, ("p", ()))
                open_at = [places[x][-1] for x in names.split() if places.get(x)]
                wall = max((places[x][-1] for x in until if places.get(x)), default=0) if tag in _CLOSES else walls[-1]
                if open_at and max(open_at) > wall:
                    cut(max(open_at))
            if tag in _VOID or page[end - 1] == "/" and tag not in _BLOCKS:
                continue
            up = stack[-1]
            new = self._element(tag, page[m.end() : end], up)
            if new[2] and not up[2] or new[5] != up[5]:
                flush()
            places.setdefault(tag, []).append(len(stack))
            if tag in _CONTAINERS:
                walls.append(len(stack))
            stack.append(new)
        flush()

    def _element(self, tag: str, attributes: str, up: tuple) -> tuple:
        kind, marks, ids, role, hidden = "", "", "", "", False
        if attributes:
            for m in _ATTR.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "class":
                    kind = kind or value
                    marks += " " + value
                elif name == "id":
                    ids += " " + value
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        _, path, out, link, inside, doubt = up
        out = out or tag in _OUT or hidden or role in _OUT_ROLES or tag == "header" and not inside
        if tag in _CONTAINERS:
            path = self._path(path, tag + _step(kind))
        if not out and (marks or ids) and tag not in ("html", "body", "article", "main") and tag not in _HEADINGS:
            said = _furniture(marks, ids, inside)
            out = said == 2
            if said == 1:
                self.doubt_parent.append(doubt)
                self.doubt_path.append(path if tag in _CONTAINERS else self._path(path, tag + _step(kind)))
                doubt = len(self.doubt_parent) - 1
        return tag, path, out, link or tag == "a", inside or tag in ("article", "main"), doubt

    def path_name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.name[path])
            path = self.parent[path]
        return "/".join(["", *reversed(steps)])

    def doubts(self) -> list[tuple[int, int, int, int]]:
        """(path, characters, of them in links, hash of the text) of each doubtful element, with all that is in it."""
        n = len(self.doubt_parent)
        size, linked, mark = [0] * n, [0] * n, [0] * n
        for _, text, links, doubt in self.blocks:
            if doubt >= 0:
                size[doubt] += len(text)
                linked[doubt] += links
                mark[doubt] = xxhash.xxh64_intdigest(text, mark[doubt])
        for d in range(n - 1, -1, -1):
            if (up := self.doubt_parent[d]) >= 0:
                size[up] += size[d]
                linked[up] += linked[d]
                mark[up] ^= mark[d]
        return list(zip(self.doubt_path, size, linked, mark))

    def kept(self, verdicts: dict[str, bool] | None = None) -> list[tuple[int, str, int]]:
        """(path, text, characters in links) of the blocks that stay: those of doubtful elements where the host's verdict on
        the path says so, or, without one, that hold MUCH text, FEW of it in links."""
        out: list[bool] = []
        for d, (path, size, linked, _) in enumerate(self.doubts()):
            fine = verdicts.get(self.path_name(path)) if verdicts else None
            fine = size >= MUCH and linked <= FEW * size if fine is None else fine
            up = self.doubt_parent[d]
            out.append(not fine or up >= 0 and out[up])
        return [(p, t, n) for p, t, n, d in self.blocks if d < 0 or not out[d]]

    def best(self, found: list[tuple[int, str, int]] | None = None, most: float = MOST) -> tuple[int, float] | None:
        """(path, score) of the page's main container, from its kept blocks; text in links counts little.

        It is the deepest one that holds `most` of the page's text and all blocks that are neither labels (under LABEL
        words) nor mostly links; then the outermost article or main around it; or else the highest container around it that
        has text of its own, not only in containers beside it.
        """
        found = self.kept() if found is None else found
        if not found:
            return None
        n = len(self.name)
        mass, needed, own = [0.0] * n, [0] * n, [False] * n
        for path, text, links in found:
            linked = 2 * links > len(text)
            own[path] = own[path] or not linked
            mass[path] += len(text) - 0.9 * min(links, len(text))
            needed[path] += not linked and text.count(" ") + 1 >= LABEL
        for p in range(n - 1, 0, -1):
            mass[self.parent[p]] += mass[p]
            needed[self.parent[p]] += needed[p]
        # paths with most of the text lie on one line from the page down; deeper ones have greater numbers
        best, depth = 0, [0] * n
        for p in range(1, n):
            depth[p] = depth[self.parent[p]] + 1
            if mass[p] >= most * mass[0] and needed[p] == needed[0] and (depth[p], mass[p]) > (depth[best], mass[best]):
                best = p
        around, p = [], best
        while True:
            around.append(p)
            if not p:
                break
            p = self.parent[p]
        around.reverse()
        articles = [p for p in around if self.name[p].partition(".")[0] in ("article", "main")]
        best = articles[0] if articles else next((p for p in around if own[p]), best)
        return best, mass[best]

    def text(self, winners: list[str] = (), verdicts: dict[str, bool] | None = None) -> str:
        """The text of the kept blocks in winning containers; in the page's own best one if they hold none."""
        found = self.kept(verdicts)
        inside = [False] * len(self.name)
        for w in winners:
            p = 0
            for step in w.split("/")[1:]:
                p = self._steps.get((p, step), -1)
                if p < 0:
                    break
            if p >= 0:
                inside[p] = True

        def chosen() -> list[str]:
            for p in range(1, len(inside)):
                inside[p] = inside[p] or inside[self.parent[p]]
            return [t for p, t, _ in found if inside[p]]

        texts = chosen()
        if not texts and (best := self.best(found)):
            inside[best[0]] = True
            texts = chosen()
        return " ".join(texts)


def _step(kind: str) -> str:
    """What an element's class adds to its step of a path."""
    first = kind.split(None, 1)[:1]
    return "." + _DIGITS.sub("#", first[0].lower()).replace("/", "_") if first else ""


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(pages: DataFrame) -> DataFrame:
    """(host, kind, path, score, links, mark): of each page a row of kind 0 for its best container and one of kind 1 for
    each of its doubtful paths, with the characters in it and in its links, and a hash of its text."""
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for h, p in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(p.as_py() or "")
                if best := page.best():
                    rows.append((h, 0, page.path_name(best[0]), int(best[1]), 0, 0))
                mine: dict[int, list[int]] = {}
                for path, size, linked, mark in page.doubts():
                    x = mine.setdefault(path, [0, 0, 0])
                    x[0] += size
                    x[1] += linked
                    x[2] ^= mark
                rows += [(h, 1, page.path_name(path), *x[:2], x[2] - (1 << 63)) for path, x in mine.items() if x[0]]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["host", "kind", "path", "score", "links", "mark"])

    return pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, kind int, path string, score long, links long, mark long")


def host_paths(pages: DataFrame, wins: float = WINS) -> DataFrame:
    """(host, paths, verdicts) of each host: the winning container paths, which are the one with most votes (ties: with
    most text, then the greatest path) and all with `wins` of the host's votes; and array<struct<path, fine>>, whether
    doubtful paths that VOTERS pages or more have belong to articles.

    Votes are summed before they are shuffled, and no task gathers a host's paths: a host has 1 / wins + 1 winners at
    most. Its verdicts are as many as it has doubtful paths on VOTERS pages or more, some per template.
    """
    votes = _votes(pages).groupBy("host", "kind", "path", "mark").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum("links").alias("links"))
    votes = votes.groupBy("host", "kind", "path").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("score").alias("score"), F.sum("links").alias("links"))
    votes = stored(votes, "hostvotes")
    boxes = votes.where("kind = 0")
    hosts = boxes.groupBy("host").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "score", "path")).alias("_top"))
    won = boxes.join(hosts, "host").where((F.col("path") == F.col("_top.path")) | (F.col("n") >= wins * F.col("_all")))
    won = won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    fine = (2 * F.col("texts") > F.col("n")) & (F.col("links") <= FEW * F.col("score"))
    told = votes.where((F.col("kind") == 1) & (F.col("n") >= VOTERS)).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", fine.alias("fine")))).alias("verdicts"))
    return won.join(told, "host", "left").select("host", "paths", "verdicts")


def extract_main_text(pages: DataFrame, wins: float = WINS) -> DataFrame:
    """Main text of every row of pages: page_id, url, text.

    Null html is empty; a page without text gives "". Pages without a host (null or odd urls) vote together. Ties of votes
    go to the path with more text, then to the greater one. Repeated rows vote and are extracted like any other. An empty
    table gives no rows. Extra columns aren't read. Very long and very deep pages take time in proportion to their length.
    Where winners are too many to be broadcast, a host's pages are split into SALT parts.
    """
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    winners = stored(host_paths(pages, wins), "hostpaths")
    winners = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")
    d = pages.select("page_id", "url", F.col("html").cast("string").alias("_h"), _host(F.col("url")).alias("host"), salt.alias("_salt")).join(winners, ["host", "_salt"], "left")

    def run(batches):
        for b in batches:
            texts = [Page(h.as_py() or "").text(w.as_py() or [], {x["path"]: x["fine"] for x in v.as_py() or []}) for h, w, v in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return d.select("page_id", "url", "_h", "paths", "verdicts").mapInArrow(run, f"page_id {id_kind}, url {url_kind}, text string")
