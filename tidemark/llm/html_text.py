"""HTML extraction by composite text density.

1. A tolerant scanner turns a page into a tree: implied end tags of paragraphs,
   list items and table cells, unclosed and crossed elements, comments, raw text,
   cut-off pages.
2. Parts that are not the article by their kind (scripts, menus, page headers,
   footers, sidebars, ...) are left out of the tree.  A form and what carries the name
   of such a part (adverts, notices, reader comments, ...) go only if they hold no
   article or main element and lie outside one that has text, most of their text is
   links, or at most half of the page's unlinked text is theirs.  Reader comments by name go
   whatever their size, with the articles inside them, and so do articles of that name.
3. Every node gets its link-adjusted density of characters per tag: with C
   characters, T tags, LC and LT those in links, NLC = C - LC, and the body's LCb, Cb

       C/T * log(C/LC * T/LT) / log(log(C/NLC * LC + LCb/Cb * C + e))

   and the sum of the densities of its children.  The subtree of the largest sum
   is the text; one inside a paragraph is widened to its container, one inside an
   article or main element to that: there the tag overrides the density, and only
   sisters of the same tag are added, if they reach the smallest density on the path
   from the body and are no teasers (mostly links, or a linked heading where the best has none).  Elsewhere every node beside that path is tested, of any tag: it is
   added if at most half of its text is links and it is a paragraph, list, quotation
   or the like, reaches that smallest density or has half the best node's unlinked
   characters per tag; so is text directly in the path.  A heading goes with what follows it.
4. Blocks are the runs of text between block-level tags.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import slices

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)>"""
                  r"""|[!?/][^>]*(?:>|\Z)|/?[a-zA-Z][^>]*\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {x: re.compile(r"</" + x + r"(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for x in RAW}
DROP = frozenset("head script style noscript template iframe object embed svg annotation annotation-xml canvas audio video nav footer "
                 "aside button select textarea menu dialog title option datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
                  "td tfoot th thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: text by their kind, whatever their density
PROSE = frozenset("p blockquote pre ul ol dl figure table hgroup".split())
#: a start tag of the key ends an open element of the values
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion "
    "promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter "
    "subscribe subscription paywall comment comments commentlist disqus respond replies review reviews sidebar sidebars "
    "widget widgets menu menus menubar nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social "
    "related recommend recommended recommendation recommendations footer masthead topbar copyright login signin signup "
    "search tags skip".split())
#: say where or what a named part is; a name of these and words of _BOILER, one at least, is one of _BOILER
_NEUTRAL = frozenset(
    "site page post posts entry article articles user reader main primary secondary left right top bottom inner outer "
    "box block list section area container wrapper wrap item items link links icons buttons button bar form content "
    "stories news media text title unit slot col column".split())
#: names of reader comments
_TALK = frozenset("comment comments commentlist disqus respond replies reply".split())
_PAGE_HEAD = re.compile(r"(?:^|[-_ ])(?:header|site-?title|logo|tagline)(?:$|[-_ ])")
_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar".split())
_KEEP = frozenset("html body article main".split())
_WITH = re.compile(r"\b(?:has|with|no|without|is|not)[-_][\w-]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Open:
    """The open elements, innermost last, with the places of every name, of blocks and of scopes,
    so that no step looks through the stack."""

    def __init__(self):
        self.names, self.nodes = [], []
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes = [], []
        self.push("body", 0)

    def push(self, name: str, node: int) -> None:
        at = len(self.names)
        self.names.append(name)
        self.nodes.append(node)
        self.places.setdefault(name, []).append(at)
        if name in BLOCK or name == "body":
            self.blocks.append(at)
        if name in SCOPE:
            self.scopes.append(at)

    def cut(self, k: int) -> int:
        """Close the elements from place k on; their number."""
        n = len(self.names) - k
        for name in self.names[k:]:
            self.places[name].pop()
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= k:
                places.pop()
        del self.names[k:], self.nodes[k:]
        return n

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, 0 if there is none but the body."""
        places = self.places.get(name)
        return places[-1] if places else 0

    @property
    def in_article(self) -> bool:
        return self.last("article") > 0 or self.last("main") > 0


class Page:
    """Tree of a page as parallel lists; node 0 is the body."""

    def __init__(self, source: str):
        self.tag, self.parent = ["body"], [-1]
        self.pieces: list[tuple[int, int, str]] = []          # (node, block, text)
        self.named: list[int] = []                            # nodes that may not be the article
        self.talk: set[int] = set()                           # those named as reader comments
        self._scan(source)
        self._weigh()

    def _scan(self, s: str) -> None:
        up = Open()
        skip, block, at, n = 0, 0, 0, len(s)                  # skip: open elements inside a left out part
        while at < n:
            m = _TAG.search(s, at)
            if m is None:
                if not skip:
                    self._text(up.nodes[-1], block, s[at:])
                return
            if m.start() > at and not skip:
                self._text(up.nodes[-1], block, s[at:m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):                                    # an end tag
                if name in BLOCK:
                    block += 1
                k = up.last(name)
                # an inline end tag does not reach through an open block
                if k > 0 and (name in BLOCK or up.blocks[-1] <= k):
                    skip = max(0, skip - up.cut(k))
                continue
            attrs = m.group(3) or ""
            if name in ("html", "body"):
                continue
            if name in BLOCK:
                block += 1
                if not skip and up.last("p") > up.scopes[-1]:  # a block ends an open paragraph
                    up.cut(up.last("p"))
            ends = CLOSES.get(name)
            if ends:
                k = max(map(up.last, ends))
                if k > up.scopes[-1]:
                    skip = max(0, skip - up.cut(k))
            if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
                if not skip:
                    if name == "br":
                        self._text(up.nodes[-1], block, " ")
                    self.tag.append(name)
                    self.parent.append(up.nodes[-1])
                continue
            if name in RAW:
                end = _RAW_END[name].search(s, at)
                at = end.end()
                continue
            if name == "article" and skip and up.names[-1] == "head":
                skip = 0                                      # a head that was never closed
                up.cut(1)
            if skip or self._left_out(name, attrs, up):
                skip += 1
                up.push(name, -1)
                continue
            self.tag.append(name)
            self.parent.append(up.nodes[-1])
            node = len(self.tag) - 1
            kind = self._suspect(name, attrs, up)
            if kind:
                self.named.append(node)
            if kind == 2:
                self.talk.add(node)
            up.push(name, node)

    def _text(self, node: int, block: int, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text:
            self.pieces.append((node, block, text))

    @staticmethod
    def _left_out(name: str, attrs: str, up: Open) -> bool:
        if name in DROP:
            return True
        if name == "header" and not up.in_article:
            return True
        if not attrs or name in _KEEP:
            return False
        for m in _NAMED.finditer(attrs):
            key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    return True
            elif key == "role":
                if value.lower() in _ROLES:
                    return True
        return False

    @staticmethod
    def _suspect(name: str, attrs: str, up: Open) -> int:
        """0, 1 for a part that may not be the article by its name, 2 for reader comments."""
        if name == "form":
            return 1
        if not attrs or name in HEADING or name in _KEEP and name != "article":
            return 0
        found = 0
        for m in _NAMED.finditer(attrs):
            key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if key == "role" and value.lower() in ("form", "search"):
                found = max(found, 1)
            if key in ("class", "id"):
                value = _WITH.sub("", _CAMEL.sub(r"\1-\2", value).lower())
                if not up.in_article and _PAGE_HEAD.search(value):
                    found = max(found, 1)
                for token in value.split():
                    parts = [x for x in re.split(r"[-_]+|\d+", token) if x]
                    if all(x in _BOILER or x in _NEUTRAL or x in _TALK for x in parts):
                        if any(x in _TALK for x in parts):
                            return 2
                        if any(x in _BOILER for x in parts):
                            found = max(found, 1)
        return 0 if name == "article" else found

    def _weigh(self) -> None:
        """Takes the named nodes out that hold no article or main and little of the text, or mostly
        links, and reader comments whatever their size."""
        if not self.named:
            return
        tag, parent, n = self.tag, self.parent, len(self.tag)
        chars, own = [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        sizes = [len(_SPACE.sub(" ", text).strip()) for _, _, text in self.pieces]
        for (node, _, _), size in zip(self.pieces, sizes):
            chars[node] += size
            own[node] += 0 if in_link[node] else size
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            own[parent[i]] += own[i]
        talk = self._comments(own)
        holds = [tag[i] in ("article", "main") and not talk[i] for i in range(n)]
        within, marked = list(holds), False
        for i in range(1, n):
            within[i] = within[i] or within[parent[i]]
        for (node, _, _), size in zip(self.pieces, sizes):
            marked = marked or size > 0 and within[node] and not talk[node]
        for i in range(n - 1, 0, -1):
            holds[parent[i]] = holds[parent[i]] or holds[i]
        gone = list(talk)
        for i in self.named:
            gone[i] = gone[i] or not holds[i] and (
                marked and not within[i] or 2 * own[i] <= own[0] or 2 * own[i] < chars[i])
        for i in range(1, n):
            gone[i] = gone[i] or gone[parent[i]]
        if not any(gone):
            return
        at, left = [0] * n, [i for i in range(n) if not gone[i]]
        for k, i in enumerate(left):
            at[i] = k
        self.tag = [tag[i] for i in left]
        self.parent = [-1] + [at[parent[i]] for i in left[1:]]
        self.pieces = [(at[node], block, text) for node, block, text in self.pieces if not gone[node]]

    def _comments(self, own: list[int]) -> list[bool]:
        """Whether each node lies in reader comments.  A part of that name which wraps the page's
        only article and most of its text is a wrapper, not the comments."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        outer: list[int] = []                                 # articles and mains not inside another
        inside = [False] * n
        for i in range(1, n):
            mark = tag[i] in ("article", "main") and i not in self.talk
            if mark and not inside[parent[i]]:
                outer.append(i)
            inside[i] = inside[parent[i]] or mark
        wrappers = set()
        if len(outer) == 1:
            up = outer[0]
            while up > 0:
                up = parent[up]
                if up in self.talk and tag[up] != "article" and 2 * own[up] > own[0]:
                    wrappers.add(up)
        talk = [i in self.talk and i not in wrappers for i in range(n)]
        for i in range(1, n):
            talk[i] = talk[i] or talk[parent[i]]
        return talk

    def article(self) -> list[str]:
        """Blocks of the main text, in page order."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        chars, links = [0] * n, [0] * n
        tags, link_tags = [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        for node, _, text in self.pieces:
            size = len(_SPACE.sub(" ", text).strip())
            chars[node] += size
            if in_link[node]:
                links[node] += size
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
        if not chars[0]:
            return []
        share = links[0] / chars[0]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c = chars[i]
            if c:
                t, lc, lt = tags[i] or 1, links[i] or 1, link_tags[i] or 1
                nlc = c - links[i] or 1
                density[i] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(
                    math.log(c / nlc * lc + share * c + math.e))
            if i:
                total[parent[i]] += density[i]
        best = max(range(n), key=lambda i: (total[i], -i))
        if not total[best]:
            best = 0
        path, low = best, density[best]
        while path > 0:                                       # smallest density on the way to the body
            path = parent[path]
            low = min(low, density[path])
        while best > 0 and (tag[best] not in BLOCK or tag[best] in HEADING or tag[best] in ("p", "li", "td", "th", "tr",
                                                                                            "dd", "dt")):
            best = parent[best]
        up = best
        while up > 0:
            if tag[up] in ("article", "main"):
                best = up
                break
            up = parent[up]
        if tag[best] in ("article", "main"):                  # the tag overrides the density
            linked = [tag[i] in HEADING and 0 < chars[i] < 2 * links[i] for i in range(n)]   # headings that are links
            for i in range(n - 1, 0, -1):
                linked[parent[i]] = linked[parent[i]] or linked[i]
            chosen = {i for i in range(1, n) if parent[i] == parent[best] and tag[i] == tag[best] and density[i] >= low
                      and 2 * links[i] <= chars[i] and linked[i] <= linked[best]}
            chosen.add(best)
            runs = set()
        else:
            chosen, runs = self._beside(best, low, chars, links, tags, density, in_link)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in chosen or i > 0 and inside[parent[i]]
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if inside[node] or (node, block) in runs:
                blocks.setdefault(block, []).append(text)
        joined = (_SPACE.sub(" ", "".join(x)).strip(" ") for _, x in sorted(blocks.items()))
        return [x for x in joined if x]

    def _beside(self, best: int, low: float, chars: list[int], links: list[int], tags: list[int],
                density: list[float], in_link: list[bool]) -> tuple[set[int], set[tuple[int, int]]]:
        """``best`` with the nodes beside the path from the body that join it, and the
        (node, block) of the text that lies directly in nodes of the path."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        chosen, runs, path, up = {best}, set(), set(), best
        while up > 0:
            up = parent[up]
            path.add(up)
        blocky = [t in BLOCK for t in tag]
        for i in range(n - 1, 0, -1):
            if blocky[i]:
                blocky[parent[i]] = True
        plain = (chars[best] - links[best]) / (tags[best] or 1)
        headings: dict[int, list[int]] = {}                   # of each path node, waiting for what they head
        for i in range(1, n):
            if parent[i] not in path or not blocky[i]:
                continue
            if i in path or i == best:
                chosen.update(headings.pop(parent[i], []))
                continue
            own, size = chars[i] - links[i], chars[i]
            if tag[i] in HEADING:
                if size and 2 * links[i] <= size:
                    headings.setdefault(parent[i], []).append(i)
                continue
            # the composite density grows with the size where links are few: characters per tag do not
            if size and 2 * links[i] <= size and (
                    tag[i] in PROSE or density[i] >= low or 2 * own / (tags[i] or 1) >= plain):
                chosen.add(i)
                chosen.update(headings.pop(parent[i], []))
            elif size:
                headings.pop(parent[i], None)
        held: dict[tuple[int, int], list] = {}
        for node, block, text in self.pieces:
            at = node
            while at > 0 and not blocky[at]:
                at = parent[at]
            if at in path:
                run = held.setdefault((at, block), [0, 0, []])
                size = len(_SPACE.sub(" ", text).strip())
                run[0] += size
                run[1] += size * in_link[node]
                run[2].append((node, block))
        for size, linked, where in held.values():
            if 2 * linked <= size:
                runs.update(where)
        return chosen, runs


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).article()) if source else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    ``text``: blocks of the main text joined by one \\n, character references decoded,
    white space inside a block turned into one space, trimmed; ``n_chars``: its code
    points.  A NULL, empty or text-free page gives an empty text; text without any
    tag is one block; repeated rows give repeated results; an empty table gives an empty one; extra
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
