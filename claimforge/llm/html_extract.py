"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold outside links; the best container's generalised tag-class path is the
page's vote. Votes are counted per host in Spark, and the winning path of its host decides what is taken from each page of its layout.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import cut, parts, read_table, ship
from claimforge.llm.url_filter import url_parts

TAG = re.compile(r"<(?:!--(?:-?>|.*?--!?>|.*\Z)|!\[CDATA\[(?:.*?\]\]>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|)|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=\"'/>]+)\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+)""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
BLOCK = set("html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr center details summary fieldset nav aside header footer form menu dialog".split())
CONTAINER = set("body main article section div td blockquote center details".split())
AWAY = set("head nav aside footer menu dialog button select option svg math canvas object audio video map label".split())
#: away unless the page's article is in them
WRAPPERS = set("div section ul ol dl table span form header center details fieldset figure".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: away unless nothing is left of the page without them (an element that is never closed holds all that follows)
ASIDE = set("nav aside footer menu dialog".split())
INLINE = ("span", "ins")
#: words of names: a name is boilerplate or comments if one of its words says so and all others may stand beside it
SIDE_WORDS = set("""ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising adv banner banners promo promos promotion promotions sponsor sponsored sponsors sponsorship cookie cookies consent gdpr notice notices alert alerts popup
modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended widget widgets newsletter subscribe search login complementary contentinfo""".split())
COMMENT_WORDS = set("comment comments commentlist commentary disqus reply replies response responses respond".split())
BESIDE_WORDS = set("""post entry article page site main top bottom left right in inline user reader global list area section box bar block button buttons link links slot unit wrap wrapper container form thread posts articles stories inner body content
text item google dfp gpt fb facebook taboola outbrain info warning success danger dismissible message x px""".split())
WORDS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)")


def named(name: str) -> str:
    """comments, side or nothing: what the words of a class, id or role say, in lower case."""
    words = WORDS.findall(name)
    for kind, core in (("comments", COMMENT_WORDS), ("side", SIDE_WORDS)):
        if any(w in core for w in words) and all(w in core or w in BESIDE_WORDS or w in SIDE_WORDS for w in words):
            return kind
    return ""


def attributes(rest: str) -> tuple[dict, list[str], bool]:
    """Attributes of a tag, the names in class, id and role, and whether it is hidden."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)} if "=" in rest else {}
    said = [*found.get("class", "").split(), *found.get("id", "").split(), *found.get("role", "").split()]
    hidden = "hidden" in found or "style" in found and bool(HIDDEN.search(found["style"])) or "hidden" in rest.lower() and bool(BARE_HIDDEN.search(ATTRIBUTE.sub(" ", rest.lower())))
    return found, said, hidden


CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
VOTE = pa.schema([("host", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("worth", pa.float64()), ("beside", pa.list_(pa.int64()))])
INLINE_TAG = re.compile(r"<(/?)(span|ins)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
NOSCRIPT = re.compile(r"</?noscript\b[^>]*>", re.I)
ENDS_P = BLOCK - {"html", "body", "head"}
STRONG = {"p", "pre", "blockquote", "h1", "h2", "h3"}


def inline_ends(page: str) -> dict[int, int]:
    """Where each inline element ends that is named like an advert or a notice, or hidden, by the place of its tag; those never closed are left out."""
    out, open_ = {}, {t: [] for t in INLINE}
    if not any(f"<{t}" in page or f"<{t.upper()}" in page for t in INLINE):
        return out
    for m in INLINE_TAG.finditer(page):
        tag = m[2].lower()
        if not m[1]:
            _, said, hidden = attributes(m[3])
            open_[tag].append(m.start() if hidden or any(map(named, said)) else -1)
        elif open_[tag] and (at := open_[tag].pop()) >= 0:
            out[at] = m.end()
    return out


class Page:
    """Text blocks outside boilerplate in page order, and the tree of the paths around them; everything in linear time.

    blocks: (text, number of the innermost element's path, characters in links, tag). A path is known by its number, its parent's number and its
    last step, the tag with its classes; elements of the same path share it.
    """

    def __init__(self, page: str):
        self._begin()
        self._read(page)
        self.blocks = self._outside_boilerplate(ASIDE)
        if not self.blocks and self._found:
            self.blocks = self._outside_boilerplate(set())
        if not self.blocks and "<noscript" in page.lower():
            self._begin()
            self._read(NOSCRIPT.sub(" ", page))
            self.blocks = self._outside_boilerplate(ASIDE)

    def _begin(self) -> None:
        self.parent, self.step, self.tag, self.key, self._number = [-1], [""], [""], [0], {}
        self._nodes: list[list] = [[0, -1, "", False, False, 0, 0, 0]]  # path, parent, kind of boilerplate, hard, article, first block, end block, last node
        self._found: list[tuple[str, int, int, str]] = []

    def _path(self, above: int, tag: str, step: str) -> int:
        number = self._number.setdefault((above, step), len(self.parent))
        if number == len(self.parent):
            self.parent.append(above)
            self.step.append(step)
            self.tag.append(tag)
            self.key.append(xxhash.xxh64_intdigest(step.encode(), self.key[above]) & (1 << 63) - 1)
        return number

    def _open(self, tag: str, rest: str, above: int) -> None:
        names, said, hidden = attributes(rest)
        classes = names.get("class", "").split()
        kinds = {named(n) for n in said} if tag in WRAPPERS or tag == "article" else set()
        kind = ""
        if "comments" in kinds:
            kind = "comments"
        elif tag in ("form", "header") or tag in WRAPPERS and "side" in kinds:
            kind = "side"
        article = not kind and (tag in ("article", "main") or "main" in said)
        step = tag + "".join("." + re.sub(r"[\d/]+", "", c) for c in sorted(set(classes)))
        path = self._path(self._nodes[above][0], tag, step)
        self._nodes.append([path, above, kind, tag if tag in AWAY else "hidden" if hidden else "", article, len(self._found), 0, 0])

    def _read(self, page: str) -> None:
        stack, tags, open_ = [0], [""], Counter()
        piece, linked, links, pos = [], 0, 0, 0
        ends = inline_ends(page)

        def flush():
            nonlocal piece, linked
            if piece and (text := " ".join(entities.unescape("".join(piece)).split())):
                self._found.append((text, stack[-1], linked, tags[-1]))
            piece, linked = [], 0

        def close():
            at = stack.pop()
            open_[tags.pop()] -= 1
            self._nodes[at][6:] = [len(self._found), len(self._nodes)]

        while pos < len(page):
            m = TAG.search(page, pos)
            end = m.start() if m else len(page)
            if end > pos:
                piece.append(page[pos:end])
                linked += (end - pos) * bool(links)
            if not m:
                break
            pos = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                elif open_[tag] and (tag in BLOCK or tag in AWAY):
                    flush()
                    while tags[-1] != tag:
                        close()
                    close()
            elif tag == "br":
                piece.append(" ")
            elif tag in RAW:
                pos = RAW[tag].search(page, pos).end()
            elif tag == "a":
                links += 1
            elif m.start() in ends:  # an inline advert or hidden text
                pos = ends[m.start()]
            elif tag in BLOCK or tag in AWAY:
                flush()
                if tag in BLOCK and (open_["svg"] or open_["math"]):  # a block ends a drawing that isn't closed
                    while open_["svg"] or open_["math"]:
                        close()
                if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
                    continue
                closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
                while tags[-1] in closes:
                    close()
                self._open(tag, m[3], stack[-1])
                stack.append(len(self._nodes) - 1)
                tags.append(tag)
                open_[tag] += 1
                links = 0
        flush()
        while stack:
            close()

    def _outside_boilerplate(self, aside: set) -> list[tuple[str, int, int, str]]:
        """The blocks outside what is hidden or away by its tag (of ASIDE only those in aside). A wrapper named like boilerplate is none if it holds the page's article or, comments apart, four fifths of the page."""
        nodes, found = [[*n[:3], bool(n[3]) and (n[3] not in ASIDE or n[3] in aside), *n[4:]] for n in self._nodes], self._found
        away = [False] * len(nodes)
        for i, (_, above, kind, hard, *_) in enumerate(nodes):
            away[i] = hard or kind == "comments" or above >= 0 and away[above]
        worth = [0.0, *accumulate(0.0 if away[at] else _worth(text, linked, tag) for text, at, linked, tag in found)]
        own = lambda i: worth[nodes[i][6]] - worth[nodes[i][5]]
        article = [0, *accumulate(int(node[4] and own(i) >= worth[-1] / 2 > 0) for i, node in enumerate(nodes))]
        for i, (_, above, kind, hard, _, _, _, last) in enumerate(nodes):
            holds = article[last] > article[i] or kind == "side" and own(i) >= 0.8 * worth[-1] > 0
            away[i] = hard or bool(kind) and not holds or above >= 0 and away[above]
        return [(text, nodes[at][0], linked, tag) for text, at, linked, tag in found if not away[at]]

    def sums(self, values) -> list[float]:
        """For each path the sum of a value for each block under it."""
        out = [0.0] * len(self.parent)
        for (_, path, _, _), x in zip(self.blocks, values, strict=True):
            out[path] += x
        for i in range(len(out) - 1, 0, -1):  # parents come before their children
            out[self.parent[i]] += out[i]
        return out

    def under(self, path: int | None) -> list[bool]:
        """For each path whether it is below this one or is it."""
        out = [False] * len(self.parent)
        for i in range(1, len(out)):
            out[i] = i == path or out[self.parent[i]]
        return out

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.step[path])
            path = self.parent[path]
        return "/".join(reversed(steps))

    def find(self, name: str | None) -> int | None:
        path = 0
        for step in name.split("/") if name else ():
            path = self._number.get((path, step), -1)
        return path if path > 0 else None

    def container(self, path: int) -> int:
        """The innermost container at or above a path."""
        while path and self.tag[path] not in CONTAINER:
            path = self.parent[path]
        return path


def _worth(text: str, linked: int, tag: str) -> float:
    """What a block counts: its characters, those in links against it, half outside paragraphs and headings."""
    return max(len(text) - 2 * linked, 0.01 * len(text)) * (1.0 if tag in STRONG else 0.5)


def prose(text: str, linked: int) -> bool:
    """Whether less than half of a block is text in links."""
    return len(text) > 2 * linked


def best_path(page: Page) -> tuple[int | None, float]:
    """The path of the main container and its score: what all text under it is worth.

    An article, else a main container, that holds half of the page's worth is it; else the deepest one that holds all blocks of prose.
    So headings, leads and closing paragraphs beside the sections of an article stay with them, as do small sections.
    """
    score = page.sums(_worth(text, linked, tag) for text, _, linked, tag in page.blocks)
    main = lambda i: page.tag[i] in ("article", "main") or "main" in page.step[i].split(".")[1:]
    for is_it in (lambda i: page.tag[i] == "article", main):
        if some := [i for i in range(1, len(score)) if page.tag[i] in CONTAINER and is_it(i) and score[i] >= score[0] / 2 > 0]:
            best = max(some, key=lambda i: (score[i], -i))  # of nested ones of one worth the outer, which has the lower number
            return best, score[best]
    held = [prose(text, linked) for text, _, linked, _ in page.blocks]
    count = page.sums(float(h or not any(held)) for h in held) if held else [0.0]
    whole = [i for i in range(1, len(count)) if count[i] == count[0] and page.tag[i] in CONTAINER] if held else []
    best = max(whole, default=None)  # they are nested, the deepest has the highest number
    return best, score[best] if best else 0.0


def beside(page: Page, best: int) -> list[int]:
    """Keys of the innermost containers of the blocks that are not under the best one, without those around it."""
    inside, around = page.under(best), set()
    at = best
    while at:
        around.add(at)
        at = page.parent[at]
    inner = {page.container(path) for path in {p for _, p, _, _ in page.blocks if not inside[p]}}
    return sorted(page.key[i] for i in inner - around - {0})


def _votes(batches):
    for batch in parts(batches, "html", 1 << 20):
        hosts, out = batch.column("host").to_pylist(), []
        for host, html in zip(hosts, batch.column("html"), strict=True):
            page = Page(html.as_py() or "")
            best, worth = best_path(page)
            if best:
                out.append({"host": host, "path": page.name(best), "key": page.key[best], "worth": worth, "beside": beside(page, best)})
        yield pa.RecordBatch.from_pylist(out, VOTE)


def main_text(html: str, winner: str | None, outside=()) -> str:
    """Blocks under the winning path if the page's own best container has no more prose than that, else under the own one.

    Prose in the containers `outside` (their keys), which most pages of the host have beside the winner, counts as none. All
    blocks if no container is best.
    """
    page = Page(html)
    own, found = best_path(page)[0], page.find(winner)
    mine = page.under(own)
    if found:
        inside, outside = page.under(found), set(outside)
        missed = {p for text, p, linked, _ in page.blocks if not inside[p] and prose(text, linked) and (own is None or mine[p])}
        if any(inside[p] for _, p, _, _ in page.blocks) and all(page.key[page.container(p)] in outside for p in missed):
            own, mine = found, inside
    return "\n".join(text for text, p, _, _ in page.blocks if own is None or mine[p])


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, winner, outside): each host's path with most votes; ties go to more text, then to the path's order.

    outside: the paths of containers beside the winner on more than half of the pages that voted for it.
    """
    ship(pages.sparkSession)
    votes = cut(pages.select(url_parts(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, key long, worth double, beside array<long>"))
    counted = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("n"), F.sum("worth").alias("worth"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("worth"), "path"))
    winners = counted.withColumn("rank", rank).where("rank = 1").select("host", "key", F.col("path").alias("winner"), "n")
    seen = votes.select("host", "key", F.explode("beside").alias("p")).groupBy("host", "key", "p").count()
    outside = seen.join(winners, ["host", "key"]).where("2 * count > n").groupBy("host").agg(F.sort_array(F.collect_list("p")).alias("outside"))
    return winners.join(outside, "host", "left").select("host", "winner", "outside")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text (main text, empty if none) and path (the host's winning container path or null; a
    page with prose beside it that is not of the host's layout keeps its own best container).

    Blocks are joined by one line feed, with white space inside a block as one space. Menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, hidden elements and reader comments are left out; so is a heading that stands in a header element, in an article too. An
    article in a navigation that is never closed, or in a noscript, is taken if nothing else is there. A null html is empty; a null url counts as the empty
    host. Ids may be null or repeated, rows come back as often. Other columns are ignored.
    """
    winners = cut(consensus(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_parts(F.col(url_col))[0].alias("host"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, path string"

    def run(batches):
        for batch in parts(batches, "html", 1 << 20):
            text = [main_text(p.as_py() or "", w.as_py(), o.as_py() or ()) for p, w, o in zip(batch.column("html"), batch.column("winner"), batch.column("outside"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), batch.column("winner")], names=["page_id", "url", "text", "path"])

    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winner", "outside").mapInArrow(run, schema)


def op4_html_consensus(spark, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
