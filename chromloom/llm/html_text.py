"""Main text of web pages by consensus host paths.

1. Every page is read once into text blocks, each with the containers it stands in; menus, forms,
   scripts and the like are left out by tag, and adverts, comments or notices by class, id or role.
   Inside an article a name must be a noise name as a whole, as ids and parts of names are often
   made from headings, and doubtful names (discussion, share, alert) need evidence: comments or
   forms inside, links, or no prose. What a name marks outside an article is set apart, as the
   voted container may still turn out to be around it.
2. The page's containers are scored by the text of their blocks, less link text. From the smallest
   container with most of the page's score the vote climbs to the article around it, or as far as
   containers hold text of the article only; it is given to that container's generalised tag-class
   path (numbers in class names dropped, positions left out).
3. Spark adds up the votes by host and path. A host's winning paths are those with a fair part of
   its votes. It also adds up doubtful texts (under a doubtful name, or lists of links inside the
   article) and boxes beside the voted one that hold prose: what different pages of a host repeat
   is no article, a box that a fair part of them fills is one.
4. Every page is read again. Its text is what its host's winning paths hold, each climbing as the
   vote does, with the headline and paragraphs that stand in the containers around them. A page
   that the winners miss falls back on its own best container.

Votes are summed with partial aggregation and are one small row a host and path; pages meet their
host's paths in an equi-join that Spark broadcasts by size or splits where a host is hot.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored, with_columns
from chromloom.llm.url_filter import host_of

# Tags by their role in a page.
_RAW = "script style noscript template textarea iframe svg object canvas title select".split()
_DROP = {*_RAW, *"head nav footer aside form button input label fieldset dialog menu video annotation annotation-xml".split()}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tags that end an open paragraph, and items that end their like.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = {"ul", "ol", "dl", "table", "td", "th", "div", "section", "article", "main", "body"}
#: Names that mark what is no article when they are a whole part of a class, id or role.
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars "
    "comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations trending "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar widget widgets "
    "skip hidden offscreen sr complementary contentinfo search adbox adslot adunit adsense adsbygoogle rail copyright".split())
#: Names that an article's own blocks bear as well: they need evidence.
_WEAK = set("discussion alert alerts share sharing social search".split())
#: Those of them that are set apart outside an article; the others are noise there.
_OWN_NAMES = set("discussion alert alerts".split())
#: Names that make noise as any part of a class name, or of an id that holds no other words.
_SURE = set(
    "advert adverts advertisement advertising sponsored sponsors comments commentlist disqus cookie cookies gdpr newsletter breadcrumbs pagination "
    "sidebar sidebars adbox adslot adunit adsense adsbygoogle".split())
_SURE_IDS = _SURE | set("ad ads respond footer menu nav navbar navigation breadcrumb banner".split())
#: Parts of a class name that say nothing beside a noise name.
_FURNITURE = set(
    "area article articles bar block body bottom box boxes button buttons col container content form group header icon icons inner item items "
    "label left line link links list lists main media module only outer page post posts primary right row secondary section site slot stories "
    "story text thread title top unit wrap wrapper".split())
#: Whole class names of hidden text.
_HIDDEN_NAMES = {"hidden", "sr-only", "offscreen", "visually-hidden"}
#: Whole names of a site's head; inside an article such a name is the article's own.
_SITE_HEAD = {"header", "site-header", "page-header", "main-header", "top-header", "siteheader", "pageheader"}
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(" + "|".join(_RAW) + r""")(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|$)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)

#: A container must hold this part of the page's score to be its vote.
MOST = 0.8
#: A box beside the voted one must hold this part of the page's score.
BESIDE = 0.1
#: A path wins with this part of its host's votes, or with this part of the best path's.
FAIR, NEAR_BEST = 0.2, 0.5


#: What a block's names mean: it is text, it is noise unless the article is around it, it is noise,
#: or it is noise if the evidence says so.
_TEXT, _APART, _OUT, _DOUBT = 0, 1, 2, 3
#: Characters of a block that make prose; a doubtful part without it is noise.
PROSE = 40
#: A doubtful text is noise on this part of a host's pages (and two different ones).
REPEATED = 0.01


class Block:
    """A piece of text with the containers around it, outermost first.

    ``head`` is the heading's level or 0. ``apart`` is the container around the outermost element
    that is noise unless the article is around it, or -1; ``by`` is that element's tag. ``doubt`` is the
    number of the outermost doubtful element around it, or 0.
    """

    __slots__ = ("text", "linked", "around", "head", "apart", "by", "doubt")

    def __init__(self, text: str, linked: int, around: tuple[int, ...], head: int, doubt: int = 0, apart: int = -1, by: str = ""):
        self.text, self.linked, self.around, self.head, self.doubt, self.apart, self.by = text, linked, around, head, doubt, apart, by


def _parts(name: str) -> set[str]:
    return set(_PARTS.split(_CAMEL.sub("-", name).lower())) - {""}


def _whole(names: str) -> int:
    """What class names or roles mean inside an article: noise if one is a noise name as a whole or
    holds a sure one, doubtful if a whole one is weak."""
    found = _TEXT
    for n in names.split():
        p = _parts(n)
        noise = p & _NOISE
        if p & _SURE or noise - _WEAK and p <= _NOISE | _FURNITURE:
            return _OUT
        if noise and p <= _NOISE | _FURNITURE:
            found = _DOUBT
    return found


def _noisy(tag: str, attributes: str, in_article: bool) -> int:
    """What the attributes say of an element: ``_TEXT``, ``_APART``, ``_OUT`` or ``_DOUBT``."""
    found, block = _TEXT, tag in _BLOCK and tag not in _HEADS
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return _OUT
        if name not in ("class", "id", "role"):
            continue
        if name == "class" and _HIDDEN_NAMES & set(value.lower().split()):
            return _OUT
        if name == "role" and block and _NOISE & set(value.lower().split()):
            return _OUT
        if name == "id":
            p = _parts(value)
            if in_article and block and tag != "p" and p & _NOISE and p <= _NOISE | _FURNITURE | {"thread"}:
                if p & _SURE_IDS:
                    return _OUT
                found = _DOUBT
        elif block or tag not in _BLOCK and not in_article:
            means = _whole(value)
            if means == _OUT or means == _DOUBT and not in_article and not _parts(value) & _OWN_NAMES:
                return _OUT
            if in_article:
                found = max(found, means)
        if not in_article and tag in _BLOCK and (_NOISE & _parts(value) or name != "role" and _SITE_HEAD & set(value.lower().split())):
            found = _APART
    return found


def _step(tag: str, attributes: str) -> str:
    """A container's part of a generalised path."""
    classes = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "") if attributes else ""
    names = sorted({re.sub(r"[0-9]+", "", c.lower()).strip("-_") for c in classes.split()} - {""})
    return tag + "".join("." + c for c in names)


def blocks_of(page: str) -> tuple[list[Block], list[str], list[int]]:
    """``(blocks, path of each container, parent of each container)`` of a page, noise left out."""
    found: list[Block] = []
    paths, parents = [""], [-1]
    stack: list[tuple[str, int, int]] = [("", 0, _TEXT)]  # tag, container, what its names mean
    parts: list[str] = []
    linked, out = 0, 0
    open_doubts: list[int] = []  # numbers of the doubtful elements around
    doubts, tainted = 0, set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                around, k = [], stack[-1][1]
                while k >= 0:
                    around.append(k)
                    k = parents[k]
                head = next((int(t[1]) for t, _, _ in stack if t in _HEADS), 0)
                at = next((n for n, (_, _, means) in enumerate(stack) if means == _APART), 0)
                found.append(Block(text, linked, tuple(around[::-1]), head, open_doubts[0] if open_doubts else 0, *((stack[at - 1][1], stack[at][0]) if at else ())))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal out
        while len(stack) > upto:
            tag, _, means = stack[-1]
            if tag in _BLOCK:
                flush()
            stack.pop()
            out -= means == _OUT
            if means == _DOUBT:
                open_doubts.pop()

    def text(s: str) -> None:
        nonlocal linked
        if not out and s:
            parts.append(s)
            if any(t == "a" for t, _, _ in stack):
                linked += len(s.strip())

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            text(page[last:m.start()])
        last = m.end()
        if not m[3]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag not in ("html", "body"):  # a block ends an open paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _WALLS:
                        break
        if tag in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _ENDS[tag]:
                    close(k)
                    break
                if stack[k][0] in _WALLS and stack[k][0] not in ("td", "th"):
                    break
        if tag in _VOID or m[4].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        inside = stack[-1][1]
        in_article = any(t in ("article", "main") for t, _, _ in stack)
        means = _OUT if tag in _DROP else _noisy(tag, m[4], in_article) if m[4] and tag not in ("html", "body", "article", "main") else _TEXT
        if tag == "header" and not in_article:
            means = max(means, _APART)
        if tag in _BLOCK and tag != "p" and tag not in _HEADS and not out and means != _OUT:
            paths.append(f"{paths[inside]}/{_step(tag, m[4])}")
            parents.append(inside)
            inside = len(paths) - 1
        if means == _OUT and open_doubts and tag not in _RAW:
            tainted.update(open_doubts)
        if means == _DOUBT:
            doubts += 1
            open_doubts.append(doubts)
        stack.append((tag, inside, means))
        out += means == _OUT
    if last < len(page):
        text(page[last:])
    close(1)
    flush()
    if doubts:
        own: dict[int, list[Block]] = defaultdict(list)
        for b in found:
            own[b.doubt].append(b)
        own.pop(0, None)
        noise = {d for d, bs in own.items() if d in tainted or 2 * sum(b.linked for b in bs) > sum(len(b.text) for b in bs)
                 or not any(len(b.text) >= PROSE for b in bs)}
        found = [b for b in found if b.doubt not in noise]
    return found, paths, parents


def _worth(block: Block) -> float:
    """Text that counts for the main part: prose more than short or linked text."""
    own = max(0, len(block.text) - 2 * block.linked)
    return own * (1.0 if len(block.text) >= 25 or block.head else 0.3)


def best_container(blocks: list[Block], paths: list[str]) -> tuple[int, float]:
    """The smallest container with most of the page's score, and the score."""
    score: dict[int, float] = defaultdict(float)
    total = 0.0
    for b in blocks:
        if b.apart >= 0:
            continue
        w = _worth(b)
        total += w
        for k in b.around:
            score[k] += w
    if not total:  # nothing but links: those of an article count
        for b in blocks:
            if b.apart < 0 and any(_tag(paths[k]) in ("article", "main") for k in b.around):
                total += len(b.text)
                for k in b.around:
                    score[k] += len(b.text)
    if not total:
        return -1, 0.0
    inner = [k for k, s in score.items() if s >= MOST * total]
    # containers are numbered from the outside in, so the last is the innermost
    return max(inner), total


def _tag(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def _is_page(path: str) -> bool:
    """Whether a container is the whole page and not a part of it."""
    return _tag(path) in ("", "html", "body")


def _chain(k: int, parents: list[int]) -> list[int]:
    """A container and those around it, from the inside out."""
    chain = []
    while k >= 0:
        chain.append(k)
        k = parents[k]
    return chain


def _link_lists(blocks: list[Block]) -> set[int]:
    """Containers that hold links and little else."""
    size: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        for k in b.around:
            size[k][0] += len(b.text)
            size[k][1] += b.linked
    return {k for k, (n, linked) in size.items() if linked > 0.6 * n}


def _holds_article_only(blocks: list[Block], k: int, around: int, lists: set[int]) -> bool:
    """Whether all that ``around`` holds besides ``k`` may be the article's own."""
    more = [b for b in blocks if around in b.around and k not in b.around]
    # the only headline of the page stands in the article's own header, not in the site's
    headless = not any(b.head == 1 and k in b.around for b in blocks)
    for b in more:
        if b.apart >= 0:
            if b.by in _HEADS or b.by == "p":
                continue
            if not (headless and b.by == "header" and any(o.head == 1 and 2 * o.linked <= len(o.text) for o in more if o.by == "header" and o.apart == b.apart)):
                return False
        elif lists.intersection(b.around) or 2 * b.linked > len(b.text) and not b.head:
            return False
    return True


def climbed(k: int, blocks: list[Block], paths: list[str], parents: list[int], lists: set[int]) -> int:
    """The article around a container, and as far out as containers hold the article's text only."""
    chain = _chain(k, parents)
    named = [c for c in chain if _tag(paths[c]) == "article"] or [c for c in chain if _tag(paths[c]) == "main"]
    k = named[-1] if named else k
    for around in _chain(k, parents)[1:]:
        if _is_page(paths[around]) or not _holds_article_only(blocks, k, around, lists):
            break
        k = around
    return k


def _inside(blocks: list[Block], chosen: set[int], paths: list[str], parents: list[int]) -> list[bool]:
    """Which blocks the chosen containers hold; a whole page has no part in blocks set apart."""
    parts = {k for k in chosen if not _is_page(paths[k])}
    return [bool(chosen.intersection(b.around) if b.apart < 0 else parts.intersection(_chain(b.apart, parents))) for b in blocks]


def _beside(chosen: set[int], blocks: list[Block], paths: list[str], parents: list[int], lists: set[int]) -> set[int]:
    """Containers beside the chosen ones, outside any article, that hold prose and no noise."""
    around = {parents[k] for k in chosen if not _is_page(paths[k]) and not {"article", "main"}.intersection(_tag(paths[c]) for c in _chain(k, parents))}
    found = set()
    total = sum(_worth(b) for b in blocks if b.apart < 0)
    for k in range(len(paths)):
        if parents[k] not in around or k in chosen or k in lists:
            continue
        mine = [b for b in blocks if k in b.around]
        if all(b.apart < 0 for b in mine) and sum(_worth(b) for b in mine if len(b.text) >= PROSE) >= max(PROSE, BESIDE * total):
            found.add(k)
    return found


def _edge_lists(blocks: list[Block], held: list[bool], lists: set[int], ours: set[int], paths: list[str], parents: list[int]) -> set[int]:
    """Lists of links at either end of the article that no heading leads to: its menus."""
    rows = [b for b, h in zip(blocks, held) if h]
    linkish = [bool(lists.intersection(b.around)) and 2 * b.linked > len(b.text) for b in rows]
    if all(linkish):
        return set()
    found = set()
    first = linkish.index(False)
    last = len(rows) - 1 - linkish[::-1].index(False)
    ends = rows[:first] + (rows[last + 1:] if not rows[last].head else [])
    for b in ends:
        inner = [k for k in b.around if k in lists and ours.intersection(_chain(parents[k], parents)) and _tag(paths[k]) not in ("article", "main")]
        found.update(inner[:1])
    return found


def _digest(text: str) -> str:
    """Name of a doubtful text; no path begins like it."""
    return "=" + hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def _doubtful(blocks: list[Block], lists: set[int], paths: list[str]) -> list[Block]:
    """Blocks that are noise if a host repeats them: under doubtful names, or links inside an article."""
    return [b for b in blocks if not b.head and (b.doubt or lists.intersection(b.around) and any(_tag(paths[k]) in ("article", "main") for k in b.around))]


def extract(page: str | None, winners: list[str] | None = None) -> str:
    """Main text of a page: what the winning paths hold, or else its own best container.

    ``winners`` are a host's paths, those of joined boxes after a ``+``, and names of texts that it
    repeats. Without any the page's own evidence decides.
    """
    if not page:
        return ""
    blocks, paths, parents = blocks_of(page)
    own, total = best_container(blocks, paths)
    if own < 0:
        return ""
    lists = _link_lists(blocks)
    wanted = set(winners or ())
    if any(w.startswith("=") for w in wanted):
        gone = {id(b) for b in _doubtful(blocks, lists, paths) if _digest(b.text) in wanted}
        blocks = [b for b in blocks if id(b) not in gone]
    chosen = {climbed(k, blocks, paths, parents, lists) for k, p in enumerate(paths) if p in wanted}
    held = _inside(blocks, chosen, paths, parents)
    if sum(_worth(b) for b, is_held in zip(blocks, held) if is_held and b.apart < 0) < 0.5 * total or not any(held):
        chosen = {climbed(own, blocks, paths, parents, lists)}
    chosen |= {k for k in _beside(chosen, blocks, paths, parents, lists) if not wanted or "+" + paths[k] in wanted}
    held = _inside(blocks, chosen, paths, parents)
    # lists of links are the article's own inside it, but for menus at its ends
    inner = [k for k, p in enumerate(paths) if k in chosen and not _is_page(p) or _tag(p) in ("article", "main")]
    ours = set(inner)
    menus = _edge_lists(blocks, held, lists, ours, paths, parents)
    outer = {c for k in chosen for c in _chain(k, parents)} - chosen
    lists = {k for k in lists if not ours.intersection(_chain(k, parents))} - chosen - outer | menus
    text = []
    follows = False
    for b, is_held in zip(reversed(blocks), reversed(held)):
        if is_held:
            keep = not lists.intersection(b.around)
        else:  # a headline or paragraph right in a container around the chosen ones
            keep = b.apart < 0 and b.around[-1] in outer and (follows if b.head else 2 * b.linked <= len(b.text))
        if keep:
            text.append(b.text)
        follows = keep
    return "\n".join(reversed(text))


def page_votes(page: str) -> list[str]:
    """What a page votes for: its container's path, boxes beside it (``+``) and doubtful texts."""
    blocks, paths, parents = blocks_of(page)
    own, _ = best_container(blocks, paths)
    if own < 0:
        return []
    lists = _link_lists(blocks)
    best = climbed(own, blocks, paths, parents, lists)
    joined = {"+" + paths[k] for k in _beside({best}, blocks, paths, parents, lists)}
    # the box that wins on another page may be the one beside it here
    joined |= {"+" + paths[best]} if joined else set()
    return [paths[best], *sorted(joined), *sorted({_digest(b.text) for b in _doubtful(blocks, lists, paths)})]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = page.as_py()
            if page:
                name = int.from_bytes(hashlib.md5(page.encode("utf-8", "replace")).digest()[:7], "big")
                for path in page_votes(page):
                    row = votes.setdefault((host, path), [0.0, name, name])
                    row[:] = row[0] + 1, min(row[1], name), max(row[2], name)
        rows = [(*k, *v) for k, v in votes.items()]
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["host", "path", "votes", "first", "last"])


def winning_paths(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(host, paths)``: the generalised paths of each host's main text, of boxes that belong to
    it, and the names of texts that different pages of it repeat. ``pages`` has ``host``."""
    bound_batches(pages.sparkSession)
    votes = pages.select("host", F.col(html)).mapInArrow(_votes, "host string, path string, votes double, first long, last long").groupBy("host", "path").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    # distinct paths and doubtful texts of one host; only sums over them are needed
    sign = F.substring("path", 1, 1)
    is_path = ~sign.isin("+", "=")
    of_host = votes.groupBy("host").agg(F.sum(F.when(is_path, F.col("votes"))).alias("all"), F.max(F.when(is_path, F.col("votes"))).alias("best"))
    fair = F.when(is_path, F.greatest(F.col("all") * FAIR, F.col("best") * NEAR_BEST)).when(sign == "+", F.col("all") * FAIR).otherwise(F.greatest(F.lit(2.0), F.col("all") * REPEATED))
    # a text on one page, or on copies of it, isn't repeated; at most 1 / REPEATED texts a doubtful block of a page stay
    kept = votes.join(of_host, "host").filter((F.col("votes") >= fair) & ((sign != "=") | (F.col("first") != F.col("last"))))
    return kept.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for page, winners in batches:
        yield pa.array([extract(p.as_py(), w.as_py()) for p, w in zip(page, winners)], pa.string())


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add text and n_chars (its code points) to every page.

    Null or empty pages, and pages without any article text, have an empty text. Pages without a
    host vote together. Repeated rows get equal texts. Whole pages are read, however long. An
    empty table gives no rows. Input columns named text or n_chars give way.
    """
    bound_batches(pages.sparkSession)
    based = pages.withColumn("__host", host_of(F.col(url)))
    winners = stored(winning_paths(based.select(F.col("__host").alias("host"), F.col(html).alias("html"))), "op3-winners")
    met = based.join(winners.select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "__host", "left")

    @F.arrow_udf("string")
    def extracted(page: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _extracted(page)

    texted = with_columns(met, {"text": extracted(F.col(html), F.col("__paths"))}).drop("__host", "__paths")
    return with_columns(texted, {"n_chars": F.char_length(F.col("text")).cast("long")})
