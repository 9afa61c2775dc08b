"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

Words score positive and tags negative, with weights from labelled pages: those that mark their
article with <article>, <main> or itemprop="articleBody" say for each kind of word and tag how
often it stands inside. A linear scan finds the region with the largest sum; it is completed to
its blocks and the innermost article around it, or, where nothing is marked, to the element it lies in. Menus, headers, footers, sidebars, notices, adverts,
forms, comments and the like are left out of it by element, role and class.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Contents that are never text of the page.
RAW = frozenset("script style title textarea noscript template iframe object svg math select option button datalist audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
JUNK = frozenset("nav header footer aside form dialog menu fieldset label address".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WRAPPERS = frozenset("form fieldset".split())  # of a whole page at times
# Words of class and id values, split at anything but letters. They tell what an element is, unless
# it holds most of the page's words; after one of STATES, they tell what else the page has.
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus discussion social share sharing related recommended widget pagination pager toolbar".split())
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())  # may well be longer than the article
STATES = frozenset("has with without no is not".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
# Elements that are followed from start to end; others only part blocks.
CONTAINER = frozenset("article main section div body td table ul ol blockquote".split()) | JUNK
KNOWN = BLOCK | VOID | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
# A tag behind its name, to its end. Quotes count only where a value begins, and only if they close.
TAG_REST = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+>""")
# What counts before any page is read: (inside, outside) of each kind.
PRIOR = {"word p": (50, 5), "word h": (6, 3), "word li": (3, 3), "word td": (2, 2), "word other": (4, 6), "word link": (2, 20), "word junk": (1, 60)}
TAG_PRIOR, LEAST_TAG_COST, LIMIT = (2.0, 2.0), 0.05, 4.0


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    path: tuple[int, ...] = ()
    junk: bool = False
    articles: tuple[int, ...] = ()  # those of the path that are marked as articles
    kind: str = "other"

    @property
    def inside(self) -> bool:
        return bool(self.articles)

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends before ``at``: at the first > outside quoted values. A
    quote that never closes on the page is none."""
    found = TAG_REST.match(page, at)
    return found.end() - 1 if found else len(page)


def _attributes(page: str, start: int, end: int) -> dict[str, str]:
    """The attributes of a tag; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(page, start, end):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(given.get("style", "").split()).lower()


def _junk(name: str, given: dict[str, str]) -> bool:
    role = given.get("role", "").lower()
    return _hidden(given) or (name in JUNK and name not in WRAPPERS) or (role in JUNK_ROLES and role != "form")


def _junk_names(name: str, given: dict[str, str]) -> set[str]:
    """What speaks for junk, if the element does not hold most of the page."""
    if name in ("main", "body"):  # their names tell what else the page has
        return set()
    out = {"form"} if name in WRAPPERS or given.get("role", "").lower() == "form" else set()
    for one in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        before = ""
        for word in re.split(r"[^a-z]+", one):
            if word in JUNK_NAMES and before not in STATES:
                out.add(word)
            before = word
    return out


def _settle_names(blocks: list[Block], tokens: list[tuple[str, int, int]], named: dict[int, set[str]]) -> list[tuple[str, int, int]]:
    """Decides which of the elements with junk names are junk, and marks their blocks and words: not
    those that hold most of the page's words (if they are named after comments, its heading too)."""
    total, held, headed = 0, dict.fromkeys(named, 0), set()
    for kind, b, n in tokens:
        if kind.startswith("word") and not blocks[b].junk:
            total += n
            for e in blocks[b].path:
                if e in held:
                    held[e] += n
                    if kind == "word h1":
                        headed.add(e)
    junk = {e for e, names in named.items() if 2 * held[e] <= total or (names & COMMENTS and e not in headed)}
    for block in blocks:
        block.junk = block.junk or any(e in junk for e in block.path)
    plain = {"word h1": "word h"}
    return [("word junk" if blocks[b].junk and kind.startswith("word") else plain.get(kind, kind), b, n) for kind, b, n in tokens]


def parsed(page: str) -> tuple[list[Block], list[tuple[str, int, int]]]:
    """The blocks of a page, and its tokens: (kind, block, n) for n words of a kind or one tag."""
    blocks, tokens = [Block()], []
    open_elements: list[tuple[str, int, bool, bool]] = []  # name, number, junk, article
    named: dict[int, set[str]] = {}  # elements whose names speak for junk
    number, links, kind, at = 0, 0, "other", 0
    # An inline element that is hidden: its name, how many of that name and how many blocks are
    # open in it. It ends with its closing tag, or with the block it lies in.
    veil, same, inner, in_p = "", 0, 0, False

    def flush() -> None:
        if blocks[-1].pieces:
            blocks.append(Block())
        _settle(blocks[-1])

    def _settle(block: Block) -> None:
        block.path = tuple(e[1] for e in open_elements)
        block.junk = any(e[2] for e in open_elements)
        block.articles = tuple(e[1] for e in open_elements if e[3])
        block.kind = kind

    def words(text: str) -> None:
        if text and not veil:
            text = entities.unescape(text)
            blocks[-1].pieces.append(text)
            if n := len(text.split()):
                block = blocks[-1]
                tokens.append((f"word {'junk' if block.junk else 'link' if links else block.kind}", len(blocks) - 1, n))

    while at < len(page):
        found = TAG.search(page, at)
        if not found:
            words(page[at:])
            break
        words(page[at : found.start()])
        if found.group() == "<!--":
            end = page.find("-->", found.end())
            at = len(page) if end < 0 else end + 3
            continue
        name = (found.group(2) or "!").lower()
        end = page.find(">", found.end()) if name == "!" else _tag_end(page, found.end())
        end = len(page) if end < 0 else end
        at = min(len(page), end + 1)
        closing = found.group(1) == "/"
        if name in RAW:
            if not closing and page[end - 1 : end] != "/":
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = len(page) if not close else min(len(page), _tag_end(page, close.end()) + 1)
            continue
        if name == "!":
            continue
        if veil:
            if name == veil:
                same += -1 if closing else 1
            elif name in BLOCK and name not in VOID:
                inner += -1 if closing else 1
            if same == 0 or inner < 0 or (in_p and name in BLOCK):
                veil = ""
                if name not in BLOCK:
                    links = 0 if name == "a" else links
                    continue
            else:
                continue
        tokens.append((f"tag {'/' if closing else ''}{name if name in KNOWN else 'other'}", len(blocks) - 1, 1))
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            blocks[-1].pieces.append(" ")
        elif name in BLOCK:
            links, in_p = 0, name == "p" and not closing
            if closing:
                if name in CONTAINER and any(e[0] == name for e in open_elements):
                    while open_elements.pop()[0] != name:
                        pass
                kind = "other"
            else:
                kind = "h1" if name == "h1" else "h" if re.fullmatch("h[2-6]", name) else name if name in ("p", "li", "td") else "p" if name in ("blockquote", "pre", "dd") else "other"
                if name in CONTAINER:
                    given = _attributes(page, found.end(), end)
                    number += 1
                    if names := _junk_names(name, given):
                        named[number] = names
                    open_elements.append((name, number, _junk(name, given), name in ARTICLE or given.get("itemprop", "").lower() == "articlebody"))
            flush()
        elif not closing and name not in VOID and not blocks[-1].junk and _hidden(_attributes(page, found.end(), end)):
            veil, same, inner = name, 1, 0
    return blocks, _settle_names(blocks, tokens, named)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of standing inside the article, each kind against all words or all tags, from
    counts of (kind, inside); tags always cost something, and words outside junk earn something."""
    kinds = {k for k, _ in counts} | set(PRIOR)
    out = {}
    for group in ("word", "tag"):
        own = {k for k in kinds if k.startswith(group)}
        prior = lambda k: PRIOR.get(k, TAG_PRIOR)
        n_in = sum(counts.get((k, True), 0) + prior(k)[0] for k in own) or 1
        n_out = sum(counts.get((k, False), 0) + prior(k)[1] for k in own) or 1
        for k in own:
            odds = math.log((counts.get((k, True), 0) + prior(k)[0]) / n_in) - math.log((counts.get((k, False), 0) + prior(k)[1]) / n_out)
            odds = max(-LIMIT, min(LIMIT, odds))
            if group == "tag":
                odds = -LEAST_TAG_COST - max(0.0, -odds)
            elif k in ("word p", "word h"):
                odds = max(0.5, odds)
            out[k] = odds
    return out


def best_region(tokens: list[tuple[str, int, int]], weight: dict[str, float]) -> tuple[int, int] | None:
    """First and last block of the contiguous tokens with the largest positive sum; the earliest of equal ones."""
    best, found, total, start = 0.0, None, 0.0, 0
    for k, (kind, _, n) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, k
        total += n * weight.get(kind, -1.0 if kind.startswith("tag") else 0.5)
        if total > best:
            best, found = total, (start, k)
    if not found:
        return None
    held = [b for kind, b, _ in tokens[found[0] : found[1] + 1] if kind.startswith("word")]
    return (held[0], held[-1]) if held else None


def main_text(page: str, weight: dict[str, float]) -> str:
    """The blocks of the best region and of the innermost article or, without one, element around it,
    joined by blank lines."""
    blocks, tokens = parsed(page)
    region = best_region(tokens, weight)
    if region is None:
        return ""
    first, last = region
    good = [b for b in range(first, last + 1) if not blocks[b].junk and blocks[b].text()]
    if not good:
        return ""
    shared = blocks[good[0]].path
    for b in good:
        n = 0
        while n < min(len(shared), len(blocks[b].path)) and shared[n] == blocks[b].path[n]:
            n += 1
        shared = shared[:n]
    around = [e for e in blocks[good[0]].articles if e in shared]
    touched = {e for b in good for e in blocks[b].articles}
    if around:  # the article that the region lies in, without others in it
        chosen = [k for k, b in enumerate(blocks) if around[-1] in b.articles and not b.junk and touched.issuperset(b.articles)]
    elif touched:  # the region, and the whole of each article that it reaches into
        chosen = [k for k, b in enumerate(blocks) if not b.junk and (first <= k <= last or (b.articles and touched.issuperset(b.articles)))]
    elif len(shared) > 1:
        chosen = [k for k, b in enumerate(blocks) if b.path[: len(shared)] == shared and not b.junk]
    else:
        while first > 0 and not blocks[first - 1].junk and blocks[first - 1].kind in ("p", "h", "h1"):
            first -= 1
        while last + 1 < len(blocks) and not blocks[last + 1].junk and blocks[last + 1].kind in ("p", "h", "h1"):
            last += 1
        chosen = [k for k in range(first, last + 1) if not blocks[k].junk]
    return "\n\n".join(t for k in chosen if (t := blocks[k].text()))


def label_counts(pages: DataFrame) -> dict[tuple[str, bool], int]:
    """(kind, inside the article) over all pages that mark an article. There are a few hundred
    kinds whatever the pages; a task sends its sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for page in batch["html"]:
                blocks, tokens = parsed(page)
                if any(b.inside for b in blocks):
                    for kind, b, n in tokens:
                        key = kind, blocks[b].inside and not blocks[b].junk
                        total[key] = total.get(key, 0) + n
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "inside", "n"]).astype({"inside": bool, "n": "int64"})

    text = pages.select(F.coalesce(F.col("html"), F.lit("")).alias("html"))
    sums = text.mapInPandas(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return {(r["kind"], r["inside"]): r["n"] for r in sums.collect()}


def extracted(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; weights are learned from the pages unless given.

    A null or empty page, or one without content, has an empty text. Every row stands for
    itself; pages without an <article> are scored by the weights alone."""
    known = weights(label_counts(pages)) if weight is None else weight

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, known) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
