"""The main text of HTML pages by two passes of rules over text blocks."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_text

#: Frequent function words of the pages' languages.
STOP_WORDS = frozenset((
    "a an and are as at be by for from has he in is it its not of on or that the this to was were will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einer es für ich im in ist mit nicht sich sie und von zu zur "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ou par pas plus pour que qui sur un une "
    "al como con del el ella en es la las lo los no o para pero por que se sin su sus un una y").split())
#: Elements whose text is never shown or never part of an article.
NEVER = frozenset("head script style template noscript iframe svg object select option textarea button form nav aside footer menu dialog audio video canvas map".split())
#: Elements that hold an article.
ARTICLE = frozenset(("article", "main"))
#: Elements that open a section of their own, and whose ends are looked for.
SECTION = NEVER | ARTICLE | frozenset("html body div section header table ul ol dl blockquote figure details fieldset".split())
#: Elements that part blocks without holding sections.
PARTS = SECTION | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre hr address summary legend center title".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words in class or id that name what is not the article.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|sidebar|side|menu|nav\w*"
    r"|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|related|recommended|share|sharing|social|widget|toolbar|pagination|login|signup)(?:$|[\s_-])", re.I)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form)\b", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*>|([^<]+|<)", re.S | re.I)
NAMES = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[^\W\d_]+")

#: Length (code points) below which a block is ambiguous, and from which a dense block is surely text.
SHORT, LONG = 70, 200
#: Shares of stop words: from the first a block reads like text, below the second it does not.
DENSE, SPARSE = 0.30, 0.10
#: Share of a block's characters inside links from which it is a menu.
LINKED = 0.33


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, linked characters, in a section that is never text, number of the article that holds it or 0) in page order."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, never text, article
    text: list[str] = []
    linked, in_link, articles = 0, 0, 0

    def shut() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                _, never, article = stack[-1] if stack else ("", False, 0)
                out.append((whole, linked, never, article))
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m[5] is not None:
            text.append(m[5])
            if in_link:
                linked += len(m[5].strip())
            continue
        name = (m[3] or m[1] or "").lower()
        if m[1] or not name:
            if m[1] and name not in ("svg",):
                text.append(" ") if name not in ("script", "style") else None
            continue
        if name == "a":
            in_link = max(0, in_link + (-1 if m[2] else 1)) if m[2] or not in_link else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in PARTS:
            continue
        shut()
        if name not in SECTION or name in VOID:
            continue
        in_link = 0
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "body":
            stack.clear()
        never, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        attrs = m[4] or ""
        if name in ARTICLE and not never:
            articles += 1
            article = articles
        if attrs and name not in ("html", "body", "article", "main"):
            never = never or bool(ROLES.search(attrs) or HIDDEN.search(attrs)) or any(BOILER.search(" ".join(filter(None, g))) for g in NAMES.findall(attrs))
        never = never or name in NEVER or name == "header" and not article
        if not attrs.rstrip().endswith("/"):
            stack.append((name, never, article))
    shut()
    return out


def first_pass(text: str, linked: int, never: bool) -> str:
    """``good`` (long and dense in stop words), ``bad`` (links, a section that is never text, or long without stop words), or
    ambiguous: ``near`` (reads like text but is not long), ``sparse`` (does not, but is not long either), ``short``."""
    n = len(text)
    if never or linked > LINKED * n or text.startswith("©") and n < LONG:
        return "bad"
    if n < SHORT:
        return "short"
    words = WORD.findall(text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0
    if n >= LONG:
        return "good" if stops >= DENSE else "near" if stops >= SPARSE else "bad"
    return "near" if stops >= SPARSE else "sparse"


def _neighbours(labels: list[str], section: list[int], never: list[bool]) -> list[tuple]:
    """The nearest decided blocks (place, label) before and after each undecided one in its section; what is never text
    does not count inside an article."""
    out: list[list] = [[None, None] for _ in labels]
    for side, way in ((0, range(len(labels))), (1, range(len(labels) - 1, -1, -1))):
        last: dict[int, tuple[int, str]] = {}
        for k in way:
            if labels[k] in ("good", "bad"):
                last[0 if never[k] else section[k]] = (k, labels[k])
            else:
                out[k][side] = last.get(section[k])
    return out


def main_text(page: str) -> str:
    """The article's blocks, one to a line.

    First pass: each block alone. Second pass: ``near`` blocks are good if the nearest decided block before or after them
    is; then ``short`` and ``sparse`` ones take the label of the nearer of the two (of two as near, the one after).

    Elements that hold an article say more than densities can, as articles may hold blocks of any kind: where a page has
    them, blocks outside are not text, a long block without stop words inside is ambiguous and not bad, neighbours are looked
    for in the same element, and what has none there is good.
    """
    got = blocks(page)
    never, section = [b[2] for b in got], [b[3] for b in got]
    labels = [first_pass(t, link, out) for t, link, out, _ in got]
    if inside := any(a and not out for a, out in zip(section, never)):
        sure = [out or link > LINKED * len(t) or t.startswith("©") for t, link, out, _ in got]
        labels = ["bad" if not a else "sparse" if x == "bad" and not s else x for x, a, s in zip(labels, section, sure)]
    for k, (a, b) in enumerate(_neighbours(list(labels), section, never)):
        if labels[k] == "near":
            labels[k] = "good" if a is None and b is None or "good" in (a and a[1], b and b[1]) or inside else "bad"
    for k, (a, b) in enumerate(_neighbours(list(labels), section, never)):
        if labels[k] not in ("good", "bad"):
            labels[k] = ("good" if inside else "bad") if a is None and b is None else (b if a is None or b and b[0] - k <= k - a[0] else a)[1]
    return "\n".join(t for (t, *_), label in zip(got, labels) if label == "good")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``text`` (the main text; empty if none) and ``n_chars`` (its code points) of each page, with id and address.

    A null page counts as empty; null ids and addresses are kept; repeated rows come out repeated; other columns do not
    matter. No shuffle.
    """
    def run(keys, texts):
        got = [main_text(t or "") for t in texts]
        return {"id": keys, "text": got, "n_chars": [len(t) for t in got]}

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.struct(F.col(id_col).alias("i"), F.col(url_col).alias("u")).alias("k"), html_col)
    return map_text(rows, "k", html_col, run, f"id struct<i:{kinds[0]},u:{kinds[1]}>, text string, n_chars bigint").select(
        F.col("id.i").alias(id_col), F.col("id.u").alias(url_col), "text", "n_chars")
