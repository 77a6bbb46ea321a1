"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words of the languages a corpus holds; a parameter of ``main_text``.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their they this to was we were what when which who will with you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und uns von vor war wie wir zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous
    al como con de del el ella en es esta este ha la las lo los más me no o para pero por que se si sin sobre su sus un una y ya
    ai alla anche che chi ci come cui da dal dalla degli dei della delle di gli hanno i il io loro ma nei nel nella non più quando questa questo sono sua suo tra è
    à ao aos às com da das dos e ela ele em entre essa esse foi isso já mais mas muito na não nas nos num o os ou pela pelo quando são seu sua também tem uma
    aan bij dat deze die dit door een heeft het hij ik je maar met naar niet nog of om ook op te tot uit van voor werd wordt worden ze zijn
    att av blev den det eller efter ett från för har hon inte jag kan man med men och om på sig som till var vid är at blev ble de det eller er et fra ikke jeg og på som til ved å
    ale bo był była było co czy dla do go ich jak jako jest już które który lub na nie od po przez przy są się tak to tym tylko w we z za ze że a aby byl byla i jako je jeho k který na nebo o po pro při s se si tak také v z za že
    без бы был была были было в во все вы для до его ее если и из или их к как когда который на не но о об от по при с со так также то только у что это я а але в вона він для до з за і й на не по про та у це що як є
    ei en että hän ja joka jos kuin kun mutta myös niin on oli ovat se sen tai tämä ve bir bu da de için ile gibi çok daha olarak olan o ne kadar
    dan di dengan dari dalam ini itu untuk pada yang tidak adalah oleh và các của cho có được không là một những trong với
    và في من على إلى أن هذا التي الذي عن مع ما لا هو هي كان का की के में है और से को पर यह था
    """.split()
)
#: Elements whose text never is main text.
_RAW = "script|style|noscript|template|title|textarea|svg|math|iframe|object|select"
_OUT = frozenset("nav footer aside form menu dialog button fieldset".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: Furniture that never is a wrapper of the page for the mass of its text alone.
_ASIDE = frozenset("nav footer aside menu dialog button".split())
_WORDS = (
    r"(?:ad|ads|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|social|sidebar|side|nav[a-z]*|menu[a-z]*|breadcrumbs?|pagination|pager"
    r"|footer|header|masthead|related|recommended|comments?|commentlist|discussion|replies|reply|widget|toolbar|login|signup|search|contentinfo|complementary|disclaimer)"
)
#: Whole names in class, id or role that mark furniture of a page: such words, also joined, or after the place they stand at.
_FURNITURE = re.compile(rf"(?:^|\s)(?:(?:site|page|global|main|primary|secondary|top|bottom)[_-]+)*{_WORDS}(?:[_-]+{_WORDS})*(?=\s|$)", re.I)
#: Core words of names that mark reader comments, adverts and legal lines, and the words they are joined with: 'comments-area', 'adSlot_2'. A name
#: with any other word ('ad-hoc-networks', 'has-comments') says nothing.
_CORE = frozenset(
    """
    comment comments commentlist disqus replies respond
    ad adbox ads adsbygoogle adsense adslot adunit advert advertisement advertising adverts outbrain sponsor sponsored taboola
    consent cookie cookies copyright gdpr
    """.split()
)
_JOINED = frozenset(
    """
    area author banner bar block body bottom box container content count desktop dialog embed entry footer form google group header inner item left line link links list main message
    meta mobile notice outer page panel policy popup post reader readers reply right root section side site slot stripe text thread title top unit user users wrap wrapper zone
    """.split()
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+x?[0-9]*")
#: Elements that may wrap a page although it is hidden until a script shows it.
_BOXES = frozenset("div section main article form".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|</?[a-zA-Z][^<>]*(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_EDGES = re.compile(r"^\W+|\W+$")

#: Characters of scripts without spaces say as much as three of the others.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

#: Thresholds of the block rules.
SHORT, LINKED, UNLINKED, DENSE = 70, 0.5, 0.2, 0.30


class Block(NamedTuple):
    text: str
    link_chars: int
    zone: int  # 0: outside; n: inside the n-th article or main element
    furniture: int  # the innermost element that makes it furniture, by its place in the page; 0: none
    article: int  # the outermost article or main element around it, furniture or not; 0: none
    story: int  # the outermost article element around it; 0: none


class Marked(NamedTuple):
    """An element that makes its text furniture."""

    tag: str
    around: int  # the next such element around it


@lru_cache(1 << 12)
def _marks(named: str) -> bool:
    """Whether names of an element mark it as furniture."""
    if _FURNITURE.search(named):
        return True
    for name in named.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not _CORE.isdisjoint(parts) and all(p in _CORE or p in _JOINED or p[0].isdigit() for p in parts):
            return True
    return False


def _hidden(attrs: str) -> bool:
    """Whether an element is not shown: ``hidden``, ``aria-hidden`` or a style that says so."""
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            return True
    return False


def _read(page: str, wrappers: frozenset[int]) -> tuple[list[Block], dict[int, Marked], dict[int, int]]:
    """Blocks, furniture elements but for the ``wrappers``, and the furniture element around each outermost article."""
    out: list[Block] = []
    marked: dict[int, Marked] = {}
    articles: dict[int, int] = {}
    stack: list[tuple[str, int, int, int, int]] = []  # tag, furniture, zone, article, story
    parts: list[str] = []
    linked = zones = in_link = 0
    unseen, depth = "", 0  # the hidden inline element that the text is in

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, bad, zone, article, story = stack[-1] if stack else ("", 0, 0, 0, 0)
            out.append(Block(text, linked, zone, bad, article, story))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            linked += len(text.strip()) if in_link else 0

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            if m["raw"]:
                flush()
            continue
        tag, close = m["tag"].lower(), bool(m["close"])
        if tag == "a":
            in_link = 0 if close else 1
        if tag in _INLINE:
            if tag == unseen:
                depth += -1 if close else 1
                unseen = unseen if depth else ""
            elif not unseen and not close and tag not in _VOID and _hidden(m["attrs"] or ""):
                unseen, depth = tag, 1
            if tag in ("br", "img", "input", "wbr"):
                parts.append(" ")
            continue
        flush()
        in_link, unseen, depth = 0, "", 0
        if tag in _VOID:
            continue
        if close:
            names = [s[0] for s in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        _, bad, zone, article, story = stack[-1] if stack else ("", 0, 0, 0, 0)
        gone = at not in wrappers and tag not in ("html", "head", "body") and _hidden(m["attrs"] or "")
        named = " ".join(next(filter(None, g), "") for g in _NAMED.findall(m["attrs"] or ""))
        if tag in _MAIN and not article:
            article = at
            articles[at] = bad
        if tag == "article" and not story:
            story = at
        if tag in _MAIN and not zone and not bad and not gone:
            zones += 1
            zone = zones
        if gone or (at not in wrappers and tag not in ("html", "head", "body") and (tag in _OUT or (tag == "header" and not zone) or (tag not in _MAIN and named and _marks(named)))):
            marked[at] = Marked("aside" if gone and tag not in _BOXES else tag, bad)
            bad = at
        stack.append((tag, bad, zone, article, story))
    add(page[at:])
    flush()
    return out, marked, articles


def _wrappers(found: list[Block], marked: dict[int, Marked], articles: dict[int, int]) -> set[int]:
    """Furniture elements that hold the page's article, or two thirds of its text where no article stands free."""
    held, stories = dict.fromkeys(marked, 0), dict.fromkeys(articles, 0)
    free = every = 0
    for b in found:
        plain = max(len(b.text) - b.link_chars, 0)
        every += plain
        if b.furniture:
            held[b.furniture] += plain
        else:
            free += plain
        if b.article:
            stories[b.article] += plain
    if any(b.zone and not b.furniture and _long(b.text) and b.link_chars <= UNLINKED * len(b.text) for b in found):
        return set()
    for at in reversed(list(marked)):  # inner ones come later in the page
        if marked[at].around:
            held[marked[at].around] += held[at]
    out = {at for at, n in held.items() if 3 * n > 2 * every and marked[at].tag not in _ASIDE}
    story = max(stories, key=lambda k: stories[k], default=0)
    chain, at = [], articles.get(story, 0)
    while at:
        chain.append(at)
        at = marked[at].around
    beside = 2 if any(marked[at].tag in _ASIDE for at in chain) else 1  # a teaser in an aside is no article of the page
    if chain and stories[story] > beside * free and not any(b.zone and not b.furniture for b in found):
        out.update(chain)
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what the rules look at.

    A block ends at every tag that is not inline. Unclosed elements end with the element around them. An element that wraps the
    article or nearly all text makes nothing furniture, whatever its name.
    """
    wrappers: frozenset[int] = frozenset()
    while True:
        found, marked, articles = _read(page, wrappers)
        more = _wrappers(found, marked, articles) if marked else set()
        if not more:
            return found
        wrappers |= more


def _teasers(found: list[Block]) -> set[int]:
    """Articles beside a page's longest one that only point elsewhere: at most a third of its text, with links or of one or two blocks."""
    mass: dict[int, int] = {}
    links: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in found:
        if b.story and not b.furniture:
            mass[b.story] = mass.get(b.story, 0) + len(b.text) - b.link_chars
            links[b.story] = links.get(b.story, 0) + b.link_chars
            count[b.story] = count.get(b.story, 0) + 1
    most = max(mass.values(), default=0)
    return {k for k, n in mass.items() if 3 * n <= most and (links[k] or count[k] <= 2)}


def _long(text: str) -> bool:
    return len(text) >= SHORT or len(text) + 2 * len(_UNSPACED.findall(text)) >= SHORT


def _decide(block: Block, has_main: bool, stop_words: frozenset[str]) -> bool | None:
    """First pass: True main text, False furniture, None undecided."""
    if block.furniture or block.link_chars > LINKED * len(block.text):
        return False
    if not _long(block.text):
        return None
    if has_main:
        return block.zone > 0
    if block.link_chars <= UNLINKED * len(block.text):
        return True
    words = [_EDGES.sub("", w) for w in block.text.lower().split()]
    density = sum(w in stop_words for w in words) / len(words)
    return True if density >= DENSE else None


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The page's main text: kept blocks joined by a newline.

    First pass: blocks inside furniture elements, hidden ones, teaser articles or mostly made of links are furniture. Where the page marks its article, long blocks
    are decided by standing inside it; elsewhere they are main text if they hold few links, in any language, and
    with more links if they are dense in stop words.
    Second pass: short and linked blocks take the label of the nearest decided block of the same zone;
    where both sides are as near and differ, where a zone has no decided block at all, and where the page has no
    block decided as main text, they are kept inside an article and dropped outside if the page has one. NULL and empty pages give ''; equal pages give equal texts.
    """
    if not page:
        return ""
    found = blocks(page)
    teasers = _teasers(found)
    found = [b._replace(furniture=b.story) if b.story in teasers else b for b in found]
    has_main = any(b.zone and not b.furniture for b in found)
    labels = [_decide(b, has_main, stop_words) for b in found]
    some = True in labels
    kept = []
    last: dict[int, tuple[int, bool]] = {}
    before: list[tuple[int, bool] | None] = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        before.append(last.get(b.zone))
        if label is not None and not b.furniture:
            last[b.zone] = (i, label)
    after: dict[int, tuple[int, bool]] = {}
    nexts: list[tuple[int, bool] | None] = [None] * len(found)
    for i in range(len(found) - 1, -1, -1):
        nexts[i] = after.get(found[i].zone)
        if labels[i] is not None and not found[i].furniture:
            after[found[i].zone] = (i, bool(labels[i]))
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label is None:
            near = [x for x in (before[i], nexts[i]) if x]
            least = min((abs(i - x[0]) for x in near), default=0)
            votes = {x[1] for x in near if abs(i - x[0]) == least}
            label = votes.pop() if some and len(votes) == 1 else (b.zone > 0 or not has_main)
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def page_text(page: Column) -> Column:
    """``main_text`` as a column: row-local, so any partitioning and any loss of executors is fine."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(page)
