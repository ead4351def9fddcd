"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path.  Text length and punctuation are summed
per path and divided by its nodes, smoothed over neighbouring paths in page order,
multiplied, and the paths above a threshold are content.  Parts that markup itself
names as menus, adverts, forms, comments and the like take no part, save where a class
or id names what holds the title or the greater part of the text.  All blocks of the
content paths are main text, and with them all blocks, short ones included, of the
content nodes: the article (or main) elements, and where there are none the deepest
element that holds most of the content with the prose and title around it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

ship(__name__)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe select annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr canvas object"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose merror mmultiscripts semantics".split()
)
BOILERPLATE = set("nav footer aside button menu dialog".split())
#: Elements that are boilerplate unless they hold the title or the greater part of the text, as some pages lie in one form.
MAYBE_BOILERPLATE = {"form"}
HEADER_SCOPES = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr"
    " notice notification alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar"
    " comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations trending newsletter"
    " subscribe subscription signup login search pagination pager widget toolbar skip copyright legal disclaimer".split()
)
# Names of what is never the text of a page, however long it is, and words that stand beside these.
NEVER = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist reply replies respond disqus"
    " related recommended recommendations trending".split()
)
BESIDE_NEVER = set("user users reader readers visitor visitors guest thread threads stream feed posts stories articles news more also slot slots unit zone space count form title heading row col column".split())
ADVERT = re.compile(r"(ads?|adv|advert)(box|slot|unit|banner|block|container|wrapper|wrap|space|area|zone)s?")
# Words that stand beside a name without changing what it means; a header of one of TEXTS is part of the text.
PLACES = set("site global main page left right top bottom primary secondary inner area bar box block list container wrapper wrap section item link links".split())
TEXTS = set("post entry article page main section content".split())
MARKS = {"h1", "main", "article"}
HEADERS = set("header masthead banner".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»\"“”]")
SPACES = re.compile(r"\s+")
FLOW = set("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: A path is content from this share of the largest fused ratio on; a content node holds this share of the content text.
SHARE = 0.25
HOLD = 0.6
NAMED_HOLD = 0.4
#: A main element is the text's place from this share on, whatever articles are outside it.
MAIN_HOLD = 0.1


def _hidden(attributes: str) -> bool:
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _strength(whole: str) -> int:
    """What one class or id says: 2 names what is never text, with words that may stand beside that (``user-comments``); 1 names
    boilerplate, or names and places only (``site-footer``); 0 nothing."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", whole).lower()) if w]
    if any(w in NEVER or ADVERT.fullmatch(w) for w in words) and all(w in NAMES or w in PLACES or w in TEXTS or w in BESIDE_NEVER or ADVERT.fullmatch(w) for w in words):
        return 2
    while len(words) > 1 and words[-1] in PLACES and words[-1] != "page":
        words.pop()
    if not words or words[-1] not in NAMES or not all(w in NAMES or w in PLACES or w in TEXTS for w in words):
        return 0
    return int(not (words[-1] in HEADERS and TEXTS.intersection(words)))


def _named_boilerplate(name: str, attributes: str) -> int:
    """The strongest of an element's classes and ids; an article is boilerplate only by what is never text, page and main never."""
    if not attributes or name in ("html", "body", "main"):
        return 0
    found = max((_strength(w) for key, value in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for w in value.strip("\"'").split()), default=0)
    return 0 if name == "article" and found < 2 else found


class Element:
    """One element of a page: its parent's number, name, path (numbered), whether its text is boilerplate for certain,
    for how many levels yet it counts as a link's, whether it lies in a HEADER_SCOPES element, and the block element around it."""

    __slots__ = ("parent", "name", "path", "bad", "link", "scoped", "host")

    def __init__(self, parent: int, name: str, path: int, bad: bool, link: int, scoped: bool, host: int) -> None:
        self.parent, self.name, self.path, self.bad, self.link, self.scoped, self.host = parent, name, path, bad, link, scoped, host


def _without_named(blocks: list[dict], elements: list[Element], named: set[int], never: set[int]) -> list[dict]:
    """The blocks outside the elements that are boilerplate by name.

    A name doesn't count where its element holds a top heading or main element, nor where
    it holds an article, or no less text than there is outside all named elements, unless
    enough text with such a mark is outside them.  The elements ``never``, comments, adverts and
    the like, stay out however much they hold, save that of the page's only title or main element.
    """
    if not named:
        return blocks
    n = len(elements)
    near, marked = [-1] * n, [False] * n  # the innermost named element around each, itself included; a mark around it
    for i, e in enumerate(elements):  # parents come before their children
        up = e.parent
        near[i] = i if i in named else near[up] if up >= 0 else -1
        marked[i] = e.name in MARKS or up >= 0 and marked[up]
    size, marks, own, own_marked = [0] * n, [frozenset()] * n, [0] * n, [False] * n
    held = [False] * n
    text, has_mark = 0, False
    for b in blocks:
        plain, i = max(0, len(b["text"]) - b["links"]), b["element"]
        size[i] += plain
        held[i] = True
        if near[i] < 0:
            text += plain
            has_mark = has_mark or marked[i]
        else:
            own[near[i]] += plain
            own_marked[near[i]] = own_marked[near[i]] or marked[i]
    for i in range(n - 1, -1, -1):
        if held[i]:
            if elements[i].name in MARKS:
                marks[i] |= {elements[i].name}
            up = elements[i].parent
            if up >= 0:
                size[up] += size[i]
                held[up] = True
                if marks[i]:
                    marks[up] |= marks[i]
    named = set(named)
    around = {x: near[elements[x].parent] if elements[x].parent >= 0 else -1 for x in named}
    for x in sorted((x for x in named if held[x]), key=lambda x: (-size[x], x)):  # outer elements before those in them
        while around[x] >= 0 and around[x] not in named:
            around[x] = around[around[x]]
        if around[x] >= 0:
            continue
        elsewhere = has_mark and text >= SHARE * size[x]
        top = bool(marks[x] & {"h1", "main"})
        if (top and not has_mark) if x in never else top or ("article" in marks[x] or size[x] >= text) and not elsewhere:
            named.discard(x)
            text += own[x]
            has_mark = has_mark or own_marked[x]
    within = _inside(elements, named)
    return [b for b in blocks if not within[b["element"]]]


def _inside(elements: list[Element], nodes: set[int]) -> list[bool]:
    """For every element whether it is one of ``nodes`` or in one."""
    out: list[bool] = []
    for i, e in enumerate(elements):
        out.append(i in nodes or e.parent >= 0 and out[e.parent])
    return out


def _blocks(page: str, names: bool = True) -> tuple[list[dict], list[Element]]:
    """Blocks of text in page order, and the elements; ``names`` says whether names of inline elements count.

    Takes time linear in the page, however deep its elements lie: what depends on the
    elements around is kept with each.
    """
    elements = [Element(-1, "", 0, False, 0, False, 0)]
    paths: dict[tuple[int, str], int] = {}
    named: set[int] = set()
    never: set[int] = set()
    stack: list[int] = [0]
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    blocks: list[dict] = []
    now: dict | None = None
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal now
        top = elements[stack[-1]]
        if top.bad or not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = {"parts": [], "path": elements[top.host].path, "element": top.host, "links": 0}
            blocks.append(now)
        now["parts"].append(raw)
        if top.link:
            now["links"] += len(raw)

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[elements[x].name] -= 1
        del stack[i:]

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            text(" ")
            continue
        inline = name in INLINE
        if not inline:
            now = None
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                around = elements[stack[i]].name
                if around == name:
                    close(i)
                    break
                if inline and around not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            found = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if found is None:
                unclosed.add(name)  # nor is there one further on
            if not attributes.rstrip().endswith("/"):
                at = found.end() if found else end if name in ("script", "style") else at
                if found or name in ("script", "style"):
                    continue
        if not inline:
            for i in range(len(stack) - 1, 0, -1):
                around = elements[stack[i]].name
                if around == "p" or around in CLOSES.get(name, ()):
                    close(i)
                    break
                if around not in INLINE:
                    break
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        up = elements[stack[-1]]
        bad = up.bad or name in BOILERPLATE or name not in ("html", "body", "article", "main") and _hidden(attributes)
        if names and inline and _named_boilerplate(name, attributes):
            bad = True
        if name == "header" and not up.scoped:
            bad = True
        number = len(elements)
        path = up.path if inline else paths.setdefault((up.path, name), len(paths) + 1)
        elements.append(Element(stack[-1], name, path, bad, 4 if name == "a" else max(0, up.link - 1), up.scoped or name in HEADER_SCOPES, up.host if inline else number))
        if not inline and not bad:
            strength = max(_named_boilerplate(name, attributes), int(name in MAYBE_BOILERPLATE))
            if strength:
                named.add(number)
            if strength == 2:
                never.add(number)
        stack.append(number)
        opened[name] = opened.get(name, 0) + 1
    for b in blocks:
        b["text"] = SPACES.sub(" ", html.unescape("".join(b["parts"]))).strip()
    return _without_named([b for b in blocks if b["text"]], elements, named, never), elements


def path_ratios(blocks: list[dict]) -> dict[int, float]:
    """Text length and punctuation a block on each tag path, smoothed over neighbouring paths and multiplied, times the share of its text that isn't links'."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b["path"], [0, 0, 0, 0])
        plain = max(0, len(b["text"]) - b["links"])
        s[0] += plain
        s[1] += len(PUNCTUATION.findall(b["text"])) if plain else 0
        s[2] += 1
        s[3] += len(b["text"])
    ratios = [(t / n, p / n) for t, p, n, _ in sums.values()]

    def smooth(k: int, i: int) -> float:
        around = [(ratios[j][k], w) for j, w in ((i - 1, 0.25), (i, 1.0), (i + 1, 0.25)) if 0 <= j < len(ratios)]
        return sum(x * w for x, w in around) / sum(w for _, w in around)

    return {path: smooth(0, i) * (1 + smooth(1, i)) * s[0] / s[3] for i, (path, s) in enumerate(sums.items())}


def content_blocks(blocks: list[dict]) -> list[dict]:
    """The blocks on paths whose fused ratio is SHARE of the largest at least."""
    fused = path_ratios(blocks)
    least = SHARE * max(fused.values())
    return [b for b in blocks if fused[b["path"]] >= least] or blocks


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text of one page."""
    blocks, elements = _blocks(page)
    if not blocks:
        blocks, elements = _blocks(page, names=False)
    if not blocks:
        return []
    chosen = content_blocks(blocks)
    picked = {id(b) for b in chosen}
    mains, nodes = _named_nodes(chosen, elements)
    if mains:
        within = _inside(elements, mains)
        picked = {id(b) for b in chosen if within[b["element"]]}
    elif not nodes:
        nodes, loose = _grown_nodes(blocks, chosen, elements)
        picked |= loose
    within = _inside(elements, nodes)
    places = [i for i, b in enumerate(blocks) if id(b) in picked or within[b["element"]]]
    return [blocks[i]["text"] for i in [*_title(blocks, elements, places), *places]]


def _title(blocks: list[dict], elements: list[Element], places: list[int]) -> list[int]:
    """The last top heading before a text that has none and doesn't begin with a heading of its own."""
    heads = [elements[b["element"]].name for b in blocks]
    if not places or "h1" in (heads[i] for i in places) or heads[places[0]] == "h2":
        return []
    return [i for i in range(places[0]) if heads[i] == "h1"][-1:]


def _held(blocks: list[dict], elements: list[Element]) -> list[int]:
    """The length of the blocks' texts in each element."""
    held = [0] * len(elements)
    for b in blocks:
        held[b["element"]] += len(b["text"])
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    return held


def _named_nodes(chosen: list[dict], elements: list[Element]) -> tuple[set[int], set[int]]:
    """The main elements with content, if they hold some of it, and all outermost articles in them (else on the page) if these hold enough of it;
    the main elements themselves where there are no such articles."""
    held = _held(chosen, elements)

    def outermost(name: str, inside: list[bool] | None = None) -> set[int]:
        all_ = {i for i, e in enumerate(elements) if e.name == name and held[i] and (inside is None or inside[i])}
        within = _inside(elements, all_)
        return {i for i in all_ if not within[elements[i].parent]}

    mains = outermost("main")
    if sum(held[e] for e in mains) < MAIN_HOLD * held[0]:
        mains = set()
    of = sum(held[e] for e in mains) if mains else held[0]
    articles = outermost("article", _inside(elements, mains) if mains else None)
    if sum(held[e] for e in articles) < NAMED_HOLD * of:
        articles = set()
    return mains, articles or mains


def _grown_nodes(blocks: list[dict], chosen: list[dict], elements: list[Element]) -> tuple[set[int], set[int]]:
    """The deepest element with most of the content and the elements around it that belong to it; blocks of bare text between them.

    A level above is part of the text, all but its parts of links, where it has content
    blocks or prose that stands in it as paragraphs, lists and the like do; of other
    levels the first top heading is.
    """
    held = _held(chosen, elements)
    core = max(i for i, size in enumerate(held) if size >= HOLD * held[0])
    nodes, loose = {core}, set()
    picked = {id(b) for b in chosen}
    spine, e = [], core
    while e >= 0:
        spine.append(e)
        e = elements[e].parent
    levels = set(spine)
    # For every element the level it hangs on and the part of that level, itself or an element around it.
    hangs: list[tuple[int, int]] = []
    for i, x in enumerate(elements):
        hangs.append((i, i) if i in levels else (x.parent, i) if x.parent in levels else hangs[x.parent])
    titled = any(x.name == "h1" and hangs[i][0] == core for i, x in enumerate(elements))
    parts: dict[int, dict[int, list[dict]]] = {}
    for b in blocks:
        level, part = hangs[b["element"]]
        parts.setdefault(level, {}).setdefault(part, []).append(b)
    for level in spine[1:]:
        here = parts.get(level, {})
        prose = {
            e: any(PUNCTUATION.search(b["text"]) for b in part) and 2 * sum(b["links"] for b in part) < sum(len(b["text"]) for b in part)
            for e, part in here.items()
        }
        titles = set() if titled else {e for e, part in here.items() if any(elements[b["element"]].name == "h1" for b in part)}
        titled = titled or bool(titles)
        whole = any(prose[e] and (e == level or elements[e].name in FLOW) or any(id(b) in picked for b in part) for e, part in here.items())
        for e, part in here.items():
            if e in titles or whole and 2 * sum(b["links"] for b in part) < sum(len(b["text"]) for b in part):
                if e == level:
                    loose.update(id(b) for b in part)
                else:
                    nodes.add(e)
    return nodes, loose


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row: blocks of the main text joined by an empty line.

    NULL and empty pages and pages without text give the empty text; broken markup is
    read as far as it goes; repeated rows stay.  Each page is read whole, by itself.
    """
    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                texts = ["\n\n".join(main_blocks(p)) if p else "" for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [key, url, "text", "n_chars"],
                )

    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(key, url, source).mapInArrow(run, schema)
