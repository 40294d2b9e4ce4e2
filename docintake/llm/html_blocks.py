"""A page's text blocks with their places in its element tree."""

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import xxhash

#: Comments, declarations and tags; a quoted value may hold a > but no <.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/><]*)((?:"[^"<]*"|'[^'<]*'|[^>"'<])*+)>|<(/?)([a-zA-Z][^\s/><]*)([^><]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
LETTERS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes these, up to the element that bounds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
ASIDE = frozenset("head nav footer aside form button select option menu dialog search input label fieldset canvas audio video object".split())
#: Of these, what may wrap a whole page; elements that say that it does.
WRAPPERS = frozenset("form fieldset".split())
LAYOUT = frozenset("nav header footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Classes and ids that name such a branch.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe subscription signup login paywall social share sharing sidebar"
    " menu nav navbar navigation breadcrumb breadcrumbs footer comments comment disqus replies reply respond related"
    " recommended recommendations widget toolbar pagination pager".split()
)
#: Words beside a name in a class or id of several words; these alone name nothing.
FRAME = frozenset("area bar block bottom box form global header holder item items links list mobile section site slot strip thread title top unit".split())
#: Words that a layout which merely has such a branch may be called by as well.
PLACES = frozenset("container inner left main outer page primary right secondary wrap wrapper".split())
#: Of these, what a box of the article's own text may be called as well.
WARNINGS = frozenset("notice notices".split())
REMARKS = frozenset("ad ads advert comment comments promo related reply replies respond sponsored".split())
#: Names of reader comments, which ids in an article may be as well.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: In the header of an article: who wrote it and when.
CREDITS = frozenset("author byline credit credits date dateline meta posted published".split())
BYLINE = re.compile(r"by(?:\s+\S+){1,5}", re.I)
PAGE = frozenset("html body main article".split())
LINES = HEADINGS | {"p"}

#: Why a branch is left out, and what text comes back: none, that of named branches on a page without other text, or all.
KEPT, NAMED, DROPPED = 0, 1, 2


@dataclass
class Block:
    """A stretch of text between two block boundaries."""

    path: int
    parent: int
    text: str
    main: bool  # inside an article or the main element
    prose: bool  # a paragraph or heading


@dataclass(eq=False)
class Gate:
    """A branch that is left out, unless something in it lifts it."""

    up: "Gate | None"
    why: int = DROPPED  # or NAMED
    weak: bool = False  # a name that counts only beside an article or main element
    by_article: bool = False  # an article in it lifts it
    by_main: bool = True
    wraps: bool = False  # page layout in it lifts it
    lifted: bool = False
    inline: "Gate | None" = None  # counts only if this inline branch is closed by its own tag
    closed: bool = False
    verdict: int = KEPT


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    named: list[Block] = field(default_factory=list)  # what the names of branches leave out
    children: dict[int, list[str]] = field(default_factory=dict)  # path -> tags of the children, in page order


@dataclass
class Element:
    tag: str
    path: int
    block: int  # place in the stack of the innermost block element
    gate: Gate | None  # the innermost one
    article: bool
    main: bool
    title: bool  # in the header of an article or main element
    heading: bool


def names_of(text: str) -> tuple[str, dict[str, str]]:
    """The signature that the words of class and id give an element, and the attributes."""
    if not text or text.isspace():
        return "", {}
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    return ".".join(LETTERS.findall(named)), found


def names_in(name: str, names: frozenset[str]) -> tuple[set[str], bool]:
    """Which names a class or id consists of, and whether it may be a layout's; none if it holds other words."""
    words = set(LETTERS.findall(name))
    if not words <= names | FRAME | PLACES:
        return set(), False
    return words & names, not words.isdisjoint(PLACES)


def named_gate(tag: str, found: dict[str, str], up: Element, core: bool, article: bool) -> Gate | None:
    """The branch that an element opens by its name.

    Classes and ids count if they are names, or names beside words of
    ``FRAME``; of lines only whole classes, and in an article ids only as the
    names of reader comments.
    """
    classes = found.get("class", "").lower().split()
    own = found.get("id", "").lower().strip()
    core = core or tag in PAGE
    whole, weak = set(classes), False
    if core:
        names = whole & REMARKS if article else set()
    elif tag in LINES:
        names = set() if up.article else whole & NAMES
    else:
        known = NAMES - WARNINGS if up.article else NAMES
        found_in = [names_in(c, known) for c in classes] + [names_in(own, COMMENTS if up.article else NAMES)]
        sure = [x for x, place in found_in if not place or up.article]
        names = set().union(*sure)
        weak = not names and any(x for x, _ in found_in)
        weak = weak or (not names and not up.main and not NAMES.isdisjoint(LETTERS.findall(own)))
    if up.title and not names and not core:
        names = {c for c in classes if c in CREDITS}
    if not names and not weak:
        return None
    return Gate(up.gate, NAMED, weak=weak, by_article=not names & REMARKS)


class Parser:
    """Reads pages; the hashes of paths are kept from page to page."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}

    def path(self, parent: int, name: str) -> int:
        found = self.paths.get((parent, name))
        if found is None:
            if len(self.paths) > 200_000:
                self.paths = {}
            found = self.paths[parent, name] = xxhash.xxh64_intdigest(f"{parent}/{name}") >> 1
        return found

    def read(self, text: str) -> Page:
        return Reading(self.path).page(text)


class Reading:
    """One page on its way: the stack of open elements, where each tag is open, and the text runs of the block at hand.

    Each step looks only at what it ends, so time grows with the markup and
    not with its depth.
    """

    def __init__(self, path):
        self.path = path
        self.out = Page()
        self.stack = [Element("", 0, 0, None, False, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.gates: list[Gate] = []
        self.held: list[tuple[str, Gate | None]] = []
        self.placed: list[tuple[Element, int, list[tuple[str, Gate | None]]]] = []

    def page(self, text: str) -> Page:
        held, stack = self.held, self.stack
        low = None
        at = 0
        while True:
            found = MARKUP.search(text, at)
            if found is None:
                held.append((text[at:], stack[-1].gate))
                break
            if found.start() > at:
                held.append((text[at : found.start()], stack[-1].gate))
            at = found.end()
            if found[0].startswith("<![CDATA["):
                held.append((html.escape(found[0][9:].removesuffix("]]>")), stack[-1].gate))
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self.end(tag)
                continue
            if tag == "br":
                held.append((" ", stack[-1].gate))
                continue
            if tag in RAW:
                if low is None:
                    low = text.lower()
                    if len(low) != len(text):  # a letter that changes its length
                        low = text
                end = low.find(f"</{tag}", at)
                if end < 0 and low is text:
                    end = next((m.start() for m in re.finditer(rf"</{tag}", text[at:], re.I)), -1 - at) + at
                at = len(text) if end < 0 else end
                continue
            if tag in BLOCK:
                self.flush()
                self.implied(tag)
            element = self.opened(tag, found[3] or found[6] or "")
            if tag in BLOCK:
                self.out.children.setdefault(stack[-1].path, []).append(tag)
            if tag not in VOID and not (found[0].endswith("/>") and tag not in BLOCK):
                self.places.setdefault(tag, []).append(len(stack))
                stack.append(element)
        self.flush()
        self.judge()
        return self.out

    def opened(self, tag: str, attributes: str) -> Element:
        up = self.stack[-1]
        signature, found = names_of(attributes)
        role = found.get("role", "").lower()
        path = self.path(up.path, f"{tag}.{signature}" if signature else tag)
        article = tag == "article" or role == "article"
        core = article or tag == "main" or role == "main"
        block = tag in BLOCK
        gate = self.gate(tag, role, found, up, core, article)
        if tag in LAYOUT or (core and gate is None):
            self.lift(up.gate, article, core)
        if gate is not None:
            self.gates.append(gate)
        else:
            gate = up.gate
            if block and gate is not None and gate.closed is False and gate.inline is gate:
                gate = Gate(gate.up, by_main=False, inline=gate)
                self.gates.append(gate)
        title = up.title or (tag == "header" and up.main)
        at = len(self.stack) if block else up.block
        return Element(tag, path, at, gate, up.article or article, up.main or core, title, up.heading or tag in HEADINGS)

    @staticmethod
    def gate(tag: str, role: str, found: dict[str, str], up: Element, core: bool, article: bool) -> Gate | None:
        """The branch that an element opens, if it is one that is left out."""
        gate = None
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        credit = up.title and tag in ("time", "address")
        if hidden or credit or tag in ASIDE or role in ROLES or (tag == "header" and not up.main):
            wraps = not hidden and (tag in WRAPPERS or role == "form")
            gate = Gate(up.gate, by_article=wraps, by_main=not hidden, wraps=wraps)
        elif found:
            gate = named_gate(tag, found, up, core, article)
        if gate is not None and gate.why == DROPPED and tag not in BLOCK:
            gate.inline = gate
        return gate

    @staticmethod
    def lift(gate: Gate | None, article: bool, core: bool) -> None:
        """What an article, a main element or page layout lifts: the branches around it, up to one that it doesn't."""
        while gate and not gate.lifted:
            if not (gate.wraps if not core else gate.by_article if article else gate.by_main):
                break
            gate.lifted = True
            gate = gate.up

    def flush(self) -> None:
        """End the block at hand."""
        if self.held:
            runs, self.held[:] = [r for r in self.held if r[0]], []
            if any(not t.isspace() for t, _ in runs):
                inner = self.stack[-1]
                self.placed.append((inner, *self.place(inner), runs))

    def place(self, inner: Element) -> tuple[Element, int]:
        """The block element around, and its parent's path."""
        return self.stack[inner.block], self.stack[max(0, inner.block - 1)].path

    def judge(self) -> None:
        """Sort the text into what stays and what only names leave out."""
        self.settle(weak=True)
        if not any(e.main and (g is None or g.verdict == KEPT) for e, _, _, runs in self.placed for _, g in runs):
            self.settle(weak=False)
        for inner, top, parent, runs in self.placed:
            for why, blocks in ((KEPT, self.out.blocks), (NAMED, self.out.named)):
                own = [html.unescape(t) for t, g in runs if (KEPT if g is None else g.verdict) == why]
                words = " ".join("".join(own).split())
                credit = inner.title and not inner.heading and BYLINE.fullmatch(words)
                if words and not credit:
                    blocks.append(Block(top.path, parent, words, top.main, top.tag in LINES))

    def settle(self, weak: bool) -> None:
        for gate in self.gates:
            counts = not gate.lifted and (weak or not gate.weak)
            if gate.inline is not None and gate.inline is not gate:
                counts = gate.inline.closed
            above = gate.up.verdict if gate.up else KEPT
            gate.verdict = max(above, gate.why) if counts else above

    def close(self, keep: int) -> None:
        self.flush()
        self.cut(keep)

    def cut(self, keep: int) -> None:
        for element in self.stack[keep:]:
            self.places[element.tag].pop()
        del self.stack[keep:]

    def last(self, tags) -> int:
        """The highest place at which one of the tags is open; 0 if none is."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def implied(self, tag: str) -> None:
        """Close what the opening of a block element ends."""
        if tag in CLOSES:
            ended, bounds = CLOSES[tag]
            bound = self.last(bounds)
            first = [open_[n] for t in ended if (open_ := self.places.get(t)) and (n := bisect_right(open_, bound)) < len(open_)]
            if first:
                self.close(min(first))
        elif self.stack[self.stack[-1].block].tag == "p":
            self.close(self.stack[-1].block)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if not at:
            return
        element = self.stack[at]
        if tag in BLOCK:
            self.close(at)
            return
        if self.last(("table", "body")) > at:
            return
        if self.stack[-1].block > at:
            if tag not in ("button", "object"):
                return
            self.flush()
        if element.gate is not None and element.gate is not self.stack[at - 1].gate:
            element.gate.closed = True
        self.cut(at)
