"""A small HTML reader: blocks of text with their place in the element tree.

It takes time and memory in proportion to the page: places are 64-bit keys rather than
paths, every open element is looked up by its tag, and a scan that ran to the end of the
page in vain is not repeated.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import xxhash

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, up to their own end tag.
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements closed by the start of one of these, if open and nothing between them forbids it.
CLOSED_BY_BLOCK = frozenset({"p"})
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select".split())
#: Elements and names (of class, id or role) that seldom hold the main text: a prior, which the site's tree confirms.
NOISE_TAGS = frozenset("head nav header footer aside form button select menu dialog svg object canvas audio video map search".split()) | RAW
NOISE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply widget toolbar pagination pager copyright legal disclaimer search skip contentinfo complementary".split()
)

TAG = r"<(/?)([a-zA-Z][^\s/>]*+)"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|{TAG}((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
#: The same for a page in which quotes do not pair: a tag ends at the next >.
LENIENT = re.compile(rf"<!--.*?(?:-->|\Z)|{TAG}([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S)
A_TAG = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[^\W\d_]+")
#: Elements that are never noise by their class, id or role.
NEVER = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
#: Where a block stands: its page marks no main element, inside one, outside the one that the page marks.
UNMARKED, INSIDE, OUTSIDE = 0, 1, 2


def key(above: int, name: str) -> int:
    """64-bit key of a child of ``above``; signed, as Spark's long is."""
    return xxhash.xxh3_64_intdigest(f"{above}\0{name}") - (1 << 63)


@dataclass(slots=True)
class Block:
    text: str
    node: int  # place of its block element, with presentation and ``state``
    parent: int
    named: int  # place of the outermost element around it that is noise by name; 0: none
    state: int


@dataclass(slots=True)
class Open:
    tag: str
    place: int
    named: int
    main: bool
    inline: bool
    block: int  # position of the innermost open element that is not inline, itself included


def noise_name(token: str) -> bool:
    """Whether a class, id or role is made of listed words only; digits do not count."""
    words = NAMES.findall(token)
    return bool(words) and NOISE_NAMES.issuperset(words)


def presentation(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Name of the element in the style tree, whether it is noise by name, whether it is a main element."""
    noise, main = tag in NOISE_TAGS, tag in ("main", "article")
    if not attributes.strip():
        return tag, noise, main
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    noise = noise or (tag not in NEVER and any(map(noise_name, named.split()))) or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    main = main or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    style = re.sub(r"\d+", "0", f"{found.get('class', '')}#{found.get('id', '')}")
    return (f"{tag}.{style}" if style != "#" else tag) + "!" * noise + "*" * main, noise, main


def read_blocks(page: str, host: str = "") -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a page in order, and (place, style of its children) of every inner element."""
    stack = [Open("", key(0, host), 0, False, False, 0)]
    open_at: dict[str, list[int]] = {}  # positions of open elements by tag
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    parents: dict[int, int] = {stack[0].place: 0}
    held: list[str] = []
    token, at, length, last_end = TOKEN, 0, len(page), page.rfind(">")

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                s = stack[stack[-1].block]
                blocks.append(Block(text, s.place, parents[s.place], s.named, int(s.main)))

    def close(place: int) -> None:
        for s in stack[place:]:
            open_at[s.tag].pop()
        del stack[place:]

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < length:
        if at > last_end:  # no markup ends any more; an unclosed comment hides the rest
            if not stack[-1].inline:
                held.append(page[at:].partition("<!--")[0])
            break
        m = token.match(page, at)
        if token is TOKEN and m[0] == "<" and A_TAG.match(page, at):
            token = LENIENT  # quotes do not pair up to the end of the page
            continue
        at = m.end()
        if not m[2]:
            if not stack[-1].inline and (page[m.start()] != "<" or m.end() - m.start() == 1):
                held.append(m[0])
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if place := last((tag,)):
                if not all(s.inline for s in stack[place:]):
                    flush()
                close(place)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                held.append(" ")
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            end_tag = end and token.match(page, end.start())
            at = end_tag.end() if end_tag and end_tag[2] else length
            continue
        name, noise, main = presentation(tag, attributes)
        inline = tag not in BLOCK and not main
        if inline and not noise:
            continue
        if inline:
            held.append(" ")  # its text is left out of the block around it
        else:
            flush()
        if tag in BLOCK:
            same = SIBLINGS.get(tag, ())
            if same and (place := last(same)) > last(SCOPES):
                close(min(p for t in same if open_at.get(t) for p in open_at[t][-1:] if p > last(SCOPES)))
            elif stack[-1].tag in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
        above = stack[-1]
        children.setdefault(above.place, []).append(name)
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            place = key(above.place, name)
            parents[place] = above.place
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(Open(tag, place, above.named or (place if noise else 0), above.main or main, inline, above.block if inline else len(stack)))
    flush()
    marked = any(b.state and not b.named for b in blocks)
    for b in blocks:
        b.state = (INSIDE if b.state else OUTSIDE) if marked else UNMARKED
        b.node = key(b.node, str(b.state))
    styles = [(p, key(p, "\0".join(n for i, n in enumerate(names) if not i or names[i - 1] != n))) for p, names in children.items()]  # repeated siblings are one
    return blocks, styles
