"""HTML to leaf blocks with their features: one linear pass, tolerant of broken markup.

A leaf block is a run of text between the starts and ends of block elements; inline
elements do not end it. Comments, scripts, styles and other invisible content give none;
nor do elements that are marked as hidden, inline ones too.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements that stay inside a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content, and those whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video select textarea title head".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: What may stand in a head; anything else ends one that is not closed.
HEAD_PARTS = frozenset("title base link meta style script noscript template".split())
#: A start of the first ends an open element of the second, as HTML has it.
CLOSES = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: Elements that an unclosed one of CLOSES is not looked for beyond.
SCOPES = frozenset("ul ol dl table body article section div main aside nav header footer form blockquote".split())

_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:-][A-Za-z0-9_:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Attributes whose words describe an element.
NAMED = ("class", "id", "role", "itemprop", "aria-label")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Marks of an open element, beside its features: what it holds is hidden; it is inline.
_HIDES, _INSIDE = "!", "~"


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]


class _Page:
    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, tuple[str, ...]]] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.hidden = 0
        self.text: list[str] = []
        self.linked = 0
        self.link = False

    def push(self, tag: str, features: tuple[str, ...], hides: bool) -> None:
        self.stack.append((tag, (*features, _HIDES) if hides else features))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += hides
        for f in features:
            if f != _INSIDE:
                self.marks[f] = self.marks.get(f, 0) + 1

    def pop(self) -> None:
        tag, features = self.stack.pop()
        self.open[tag] -= 1
        for f in features:
            if f == _HIDES:
                self.hidden -= 1
            elif f == _INSIDE:
                continue
            elif self.marks[f] > 1:
                self.marks[f] -= 1
            else:
                del self.marks[f]

    def leave_head(self) -> None:
        """Ends an open head, as text or an element that cannot stand there does."""
        while self.open.get("head"):
            self.pop()

    def say(self, raw: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and raw.strip():
            self.leave_head()
        if self.hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.link:
            self.linked += len(text)

    def end_block(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                own = self.stack[-1][0] if self.stack else ""
                self.blocks.append((words, self.linked, (f"tag={own}", *self.marks)))
            self.text, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag not in HEAD_PARTS and tag != "head" and self.open.get("head"):
            self.leave_head()
        if tag in INLINE and not (tag == "ins" and "class" in attributes):  # adverts come in such
            if tag == "a":
                self.link = True
            hides = self.unseen(attributes) if "hidden" in attributes or "style" in attributes else False
            if tag not in VOID and (hides or self.open.get(tag)):  # within a hidden one, others are counted, to know its end
                self.push(tag, (_INSIDE,), hides)
            return
        self.end_block()
        if tag in VOID:
            return
        if self.stack and self.stack[-1][0] == "p":
            self.pop()
        ended = CLOSES.get(tag)
        if ended and any(self.open.get(t) for t in ended):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] in SCOPES:
                    break
                if self.stack[depth][0] in ended:
                    while len(self.stack) > depth:
                        self.pop()
                    break
        names = [f"in={tag}"]
        if "=" in attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                if name.lower() in NAMED:
                    names += [f"name={p.lower()}" for p in _NAME_PART.findall(value)]
        self.link = False
        self.push(tag, tuple(dict.fromkeys(names)), tag in HIDDEN or self.unseen(attributes))

    @staticmethod
    def unseen(attributes: str) -> bool:
        """Whether attributes say that an element is not shown."""
        if "hidden" not in attributes.lower() and "style" not in attributes.lower():
            return False
        found = [(name.lower(), value) for name, value in _ATTRIBUTE.findall(attributes)]
        return any(name == "hidden" or name == "style" and _UNSEEN.search(value) for name, value in found)

    def end(self, tag: str) -> None:
        if tag in INLINE and not self.open.get(tag):
            if tag == "a":
                self.link = False
            return
        inside = False
        if self.open.get(tag):
            inside = next(features for t, features in reversed(self.stack) if t == tag)[:1] == (_INSIDE,)
        if not inside:
            self.end_block()
        elif tag == "a":
            self.link = False
        if tag not in VOID and self.open.get(tag):
            while True:
                last = self.stack[-1][0]
                self.pop()
                if last == tag:
                    break


def _raw_end(page: str, lower: str, tag: str, at: int) -> tuple[int, int]:
    """Where the content of a raw element ends, and where the page goes on."""
    end = lower.find(f"</{tag}", at)
    if end < 0:
        return len(page), len(page)
    stop = page.find(">", end)
    return end, len(page) if stop < 0 else stop + 1


def leaves(page: str) -> list[tuple[str, int, tuple[str, ...]]]:
    """Text, characters in links, and structural features of each leaf block in order."""
    state, at, lower = _Page(), 0, page.lower()
    if len(lower) != len(page):  # some capitals have longer small forms
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    while True:
        here = page.find("<", at)
        if here < 0:
            state.say(page[at:])
            break
        state.say(page[at:here])
        if page.startswith("<!--", here):
            m = _COMMENT_END.search(page, here + 4)
            at = m.end() if m else len(page)
        elif page.startswith(("<!", "<?"), here):
            stop = page.find(">", here)
            at = len(page) if stop < 0 else stop + 1
        elif m := _TAG.match(page, here + 1):
            at, tag = m.end(), m[2].lower()
            if m[1]:
                state.end(tag)
            else:
                state.start(tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    end, at = _raw_end(page, lower, tag, at)
                    state.say(page[m.end() : end])
                    state.end(tag)
        else:
            state.say("<")
            at = here + 1
    state.end_block()
    return state.blocks


#: Words that mark a block by what it says.
SAID = ("cookie", "copyright", "©", "rights reserved", "subscribe", "newsletter", "sign in", "log in", "privacy", "advert", "sponsored", "share this", "comments", "reply", "related", "©")
_SIZES = (3, 6, 12, 25, 50, 100)


def _bucket(n: int) -> int:
    return sum(n > s for s in _SIZES)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with all their features."""
    found = leaves(page)
    out = []
    for i, (text, linked, marks) in enumerate(found):
        words = text.count(" ") + 1
        share = linked / len(text)
        low = text.lower()
        features = [*marks, f"words={_bucket(words)}", f"linked={'all' if share > 0.9 else 'some' if share > 0.3 else 'none'}"]
        if text[-1] in ".!?…\"”":
            features.append("ends")
        features += [f"said={w}" for w in SAID if w in low]
        if i == 0:
            features.append("first")
        if i == len(found) - 1:
            features.append("last")
        out.append(Block(text, tuple(dict.fromkeys(features))))
    return out
