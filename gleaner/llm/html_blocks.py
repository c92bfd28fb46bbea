"""HTML pages as sequences of leaf blocks: text with its tag path, and the vectors a labeller reads."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

from gleaner.llm.words import hashed_words

#: Hashed tokens of the tag path, hashed words, and plain numbers of a block's vector.
N_PATH, N_WORDS, N_NUMBERS = 128, 32, 6
N_INPUTS = N_PATH + N_WORDS + N_NUMBERS

#: Elements that break the text; all others stand inside a line.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never read as markup or shown as text.
UNSHOWN = frozenset("script style template textarea iframe title".split())
#: Elements whose content is markup but not shown. One that its own end tag never closes hides only what comes before the
#: next breaking tag or its parent's end.
HIDDEN = frozenset("noscript svg object canvas video audio annotation annotation-xml".split())
#: Elements in which any tag may close itself.
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that closes an open one of its kind when no end tag did.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: What stops such a search for an open element.
SCOPES = frozenset("ul ol dl table div article section main aside nav form header footer body blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_NOSCRIPT = re.compile(r"<(/?)noscript[^>]*(?:>|\Z)", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class _Hidden:
    """An open element of HIDDEN: its place in the stack, the blocks and text before it, and whether a breaking tag came since."""

    __slots__ = ("depth", "n_out", "pieces", "linked", "broken")

    def __init__(self, depth: int, n_out: int, pieces: list[str], linked: int) -> None:
        self.depth, self.n_out, self.pieces, self.linked, self.broken = depth, n_out, pieces, linked, False


class Node:
    """An open element on the path of a block: its parent and tokens, the slots of all tokens down to it (as bits) and their
    number. Blocks share the nodes of their path, so deep pages cost no more than shallow ones."""

    __slots__ = ("parent", "tokens", "slots", "depth")

    def __init__(self, parent: "Node | None", tokens: list[str]) -> None:
        self.parent, self.tokens = parent, tokens
        self.slots, self.depth = (parent.slots, parent.depth) if parent else (0, 0)
        for t in tokens:
            self.slots |= 1 << _slot(t)
        self.depth += len(tokens)


class Block:
    """Text of a leaf, the innermost element on its path, and how many of its characters are links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int) -> None:
        self.text, self.node, self.linked = text, node, linked

    @property
    def path(self) -> list[str]:
        """The tokens of the path, outermost first."""
        levels, node = [], self.node
        while node is not None:
            levels.append(node.tokens)
            node = node.parent
        return [t for tokens in reversed(levels) for t in tokens]


def path_tokens(tag: str, attributes: str) -> list[str]:
    """The tag's name, and the words of its class, id and role."""
    names = [tag]
    if attributes:
        for found in _NAMES.findall(attributes):
            names += ["." + w for w in _WORD.findall("".join(found).lower())]
    return names


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Character references are decoded, white space runs become one space,
    blocks without text are left out; broken markup never fails."""
    out: list[Block] = []
    if not page:
        return out
    root = Node(None, [])
    stack: list[tuple[str, Node]] = []
    where: dict[str, list[int]] = {}  # places of the open elements of a name in the stack
    scopes: list[int] = []            # places of those that stop a search for an element to close
    pieces: list[str] = []
    hidden: list[_Hidden] = []
    n_broken = 0                      # the first ones of ``hidden`` that are broken
    links, linked, foreign = 0, 0, 0

    def put(said: list[str], linked_: int, depth: int) -> None:
        text = " ".join("".join(said).split())
        if text:
            out.append(Block(text, stack[depth - 1][1] if depth else root, min(linked_, len(text))))

    def flush() -> None:
        nonlocal pieces, linked, n_broken
        if n_broken == len(hidden):
            put(pieces, linked, len(stack))
        else:
            # The text before the outermost is a block, the text in it is not; it is no part of later paths.
            new = hidden[n_broken]
            put(new.pieces, new.linked, new.depth)
            shown = set()
            for h in hidden[n_broken:]:
                h.broken = True
                shown.add(h.depth)
            n_broken = len(hidden)
            for k in range(new.depth, len(stack)):
                stack[k] = (stack[k][0], Node(stack[k - 1][1] if k else root, [] if k in shown else stack[k][1].tokens))
        pieces, linked = [], 0

    def cut(depth: int, own: bool) -> None:
        """Drop the stack from ``depth`` on; ``own`` if the end tag of the element there does it."""
        nonlocal pieces, links, linked, foreign, n_broken
        while hidden and hidden[-1].depth >= depth:
            h = hidden.pop()
            closed = own and h.depth == depth
            if closed:
                del out[h.n_out:]
            if closed or not h.broken:
                pieces, linked = h.pieces, h.linked
        n_broken = min(n_broken, len(hidden))
        for tag_, _ in stack[depth:]:
            links -= tag_ == "a"
            foreign = max(0, foreign - (tag_ in FOREIGN))
            where[tag_].pop()
        while scopes and scopes[-1] >= depth:
            scopes.pop()
        del stack[depth:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BREAKING:
                flush()
            if where.get(tag):
                cut(where[tag][-1], True)
            continue
        attributes = m[3] or m[6] or ""
        if (foreign or tag in FOREIGN) and attributes.endswith("/"):
            continue
        if tag == "noscript":
            close = _NOSCRIPT.search(page, at)
            if close and close[1]:
                at = close.end()
                continue
        if tag in UNSHOWN:
            close = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BREAKING:
            flush()
            foreign = 0
            k = max((where[c][-1] for c in CLOSES.get(tag, ()) if where.get(c)), default=-1)
            if k >= 0 and k >= (scopes[-1] if scopes else 0):
                cut(k, False)
        if tag not in VOID:
            if tag in HIDDEN:
                hidden.append(_Hidden(len(stack), len(out), pieces, linked))
                pieces, linked = [], 0
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPES or tag in HIDDEN:
                scopes.append(len(stack))
            stack.append((tag, Node(stack[-1][1] if stack else root, path_tokens(tag, attributes))))
            links += tag == "a"
            foreign += tag in FOREIGN
    flush()
    return out


_slots: dict[str, int] = {}


def _slot(token: str) -> int:
    if token not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        _slots[token] = zlib.crc32(token.encode()) % N_PATH
    return _slots[token]


def vectors(sequence: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row of N_INPUTS numbers for each block; the blocks are those from ``first`` on of a page of ``total``."""
    n = len(sequence)
    total = n if total is None else total
    slots = np.frombuffer(b"".join(b.node.slots.to_bytes(N_PATH // 8, "little") for b in sequence), dtype=np.uint8)
    path = np.unpackbits(slots.reshape(n, N_PATH // 8), axis=1, bitorder="little")
    words, counts = hashed_words([b.text for b in sequence])
    at = np.repeat(np.arange(n), counts) * N_WORDS + (words >> np.uint64(40)).astype(np.int64) % N_WORDS
    bag = np.bincount(at, minlength=n * N_WORDS).reshape(n, N_WORDS) / np.sqrt(np.maximum(counts, 1))[:, None]
    size = np.array([len(b.text) for b in sequence], dtype=np.float64)
    numbers = np.column_stack([
        np.log1p(size) / 8, np.array([b.linked for b in sequence]) / size, np.log1p(counts) / 6,
        np.array([b.text[-1] in ".!?:;\"'" for b in sequence], dtype=np.float64),
        np.array([b.node.depth for b in sequence]) / 10, (first + np.arange(n)) / max(1, total - 1)])
    return np.hstack([path, bag * 0.3, numbers]).astype(np.float32)
