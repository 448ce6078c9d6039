"""Pages as trees: a tolerant HTML reader that turns a chunk of pages into arrays of nodes.

Nodes are the block elements, inline elements that carry attributes worth reading, and the runs
of text directly inside them.  Plain inline elements (b, i, a, span) belong to the node around
them; what is inside links is counted.  Text runs carry the number of their block: a run of
inline content between the begins and ends of block elements.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np

# HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, and not shown as text of the page.
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")
#: Whole subtrees that a page does not show as text.
UNSHOWN = frozenset("template noscript svg canvas object audio video select datalist".split())
KINDS = ("page", "article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "list", "item", "table", "para", "heading", "figure", "inline", "text")
BLOCKS = {
    "article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside",
    "form": "form", "fieldset": "form", "legend": "form", "search": "form", "option": "form", "section": "section", "hgroup": "section", "details": "section", "summary": "para",
    "div": "div", "center": "div", "address": "div", "body": "page", "ul": "list", "ol": "list", "dl": "list", "dir": "list",
    "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table", "caption": "table",
    "p": "para", "blockquote": "para", "pre": "para", "hr": "para", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "figure": "figure", "figcaption": "figure",
}
#: An element that begins ends an open one of these, up to the nearest of the second group.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ()),
}
#: No element ends outside the cell it is in, but for parts of tables.
CELLS = frozenset(("td", "th", "caption", "table"))
IGNORED = frozenset(("html", "head", "body"))

#: What names and roles say, by group: stems that may be anywhere in a word, and whole words.
LEXICON = {
    "nav": ("nav|menu|breadcrumb|paginat|skip", "toc tabs pager links"),
    "top": ("header|masthead|branding|topbar|banner", "logo top hero"),
    "foot": ("footer|colophon|copyright|contentinfo", "foot legal bottom"),
    "side": ("sidebar|aside|related|recommend|widget|trending|popular|complementary", "side rail more"),
    "ad": ("advert|sponsor|promo|adsense|adslot|adunit|outbrain|taboola", "ad ads adv dfp"),
    "notice": ("cookie|consent|gdpr|notice|notif|popup|modal|overlay|dialog|newsletter|subscri|paywall|disclaim", "alert toast warning signup"),
    "comment": ("comment|disqus|respon|discuss|feedback", "reply replies reviews thread"),
    "form": ("form|search|login|contact", "input field"),
    "share": ("share|social|toolbar|follow", "tools buttons actions"),
    "body": ("article|content|entry|story|prose|headline", "main post body text page title"),
    "hidden": ("", "hidden"),
}
#: What short texts say.
CUES = ("©|copyright|all rights reserved", "cookie|consent|privacy", "advertis|sponsored|anzeige|publicit|publicidad", "comment|kommentar|comentario|repl(?:y|ies)")

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?=[^a-zA-Z])[^>]*(?:>|\Z)
    |(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""",
    re.DOTALL | re.VERBOSE,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|aria-hidden|hidden|style|data-keep)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GROUPS = [(re.compile(stems) if stems else None, frozenset(whole.split())) for stems, whole in LEXICON.values()]
_CUES = [re.compile(c, re.IGNORECASE) for c in CUES]
HIDDEN = 1 << list(LEXICON).index("hidden")


def _said(words: str) -> int:
    """The groups that the words of a name belong to."""
    bits = 0
    for w in _WORDS.findall(words):
        w = w.lower()
        for k, (stem, whole) in enumerate(_GROUPS):
            if w in whole or stem is not None and stem.search(w):
                bits |= 1 << k
    return bits


class Trees:
    """Nodes of a chunk of pages, in page order; parents come before their children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.kind: list[int] = []
        self.bits: list[int] = []
        self.mark: list[int] = []  # label given in the page: 1, 0, or -1 for none
        self.controls: list[int] = []
        self.leaf: list[int] = []  # nodes that are text
        self.text: list[str] = []
        self.linked: list[int] = []  # code points inside links
        self.block: list[int] = []
        self.first: list[int] = [0]  # per page, its first leaf; one more at the end
        self.roots: list[int] = []
        self._names: dict[str, tuple[int, int]] = {}
        self._blocks = 0

    def _node(self, parent: int, kind: str, bits: int = 0, mark: int = -1) -> int:
        self.parent.append(parent)
        self.kind.append(KINDS.index(kind))
        self.bits.append(bits)
        self.mark.append(mark)
        self.controls.append(0)
        return len(self.parent) - 1

    def _attributes(self, name: str, spelled: str) -> tuple[int, int]:
        """(bits, mark) of a tag; pages repeat few of them."""
        key = f"{name} {spelled}"
        if key not in self._names:
            bits, mark = _said(name) if "-" in name else 0, -1
            for what, value in _ATTRIBUTE.findall(spelled):
                what, value = what.lower(), value.strip("\"'")
                if what == "data-keep":
                    mark = int(value == "1")
                elif what == "style":
                    bits |= HIDDEN if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) else 0
                elif what == "hidden" or what == "aria-hidden":
                    bits |= HIDDEN if what == "hidden" or value.lower() == "true" else 0
                else:
                    bits |= _said(value)
            if len(self._names) > 10_000:
                self._names.clear()
            self._names[key] = (bits, mark)
        return self._names[key]

    def add(self, page: str) -> None:
        """Read one page."""
        root = self._node(-1, "page")
        self.roots.append(root)
        stack = [("", root, True)]  # (name, node, block) of the open elements
        at: dict[str, list[int]] = {}  # name: its places on the stack
        walls: list[int] = [0]  # places of blocks
        cells: list[int] = [0]
        parts: list[str] = []
        linked = unshown = 0
        node, links = root, at.setdefault("a", [])
        self._blocks += 1

        def flush() -> None:
            nonlocal linked
            if parts:
                text = entities.unescape("".join(parts))
                parts.clear()
                if text and not (text.isspace() and (not self.leaf or self.block[-1] != self._blocks)):
                    self.leaf.append(self._node(node, "text"))
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                    self.block.append(self._blocks)
            linked = 0

        def close(to: int) -> None:
            """Take what lies at a place of the stack and above it from the stack."""
            nonlocal node
            while len(stack) > to:
                name, _, block = stack.pop()
                at[name].pop()
                if block:
                    walls.pop()
                    if name in CELLS:
                        cells.pop()
            node = stack[-1][1]

        pos, end = 0, len(page)
        while pos < end:
            m = _TAG.search(page, pos)
            stop = m.start() if m else end
            if stop > pos and not unshown:
                parts.append(page[pos:stop])
                if links:
                    linked += stop - pos
            if m is None:
                break
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            closing = m[1] == "/"
            if name in IGNORED or closing and name in VOID and name != "br":
                continue
            if name in UNSHOWN:
                unshown += -1 if closing and unshown else 0 if closing or m[3].endswith("/") else 1
                continue
            if name in _RAW_END:
                if not closing:
                    stop = _RAW_END[name].search(page, pos)
                    pos = stop.end() if stop else end
                    if name == "textarea":
                        self.controls[node] += 1
                continue
            if unshown:
                continue
            if name == "br":
                parts.append("\n")
                continue
            if name in VOID and name != "hr":
                if name == "input":
                    self.controls[node] += 1
                continue
            kind = BLOCKS.get(name)
            if closing:
                places = at.get(name)
                if kind is None:
                    if places and places[-1] > walls[-1]:
                        if stack[places[-1]][1] != stack[places[-1] - 1][1]:
                            flush()
                        close(places[-1])
                    continue
                flush()
                self._blocks += 1
                if places and (places[-1] >= cells[-1] or kind == "table"):
                    close(places[-1])
                continue
            if kind is None:
                bits, mark = self._attributes(name, m[3]) if "=" in m[3] or "-" in name or "hidden" in m[3] else (0, -1)
                if name == "button":
                    self.controls[node] += 1
                if m[3].endswith("/") and name not in ("a", "b", "i", "span"):
                    continue
                into = node
                if bits or mark >= 0:
                    flush()
                    into = self._node(node, "inline", bits, mark)
                at.setdefault(name, []).append(len(stack))
                stack.append((name, into, False))
                node = into
                continue
            flush()
            self._blocks += 1
            if at.get("p") and at["p"][-1] > cells[-1]:
                close(at["p"][-1])
            if name in ENDS:
                those, within = ENDS[name]
                wall = max((at[w][-1] for w in within if at.get(w)), default=0)
                found = [at[t][-1] for t in those if at.get(t) and at[t][-1] > wall]
                if found:
                    close(min(found))
            elif kind == "heading" and stack[-1][2] and BLOCKS.get(stack[-1][0]) == "heading":
                close(len(stack) - 1)
            if name == "hr":
                continue
            bits, mark = self._attributes(name, m[3]) if m[3] else (0, -1)
            node = self._node(node, kind, bits, mark)
            at.setdefault(name, []).append(len(stack))
            walls.append(len(stack))
            if name in CELLS:
                cells.append(len(stack))
            stack.append((name, node, True))
        flush()
        self.first.append(len(self.leaf))

    def arrays(self) -> Forest:
        return Forest(self)


class Forest:
    """The arrays of the trees: levels from the roots down, and features of the nodes."""

    def __init__(self, t: Trees) -> None:
        parent, kind, bits, mark = (np.asarray(a, np.int64) for a in (t.parent, t.kind, t.bits, t.mark))
        n = len(parent)
        into = self._merged(parent, kind, bits, mark)
        stays = into == np.arange(n)
        number = np.cumsum(stays) - 1
        self.parent = np.where(parent < 0, -1, number[into[parent]])[stays]
        self.kind, self.bits, self.mark = kind[stays], bits[stays], mark[stays]
        self.leaf = number[np.asarray(t.leaf, np.int64)]
        controls = np.bincount(number[into], t.controls, len(self.kind)) if n else np.zeros(0)
        depth = [0] * len(self.kind)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
        self.features = self._features(t, controls, number[np.asarray(t.roots, np.int64)])

    @staticmethod
    def _merged(parent: np.ndarray, kind: np.ndarray, bits: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """For each node, itself or the one that it is merged into: an only child that is like its
        parent says nothing more about the page."""
        into = np.arange(len(parent))
        if len(parent):
            above = np.maximum(parent, 0)
            only = np.bincount(above[parent >= 0], minlength=len(parent))[above] == 1
            alike = (parent >= 0) & only & (kind == kind[above]) & (bits == bits[above]) & (mark < 0)
            for i in np.flatnonzero(alike):
                into[i] = into[parent[i]]
        return into

    def add(self, out: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> None:
        """Add the values of the nodes of a level to their parents, whose numbers ascend with theirs."""
        parents = self.parent[nodes]
        begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        out[parents[begins]] += np.add.reduceat(values, begins, axis=0)

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.copy()
        for nodes in reversed(self.levels[1:]):
            self.add(out, nodes, out[nodes])
        return out

    def _features(self, t: Trees, controls: np.ndarray, roots: np.ndarray) -> np.ndarray:
        n = len(self.kind)
        counts = np.zeros((n, 5 + len(_CUES)))
        for k, (i, text) in enumerate(zip(self.leaf.tolist(), t.text, strict=True)):
            size = len(text) - text.count(" ") // 2
            counts[i, :4] = size, t.linked[k], text.count(". ") + text.rstrip().endswith((".", "!", "?", "…", "。")), text.count(",")
            if size <= 200:
                counts[i, 5:] = [bool(c.search(text)) for c in _CUES]
        counts[:, 4] = controls
        counts = self.up(counts)
        size, linked, ends, commas = counts[:, :4].T
        of = np.searchsorted(roots, np.arange(n), "right") - 1
        whole = np.maximum(size[roots][of] if n else size, 1)
        own = np.zeros(n)
        own[self.leaf] = size[self.leaf]
        before = np.cumsum(own) - own
        before = (before - (before[roots][of] if n else 0)) / whole
        some = np.maximum(size, 1)
        columns = [np.ones(n)]
        columns += [(self.kind == k).astype(float) for k in range(len(KINDS))]
        columns += [(self.bits >> k & 1).astype(float) for k in range(len(LEXICON))]
        columns += [size == 0, (size > 0) & (size < 25), size >= 80, size >= 250, linked / some, linked >= 0.9 * some, size / whole, size > 0.3 * whole]
        columns += [np.minimum(ends * 60 / some, 1), np.minimum(commas * 60 / some, 1), before, before < 0.02, before + size / whole > 0.98, counts[:, 4] > 0]
        columns += [(counts[:, 5 + k] > 0) & (size <= 400) for k in range(len(_CUES))]
        return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def chunk(pages: list[str]) -> tuple[Trees, Forest]:
    t = Trees()
    for page in pages:
        t.add(page)
    return t, t.arrays()


def block_text(t: Trees, page: int, keep: np.ndarray) -> str:
    """The kept runs of a page: one line for each block, white space as one space."""
    lines: list[str] = []
    parts: list[str] = []
    last = -1
    for i in range(t.first[page], t.first[page + 1]):
        if t.block[i] != last:
            lines.append(" ".join("".join(parts).split()))
            parts.clear()
            last = t.block[i]
        if keep[i]:
            parts.append(t.text[i])
    lines.append(" ".join("".join(parts).split()))
    return "\n".join(line for line in lines if line)
