"""A page's HTML as a flat tree of blocks, marked inline elements and runs of text, with the features of each node."""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements by how they lay out.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg object canvas audio video select button option head".split())
#: Of RAW: read to the end of the file where unclosed; the others that may stand within themselves; what may stand in a head.
TO_THE_END = frozenset("script style title textarea noscript iframe".split())
NESTS = frozenset("svg object template".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
OPTION_ENDS = frozenset("option optgroup select datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
TAGS = sorted(BLOCK) + ["#run", "#inline"]
TAG_ID = {t: k for k, t in enumerate(TAGS)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_PAIR = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|iframe)\b[^>]*(?:(?<=/)>|>.*?(?:</\1\b[^>]*>|\Z)|\Z)|<(/?)(svg|object|template|canvas|audio|video|select|button)(?![^\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|aria-hidden|hidden|style|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[.,;:!?]")


class Tree:
    """Parallel lists over nodes in page order; a node's parent comes before it."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.tokens: list[tuple[str, ...]] = []
        self.text: list[list[str] | None] = []
        self.linked: list[int] = []
        self.apart: list[bool] = []
        self.label: list[int | None] = []
        self.inputs: list[int] = []

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), label: int | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append([] if tag == "#run" else None)
        self.linked.append(0)
        self.apart.append(False)
        self.label.append(label)
        self.inputs.append(0)
        return len(self.tag) - 1


def _attributes(source: str) -> tuple[tuple[str, ...], int | None]:
    tokens, label = [], None
    for name, value in _ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-y":
            label = {"0": 0, "1": 1}.get(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            tokens.append("hidden")
        elif name not in ("aria-hidden", "style"):
            tokens += [t.lower() for t in _PART.findall(value)]
    return tuple(dict.fromkeys(tokens)), label


def _pairs(source: str) -> dict[int, int]:
    """Where elements that are dropped as a whole end, by where their content begins; unclosed ones are left out."""
    ends, opened = {}, {}
    for m in _PAIR.finditer(source):
        name = (m[3] or "").lower()
        if not name:
            continue
        own = opened.setdefault(name, [])
        if m[2]:
            if own:
                ends[own.pop()] = m.end()
        elif not m[4].endswith("/"):
            if name not in NESTS:
                own.clear()
            own.append(m.end())
    return ends


def _after(source: str, at: int, name: str, end: int | None, stack: list[tuple[str, int]]) -> int:
    """Where a dropped element ends whose content begins at `at`: with its own end tag or before that of a block around it; an unclosed
    one ends before the next tag of a block, an option before what cannot stand in it."""
    inside: list[str] = []
    while at < (len(source) if end is None else end):
        m = _TOKEN.search(source, at)
        if m is None:
            break
        at, tag, closing = m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        if name == "option" and tag in OPTION_ENDS:
            return at if closing and tag == name else m.start()
        if tag in TO_THE_END and (name, tag) != ("svg", "title") and not closing and not (m[3] or m[6] or "").endswith("/"):
            at = _raw_end(source, at, tag)
        elif tag in BLOCK and tag not in ("html", "body"):
            if end is None:
                return m.start()
            if not closing:
                inside.append(tag)
            elif tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag) :]
            elif any(t == tag for t, _ in stack):
                return m.start()
    return len(source) if end is None else end


def _raw_end(source: str, at: int, name: str) -> int:
    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
    return end.end() if end else len(source)


def _head_end(source: str, at: int, pairs: dict[int, int]) -> int:
    """After the end tag of a head, or before the first text or element of the body."""
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None or source[at : m.start()].strip():
            break
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if name == "head":
                return m.end()
        elif name and name not in HEAD and name not in ("html", "head"):
            return m.start()
        at = m.end()
        if not (m[1] or m[4] or (m[3] or m[6] or "").endswith("/")):
            if name in TO_THE_END or name == "noframes":
                at = _raw_end(source, at, name)
            elif name == "template":
                at = _after(source, at, name, pairs.get(at), [])
    return at


def parse(source: str, labelled: bool = False) -> Tree:
    """Lenient: implied end tags, stray end tags, unclosed elements and pages that end early. Labels are read of made-up pages only: in
    others their attribute is one like any that tells nothing."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", tree.add("html", -1))]
    run, links, apart, at, pairs = -1, 0, True, 0, _pairs(source)

    def say(text: str) -> None:
        nonlocal run, apart
        if run < 0:
            run = tree.add("#run", stack[-1][1])
            tree.apart[run], apart = apart, False
        tree.text[run].append(text)
        if links:
            tree.linked[run] += len(text)

    def close(k: int) -> None:
        nonlocal run, apart
        run = -1
        apart = apart or any(t in BLOCK for t, _ in stack[k:])
        del stack[k:]

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if name in RAW:
            if name == "head" or not (m[3] or m[6] or "").endswith("/"):
                if name == "head":
                    at = _head_end(source, at, pairs)
                elif name in TO_THE_END:
                    at = _raw_end(source, at, name)
                else:
                    at = _after(source, at, name, pairs.get(at), stack)
            tree.inputs[stack[-1][1]] += name in ("select", "button", "textarea")
            continue
        if name in VOID:
            if name == "hr":
                run, apart = -1, True
            elif name == "br":
                say("\n")
            elif name == "input":
                tree.inputs[stack[-1][1]] += 1
            continue
        if name == "a":
            links += 1
        tokens, label = _attributes(m[3] or m[6] or "")
        label = label if labelled else None
        if name in BLOCK:
            if name in ("html", "body"):
                if name == "body":
                    tree.tokens[0] = tuple(dict.fromkeys(tree.tokens[0] + tokens))
                    tree.label[0] = label
                continue
            ends, scope = CLOSES.get(name, ()), SCOPE.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" and name not in ("li", "dt", "dd", "td", "th", "tr") or stack[k][0] in ends:
                    close(k)
                    if not ends:
                        break
                elif stack[k][0] in scope or stack[k][0] in BLOCK and not ends:
                    break
            run, apart, links = -1, True, links if name in ("div", "p", "h2", "h3", "h4", "section") else 0
            stack.append((name, tree.add(name, stack[-1][1], tokens, label)))
        elif tokens or label is not None:
            run = -1
            stack.append((name, tree.add("#inline", stack[-1][1], tokens, label)))
    return tree


FEATURES = 44


def features(tree: Tree, tag_odds: dict[str, float], token_odds: dict[str, float]) -> np.ndarray:
    """Numbers of each node: its subtree's densities, its attribute tokens, its depth, its siblings, its place on the page."""
    n = len(tree.tag)
    chars, words, marks, linked, nodes, runs, paragraphs, inputs, long_runs = ([0] * n for _ in range(9))
    for k, text in enumerate(tree.text):
        if text is not None:
            t = "".join(text)
            w = len(t.split())
            chars[k], words[k], marks[k], linked[k], runs[k] = len(t.strip()), w, len(_MARK.findall(t)), min(tree.linked[k], len(t.strip())), 1 if w else 0
            long_runs[k] = 1 if w >= 12 else 0
        nodes[k], inputs[k] = 1, tree.inputs[k]
        paragraphs[k] = 1 if tree.tag[k] == "p" else 0
    before, so_far = [0] * n, 0
    for k in range(n):
        before[k] = so_far
        so_far += chars[k]
    sums = (chars, words, marks, linked, nodes, runs, paragraphs, inputs, long_runs)
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        for s in sums:
            s[p] += s[k]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[tree.parent[k]].append(k)
    place, before_me, after_me = [0] * n, [-1] * n, [-1] * n
    same = [0] * n
    for own in children:
        kinds: dict[str, int] = {}
        for k in own:
            kinds[tree.tag[k]] = kinds.get(tree.tag[k], 0) + 1
        for j, k in enumerate(own):
            place[k], same[k] = j, kinds[tree.tag[k]]
            before_me[k], after_me[k] = own[j - 1] if j else -1, own[j + 1] if j + 1 < len(own) else -1
    total = max(1, chars[0])
    semantic = {t for t in tree.tag if t in ("article", "main")}
    depth, worst, best, worst_tag, in_main = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    out = np.zeros((n, FEATURES), np.float32)
    for k in range(n):
        p = tree.parent[k]
        odds = [token_odds[t] for t in tree.tokens[k] if t in token_odds]
        low, high = min(odds, default=0.0), max(odds, default=0.0)
        tag = tag_odds.get(tree.tag[k], 0.0)
        if p >= 0:
            depth[k] = depth[p] + 1
            worst[k], best[k], worst_tag[k] = min(worst[p], low), max(best[p], high), min(worst_tag[p], tag)
            in_main[k] = in_main[p] or tree.tag[k] in semantic
        c, w = chars[k], words[k]
        a, b = before_me[k], after_me[k]
        row = out[k]
        row[:23] = (
            tag, low, high, sum(odds), len(tree.tokens[k]), worst[k], best[k], worst_tag[k], in_main[k], len(semantic) - in_main[k], depth[k],
            np.log1p(c), np.log1p(w), linked[k] / c if c else 0, marks[k] / w if w else 0, w / max(1, runs[k]), np.log1p(nodes[k]), c / nodes[k], paragraphs[k], inputs[k], long_runs[k], c / total, before[k] / total,
        )
        if p >= 0:
            row[23:31] = tag_odds.get(tree.tag[p], 0.0), worst[p], best[p], chars[k] / max(1, chars[p]), linked[p] / max(1, chars[p]), paragraphs[p], same[k], len(children[p])
            row[31:33] = place[k], place[k] / len(children[p])
            if a >= 0:
                row[33:36] = tag_odds.get(tree.tag[a], 0.0), np.log1p(chars[a]), linked[a] / max(1, chars[a])
            if b >= 0:
                row[36:39] = tag_odds.get(tree.tag[b], 0.0), np.log1p(chars[b]), linked[b] / max(1, chars[b])
            row[39:43] = min((token_odds.get(t, 0.0) for t in tree.tokens[p]), default=0.0), max((token_odds.get(t, 0.0) for t in tree.tokens[p]), default=0.0), long_runs[p], inputs[p]
        row[43] = tree.tag[k] == "#run"
    return out


def decode(tree: Tree, logit: np.ndarray) -> list[bool]:
    """The likeliest choice of kept nodes in which no node is kept below one that is dropped."""
    n = len(tree.tag)
    x = np.clip(logit, -12, 12)
    keep = (-np.logaddexp(0, -x)).tolist()
    drop = (-np.logaddexp(0, x)).tolist()
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = [keep[0] >= drop[0]]
    for k in range(1, n):
        kept.append(kept[tree.parent[k]] and keep[k] > drop[k])
    return kept


def text_of(tree: Tree, kept: list[bool]) -> str:
    """Blocks in page order, joined by one space; white space inside a block is one space."""
    blocks: list[list[str]] = [[]]
    for k, text in enumerate(tree.text):
        if text is None:
            continue
        if tree.apart[k]:
            blocks.append([])
        if kept[k]:
            blocks[-1] += text
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(x for x in lines if x)
