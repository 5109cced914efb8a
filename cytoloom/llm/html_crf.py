"""Main text of HTML pages: a linear-chain conditional random field labels the leaf blocks of the DOM."""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.markup import Ends, Scanner
from cytoloom.llm.shared import beside, groups

# Fixed values of HTML: elements without content, of raw text, within a line, and those that an opening tag of their kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea".split())
SKIPPED = frozenset("noscript select svg".split())  # their text is dropped, as far as they or the elements around them go
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label object".split())
MATH = frozenset("math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= MATH
SPACED = MATH - frozenset("math mi mn mo mrow ms mspace mstyle mtext none".split())  # elements whose parts are set apart, not in a row
HTML = frozenset("address article aside blockquote body center dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())  # ends svg and select
ENDS = {"select": HTML - {"hr"} | {"input", "select", "textarea"}, "svg": HTML | frozenset("b big br code div em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split())}

HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())  # whatever else opens ends the head
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_ATTRIBUTE = re.compile(r"\b(id|class|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Block:
    """A run of text without a block-level tag in it: its words, the features of the elements above it, the nearest of them that isn't
    within a line, and how much of it stands in links."""

    __slots__ = ("text", "above", "own", "linked")

    def __init__(self, text: str, above: tuple[str, ...], own: str, linked: int):
        self.text, self.above, self.own, self.linked = text, above, own, linked


def title_end(ends: Ends, at: int) -> int | None:
    """Where the title whose text begins at `at` ends: its text has no tags. None: its end tag is missing, as a title before the
    head's end or the body isn't ended by one that follows them."""
    end, head = ends.find(r"</title\s*>", at), ends.find(r"</head\s*>|<body[\s/>]", at)
    if not end or (head and head.end() <= end.start() and not ends.find(r"</head\s*>|<body[\s/>]", end.end())):
        return None
    return end.end()


def raw_end(ends: Ends, at: int, tag: str, around: str | None) -> int | None:
    """Where the raw text that begins at `at` ends, the page's end if it has no end tag. None: in `around` it has none, so it isn't raw."""
    end = ends.find(rf"</{re.escape(tag)}\s*>", at)
    if around:
        outer = ends.find(rf"</{re.escape(around)}\s*>", at)
        return end.end() if end and not (outer and outer.start() < end.start()) else None
    return end.end() if end else len(ends.page)


def noscript_end(ends: Ends, at: int) -> int | None:
    """Where the noscript that begins at `at` ends by its own end tag. None: it has none before the next one begins."""
    end = ends.find(r"<(/?)noscript(?:\s[^>]*)?>", at)
    return end.end() if end and end[1] else None


class Elements:
    """The open elements, and the features they give the text within: those of the same name count once. known: the only features of
    interest, all if None; so what a block keeps is bounded by them, however deep it lies. An element that is taken out from among others
    leaves an empty tag, so that no place changes."""

    def __init__(self, known: Container[str] | None):
        self.known, self.tags, self.names, self.active = known, [], [], {}
        self.places: dict[str, list[int]] = defaultdict(list)
        self.outer: list[int] = []  # the places of those that aren't within a line
        self.told: tuple[str, ...] | None = ()

    def push(self, tag: str, names: str = "") -> None:
        found = [] if tag in INLINE or tag in ("html", "body") else ["t:" + tag]
        found += ["n:" + w for w in _NAME.findall(names)]
        found = [f for f in found if self.known is None or f in self.known]
        self.places[tag].append(len(self.tags))
        if tag not in INLINE:
            self.outer.append(len(self.tags))
        self.tags.append(tag)
        self.names.append(found)
        for f in found:
            self.active[f] = self.active.get(f, 0) + 1
            if self.active[f] == 1:
                self.told = None

    def take(self, i: int) -> None:
        """Takes out the element at i, the last of its tag; if it isn't within a line, the last of those too."""
        tag, self.tags[i] = self.tags[i], ""
        self.places[tag].pop()
        if tag not in INLINE:
            self.outer.pop()
        for f in self.names[i]:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
                self.told = None
        self.names[i] = []
        while self.tags and not self.tags[-1]:
            self.tags.pop()
            self.names.pop()

    def cut(self, i: int) -> None:
        """Takes out all from i on."""
        while len(self.tags) > i:
            self.take(len(self.tags) - 1)

    def last(self, tag: str) -> int | None:
        """The place of the last open element of that tag."""
        return self.places[tag][-1] if self.places[tag] else None

    def is_open(self, *tags: str) -> bool:
        return any(self.places[t] for t in tags)

    def above(self) -> tuple[tuple[str, ...], str]:
        if self.told is None:
            self.told = tuple(self.active)
        return self.told, self.tags[self.outer[-1]] if self.outer else "none"


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order. Broken markup is taken as it comes: unclosed elements end with the one around them. `known`:
    the features of elements that blocks are to keep, all if None."""
    out: list[Block] = []
    stack, scan, ends = Elements(known), Scanner(page), Ends(page)
    parts: list[str] = []
    linked = depth_a = done = 0
    skip = 0  # the depth of the skipped element that is open, 0 without one
    in_head, titles = False, True  # whether a head or title may be open, and whether titles have had their end tags so far

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text and not stack.is_open("head", "title"):
            out.append(Block(text, *stack.above(), linked))
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        parts.append(s)
        if depth_a:
            linked += len(s)

    def text(s: str) -> None:
        if skip or not s:
            return
        if stack.tags and stack.tags[-1] == "head" and not s.isspace():
            stack.cut(len(stack.tags) - 1)
        add(s)

    for begin, end, slash, tag, attributes in scan.tokens():
        text(page[done:begin])
        done = end
        if not tag:
            if slash:
                text("<")
            continue
        alone = attributes.rstrip().endswith("/")
        if slash and skip:
            i = stack.last(tag)
            if i is None:
                continue
            stack.cut(max(i, skip - 1))
            if i >= skip - 1:
                skip *= i >= skip
                continue
            skip = 0
        if slash:
            if tag in INLINE:
                depth_a = max(0, depth_a - (tag == "a"))
                i = stack.last(tag)
                if i is not None and (not stack.outer or stack.outer[-1] < i):
                    stack.take(i)
            elif stack.is_open(tag):
                flush()
                stack.cut(stack.last(tag))
                depth_a = 0
            continue
        if in_head and tag not in HEAD:
            in_head = False
            if stack.is_open("head", "title"):
                i = min(p for t in ("head", "title") for p in stack.places[t][:1])
                flush()
                stack.cut(i)
                skip *= skip <= i
        if skip and tag in ENDS.get(stack.tags[skip - 1], ()) and not stack.is_open("foreignobject", "desc", "title"):
            again = tag == "select"
            stack.cut(skip - 1)
            skip = 0
            if again:
                continue
        if tag == "title" and not skip and titles and not alone:
            if place := title_end(ends, end):
                scan.at = done = place
                continue
            titles = False
        if tag in RAW:
            if not alone:
                place = raw_end(ends, end, tag, stack.tags[skip - 1] if skip else None)
                if place is None:
                    stack.push(tag)
                else:
                    scan.at = done = place
            continue
        if tag == "noscript" and (place := noscript_end(ends, end)):
            scan.at = done = place
            continue
        if skip or tag in SKIPPED:
            if tag not in VOID and not alone:
                stack.push(tag)
                skip = skip or len(stack.tags)
            continue
        if tag not in INLINE:
            flush()
            if tag in IMPLIED:
                for i in reversed(stack.outer if stack.is_open(*IMPLIED[tag]) else []):
                    if stack.tags[i] in IMPLIED[tag]:
                        stack.cut(i)
                        break
                    if stack.tags[i] not in IMPLIED:
                        break
            elif tag != "br" and stack.outer and stack.tags[stack.outer[-1]] == "p":  # a block element ends a paragraph
                stack.cut(stack.outer[-1])
        if tag in MATH and stack.tags and stack.tags[-1] in SPACED:
            add(" ")
        if tag in VOID or alone:
            if tag == "br":
                add(" ")
            continue
        names = ""
        if attributes:
            found = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)]
            names = " ".join([v for k, v in found if k not in ("hidden", "aria-hidden")] + ["hidden" for k, v in found if k == "hidden" or (k == "aria-hidden" and v == "true")]).lower()
        depth_a += tag == "a"
        in_head |= tag in ("head", "title")
        stack.push(tag, names)
    text(page[done:])
    if skip:
        stack.cut(skip - 1)
    flush()
    return out


def features(block: Block) -> list[str]:
    """Ancestor tags, the words of their classes, and what the text is like."""
    out = ["bias", *block.above, "own:" + block.own]
    n, words = len(block.text), block.text.count(" ") + 1
    out += [f"words:{min(words.bit_length(), 7)}", f"links:{min(4, 5 * block.linked // max(1, n))}", "ends:" + ("mark" if block.text[-1] in ".!?…" else "none")]
    if "©" in block.text:
        out.append("sign:©")
    return out


class Model:
    """Weights of a chain over the labels 0 (other) and 1 (main text): a row for each feature, and one for each pair of labels."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 20, rate: float = 0.5, ridge: float = 1e-3):
        index: dict[str, int] = {}
        for rows, _ in pages:
            for f in rows:
                for name in f:
                    index.setdefault(name, len(index))
        w, trans = np.zeros((len(index), 2)), np.zeros((2, 2))
        gw, gt = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
        coded = []
        for rows, labels in pages:
            x = np.zeros((len(rows), len(index)))
            for i, f in enumerate(rows):
                x[i, [index[n] for n in f]] = 1
            coded.append((x, np.array(labels)))
        for _ in range(rounds):  # gradient of the log-likelihood, page by page, by forward and backward sums
            for x, y in coded:
                if not len(y):
                    continue
                e = x @ w
                one, two = self._marginals(e, trans)
                d = -one
                d[np.arange(len(y)), y] += 1
                dw, dt = x.T @ d - ridge * w, -two - ridge * trans
                np.add.at(dt, (y[:-1], y[1:]), 1)
                gw += dw**2
                gt += dt**2
                w += rate * dw / np.sqrt(gw)
                trans += rate * dt / np.sqrt(gt)
        self.weights, self.trans = {k: (float(w[i, 0]), float(w[i, 1])) for k, i in index.items()}, trans.tolist()

    @staticmethod
    def _marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(e)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = e[0]
        for i in range(1, n):
            a[i] = e[i] + np.logaddexp(a[i - 1, 0] + t[0], a[i - 1, 1] + t[1])
        for i in range(n - 2, -1, -1):
            z = t + e[i + 1] + b[i + 1]
            b[i] = np.logaddexp(z[:, 0], z[:, 1])
        total = np.logaddexp(a[-1, 0], a[-1, 1])
        two = np.exp(a[:-1, :, None] + t + (e[1:] + b[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
        return np.exp(a + b - total), two

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi). Features that training never saw say nothing."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.trans
        back, get, p, q = [], self.weights.get, 0.0, 0.0
        for n, names in enumerate(rows):
            a = b = 0.0
            for f in names:
                w = get(f)
                if w is not None:
                    a += w[0]
                    b += w[1]
            if n:
                back.append((q + t10 > p + t00, q + t11 > p + t01))
                p, q = max(p + t00, q + t10) + a, max(p + t01, q + t11) + b
            else:
                p, q = a, b
        label = int(q > p)
        out = [label]
        for came in reversed(back):
            label = int(came[label])
            out.append(label)
        return out[::-1]


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Labelled training pages, made by rule: blocks of main text bear a mark that no other block has. The layouts mix semantic
    elements and named divisions for menus, headers, notices, adverts, sidebars, forms, reader comments and footers."""
    rng, mark = random.Random(seed), ""
    syllables = "an be ca do er fi go ha in ju ka lo me no or pa qu re st ti un ve wo ty za".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda: say(2, 18) + rng.choice([".", ".", ".", "!", "?", ".###", ""])
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6, 12])))
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def box(names: str, tags: str, inside: str) -> str:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        attribute = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name}-{word()}"', f' role="{name}"'])
        return f"<{tag}{'' if tag not in ('div', 'section', 'p', 'ul') and rng.random() < 0.5 else attribute}>{inside}</{tag}>"

    def other() -> dict[str, str]:
        p = lambda: rng.choice([prose(), f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{link()}</p>", f"<h3>{say(1, 4)}</h3>{links()}"])
        reader = lambda: box("comment reply response", "div li article section", f"<b>{word()}</b><p>{prose()}</p>")
        return {
            "nav": box("nav navigation menu navbar breadcrumb breadcrumbs", "nav nav div ul", rng.choice([links(), " | ".join(link() for _ in range(4))])),
            "header": box("header masthead banner topbar site", "header header div", rng.choice([say(1, 5), f"<h1>{say(1, 3)}</h1>", f"<p>{prose()}</p>", links()])),
            "notice": box("notice cookie cookies consent alert gdpr banner popup modal newsletter subscribe", "div div aside section", p()),
            "ad": box("ad ads advert advertisement sponsored sponsor promo promotion", "div div aside section", p()),
            "aside": box("sidebar side widget related recommended trending share social", "aside aside div section", p()),
            "form": f"<form><label>{say(1, 3)}</label><input name=q><button>{word()}</button><p>{sentence()}</p></form>",
            "comments": box("comments commentlist discussion responses disqus replies", "section div div ol", f"<h3>{say(1, 3)}</h3>" + "".join(reader() for _ in range(rng.randint(1, 5)))),
            "footer": box("footer copyright colophon legal", "footer footer div", rng.choice([f"&copy; {word()}.example &middot; {prose()}", f"<p>{prose()}</p>", links()])),
        }

    def body() -> str:
        m = lambda s: mark + s
        out = [f"<h1>{m(say(2, 10))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.62:
                out.append(f"<p>{m(prose())}</p>")
            elif kind < 0.72:
                out.append(f"<p><b>{m(prose())}<br>" + f"<p>{m(prose())}</p>" * (rng.random() < 0.5))
            elif kind < 0.78:
                out.append(f"<p>{m(say(3, 9))} {link()} {prose()}</p>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{m(say(1, 9))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<h2>{m(say(1, 6))}</h2>")
            elif kind < 0.94:
                out.append(f"<blockquote>{m(prose())}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{m(word())}</td><td>{m(say(1, 4))}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre>{m(say(2, 9))}</pre><figure><figcaption>{m(say(2, 9))}</figcaption></figure>")
            if rng.random() < 0.06:
                out.append(rng.choice([other()[k] for k in ("ad", "aside", "notice", "form")]))
        return "".join(out)

    pages = []
    for _ in range(n):
        o, main = other(), body()
        some = lambda keys, p: "".join(o[k] for k in keys.split() if rng.random() < p)  # noqa: E731, B023
        tag = rng.choice(["article", "article", "article", "main", "div", "div"])
        name = rng.choice(["content", "article", "post", "entry", "story", "main", "body", "text"])
        inside = f"<{tag}{'' if tag != 'div' else f' class={name}'}>{main}</{tag}>" if rng.random() < 0.93 else main
        if tag == "article" and rng.random() < 0.3:
            inside = f"<main>{inside}{some('aside comments', 0.4)}</main>"
        html = f"<html><head><title>{say(1, 5)}</title></head><body>{some('header nav notice ad', 0.55)}{inside}{some('comments aside ad form nav', 0.4)}{some('footer', 0.85)}</body></html>"
        blocks = leaf_blocks(html)
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "") or "-"
        pages.append((blocks, labels))
    return pages


def train(pages: list[tuple[list[Block], list[int]]] | None = None) -> Model:
    """Fits the field to labelled pages, by default to those of `labelled_pages`, a fixed number."""
    return Model([([features(b) for b in blocks], labels) for blocks, labels in (labelled_pages() if pages is None else pages)])


def main_text(model: Model, page: str | None) -> tuple[str, int, int]:
    """The main text of a page, its blocks joined by a space; how many blocks it has, and how many are main text."""
    blocks = leaf_blocks(page or "", model.weights)
    picked = [b.text for b, y in zip(blocks, model.decode([features(b) for b in blocks]), strict=True) if y]
    return " ".join(picked), len(blocks), len(picked)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Adds text, n_blocks and n_main to every page, from its whole html, character references decoded and white space joined.

    Null and empty pages, and pages without text, get "" and 0. Repeated rows are answered alike; input columns with the names of the
    results are replaced, others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_main", T.LongType())])

    @F.arrow_udf(schema)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [main_text(shared.value, p) for part in groups(batch) for p in part.to_pylist()]
            columns = [list(c) for c in zip(*found)] or [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=schema.names)

    return beside(pages, [c for c in pages.columns if c not in schema.names], decode(F.col(html)))
