"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, in page order, with the tags, roles and class
words of their ancestors. Each block has features of its ancestors, its text and its place; the field scores label sequences
(article or not) by features and by transitions between neighbours, and Viterbi decoding picks the best one. It is
trained by the conditional likelihood on labelled pages (page_samples).
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, table
from pointframe.llm.page_samples import sample_pages

TRAIN_PAGES = 800
EPOCHS = 8

#: Fixed values of HTML: elements that break a line of text, that have no content, and whose content isn't page text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head template noscript svg math object canvas audio video select button datalist".split())
#: Fixed values of HTML: what an opening tag closes, if it is open inside the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_EDGE = re.compile(r"""[>"']""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in sorted(RAW)}
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARK = re.compile(r"""data-main\s*=\s*["']?([01])""")  # the label of a training page's element
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of class and id names that say what a part of a page is; matched from the start of a name's parts.
NAME_GROUPS = {
    "menu": "nav menu breadcrumb toolbar topnav tabs pagination pager skip",
    "head": "header masthead topbar logo branding hero",
    "foot": "footer foot bottom colophon copyright legal",
    "side": "sidebar side aside rail widget related recommend trending popular",
    "advert": "ad ads adv advert sponsor promo banner dfp taboola outbrain adsense",
    "notice": "cookie consent notice gdpr popup modal overlay alert paywall warning toast",
    "form": "form login signin signup search subscribe newsletter register contact",
    "social": "share social follow tags author byline bio",
    "comment": "comment respons repl discussion disqus thread",
    "article": "article content post entry story body text main blog news",
}
_GROUP = {w: g for g, ws in NAME_GROUPS.items() for w in ws.split()}


@functools.lru_cache(20_000)
def _name_features(value: str) -> tuple[str, ...]:
    out = set()
    for part in _PART.findall(_CAMEL.sub("-", value).lower()):
        out.add("n=" + part)
        g = _GROUP.get(part) or next((_GROUP[part[:k]] for k in range(len(part) - 1, 5, -1) if part[:k] in _GROUP), None) or _GROUP.get(part.rstrip("s"))
        if g:
            out.add("g=" + g)
    return tuple(sorted(out))


@dataclass
class Block:
    """A leaf block: its text, the element that holds it, what its ancestors say, how much of it is link text, and its label if marked."""

    text: str
    tag: str
    ancestors: frozenset[str]
    linked: int
    label: int | None = None


@dataclass
class _Frame:
    tag: str
    holder: str  # the nearest block element, itself included
    features: frozenset[str]
    label: int | None
    silent: bool = False


@functools.lru_cache(20_000)
def _frame_features(tag: str, attrs: str) -> frozenset[str]:
    out = {"t=" + tag} if tag in BLOCKS else set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden", "style"):
            if key == "hidden" or value.lower() == "true" or "display:none" in value.replace(" ", "").lower():
                out.add("hidden")
        elif key == "role":
            out.add("r=" + value.lower())
        else:
            out.update(_name_features(value))
    return frozenset(out)


class _Scanner:
    """Where markup begins and ends in a page; no part of the page is gone through more than a few times, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.open: set[int] = set()  # places outside of quotes from which no tag ends

    def close_of(self, at: int) -> int:
        """The end of a start tag whose attributes begin at `at`: after the first > outside of quotes or, without one, the first."""
        page, k, seen = self.page, at, []
        while k not in self.open and (m := _EDGE.search(page, k)) is not None:
            if m[0] == ">":
                return m.end()
            seen.append(k)
            k = page.find(m[0], m.end()) + 1 if m.start() < self.quotes[m[0]] else -1
            if k < 0:
                break
        self.open.update(seen)
        return page.find(">", at) + 1

    def tags(self):
        """(start, end, kind, name, attributes) of each piece of markup: kind is "<", "/" or "!"; start tags may be answered by a place to go on from."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            sign = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, "!", "", ""
                continue
            if start > self.last:
                return  # nothing closes any more
            if sign in ("!", "?"):
                at = page.find(">", start) + 1
                yield start, at, "!", "", ""
            elif sign == "/" and (m := _NAME.match(page, start + 2)) is not None:
                at = page.find(">", m.end()) + 1
                yield start, at, "/", m[0].lower(), ""
            elif (m := _NAME.match(page, start + 1)) is not None:
                at = self.close_of(m.end())
                at = (yield start, at, "<", m[0].lower(), page[m.end() : at - 1]) or at
            else:
                at = start + 1


def read_blocks(page: str, known: frozenset[str] | None = None, marked: bool = False) -> list[Block]:
    """The leaf blocks of a page, character references decoded and white space runs made one space; blank ones are left out.

    Of ancestors, only features in `known` are kept, if it is given; labels are read from marked pages only. The time is
    linear in the page: which elements are open, and where the nearest of a kind stands, is kept along with the stack.
    """
    blocks: list[Block] = []
    stack = [_Frame("", "", frozenset(), None)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
    walls: list[int] = []  # of the open block elements
    text: list[str] = []
    linked, at = 0, 0
    scanner = _Scanner(page)

    def add(upto: int) -> None:
        nonlocal linked
        if upto > at and not stack[-1].silent:
            text.append(page[at:upto])
            if places["a"]:
                linked += upto - at

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                top = stack[-1]
                blocks.append(Block(joined, top.holder, top.features, linked, top.label))
            text.clear()
        linked = 0

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(down_to: int) -> None:
        if walls and walls[-1] >= down_to:
            flush()
        while len(stack) > down_to:
            tag = stack.pop().tag
            places[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()

    markup = scanner.tags()
    answer = None
    while True:
        try:
            start, end, kind, tag, attrs = markup.send(answer)
        except StopIteration:
            break
        answer = None
        add(start)
        at = end
        if kind == "!":
            continue
        if kind == "/":
            if tag == "p" and not places["p"]:
                flush()
            k = nearest((tag,))
            if k and (tag in BLOCKS or tag in SILENT or not walls or k > walls[-1]):  # an inline end tag doesn't close blocks
                close(k)
            continue
        if tag == "br" or tag == "wbr":
            if not stack[-1].silent and tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            m = _RAW_END[tag].search(page, at) if at <= scanner.last else None
            answer = at = page.find(">", m.end()) + 1 or len(page) if m else len(page)
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("body", "html"):
                if (k := nearest(("p",))) > nearest(("td", "th", "button", "table")):
                    close(k)
            elif places["head"]:  # a body ends the head
                close(places["head"][0])
            if tag in CLOSES:
                closed, stops = CLOSES[tag]
                if (k := nearest(closed)) > nearest(stops):
                    close(k)
        if tag in VOIDS or attrs.endswith("/") and tag in SILENT:
            continue
        features = _frame_features(tag, attrs) if len(attrs) < 300 else _frame_features.__wrapped__(tag, attrs)
        if known is not None:
            features &= known
        top = stack[-1]
        mark = _MARK.search(attrs) if marked else None
        places[tag].append(len(stack))
        if tag in BLOCKS:
            walls.append(len(stack))
        stack.append(_Frame(tag, tag if tag in BLOCKS else top.holder, top.features if features <= top.features else top.features | features, int(mark[1]) if mark else top.label, top.silent or tag in SILENT))
    add(len(page))
    flush()
    return blocks


_CUES = {
    "c=advert": re.compile(r"^\W*(?:story continues below )?(?:advertis(?:ement|ements|ing)|sponsored(?: content| post| by \S+)?|promoted|anzeigen?|werbung|publicité|publicidad|anuncio|ads?)\W*$", re.I),
    "c=rights": re.compile(r"©|\(c\)|copyright|rights reserved|privacy|terms of", re.I),
    "c=notice": re.compile(r"cookie|subscribe|newsletter|sign up|log in|sign in|accept", re.I),
}


def block_features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block: ancestors, holding tag, shape of the text, place in the page."""
    out, n = [], len(blocks)
    heading = next((k for k, b in enumerate(blocks) if b.tag == "h1"), None)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.linked / max(len(b.text), 1)
        f = ["bias", "tag=" + b.tag, *b.ancestors]
        f.append(f"words={min(words.bit_length(), 8)}")
        f.append("links=" + ("none" if density == 0 else "some" if density < 0.5 else "most"))
        f.append("ends=" + str(b.text[-1] in ".!?…\"'”"))
        f.append("place=" + ("first" if k == 0 else "last" if k == n - 1 else "in"))
        if heading is not None:
            f.append("after_h1" if k >= heading else "before_h1")
        f += [f"{name},{min(words.bit_length(), 8)}" for name, cue in _CUES.items() if cue.search(b.text)]
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of the features for label 1 against 0, of the transitions, and of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    @functools.cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.weights)

    def emissions(self, feats: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(x, 0.0) for x in f]) for f in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best label sequence, by Viterbi; of equal ones the labels 0."""
        if not feats:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        e = self.emissions(feats)
        a, b, back = 0.0, e[0], []
        for x in e[1:]:
            from_a, from_b = a + s00 < b + s10, a + s01 < b + s11
            a, b = (b + s10 if from_a else a + s00), (b + s11 if from_b else a + s01) + x
            back.append((from_a, from_b))
        y = [int(b > a)]
        for choice in reversed(back):
            y.append(int(choice[y[-1]]))
        return y[::-1]

    def gradient(self, feats: list[list[str]], y: list[int]) -> tuple[list[float], np.ndarray]:
        """d log p(y) by the emissions and transitions, by the forward-backward recursions in log space."""
        e, n = self.emissions(feats), len(feats)
        (s00, s01), (s10, s11) = self.step.tolist()
        add = np.logaddexp
        fa, fb, ga, gb = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        fb[0] = e[0]
        for k in range(1, n):
            fa[k] = float(add(fa[k - 1] + s00, fb[k - 1] + s10))
            fb[k] = float(add(fa[k - 1] + s01, fb[k - 1] + s11)) + e[k]
        for k in range(n - 2, -1, -1):
            ga[k] = float(add(ga[k + 1] + s00, gb[k + 1] + s01 + e[k + 1]))
            gb[k] = float(add(ga[k + 1] + s10, gb[k + 1] + s11 + e[k + 1]))
        z = float(add(fa[-1], fb[-1]))
        de = [y[k] - float(np.exp(fb[k] + gb[k] - z)) for k in range(n)]
        ds = np.zeros((2, 2))
        for k in range(1, n):
            ds[y[k - 1], y[k]] += 1
            into = np.array([[fa[k - 1] + s00 + ga[k], fa[k - 1] + s01 + e[k] + gb[k]], [fb[k - 1] + s10 + ga[k], fb[k - 1] + s11 + e[k] + gb[k]]])
            ds -= np.exp(into - z)
        return de, ds


def train(pages: list[str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> Field:
    """A field fitted to marked pages by AdaGrad steps, one page at a time; pages without blocks teach nothing."""
    model, seen, seen_step = Field(), {}, np.full((2, 2), 1.0)
    data = []
    for p in pages:
        blocks = read_blocks(p, marked=True)
        if blocks:
            data.append((block_features(blocks), [b.label or 0 for b in blocks]))
    for _ in range(epochs):
        for feats, y in data:
            de, ds = model.gradient(feats, y)
            total: dict[str, float] = {}
            for f, g in zip(feats, de, strict=True):
                if abs(g) > 1e-4:
                    for x in f:
                        total[x] = total.get(x, 0.0) + g
            for x, g in total.items():
                g -= decay * model.weights.get(x, 0.0)
                seen[x] = seen.get(x, 1.0) + g * g
                model.weights[x] = model.weights.get(x, 0.0) + rate * g / seen[x] ** 0.5
            seen_step += ds * ds
            model.step += rate * ds / np.sqrt(seen_step)
    return model


@functools.lru_cache(1)
def trained() -> Field:
    return train(sample_pages(TRAIN_PAGES))


def main_text(page: str, model: Field) -> str:
    blocks = read_blocks(page, model.known)
    labels = model.decode(block_features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """pages with the main text of each whole page.

    A null or empty page and one without article text give an empty text; broken markup is read leniently and never
    fails; repeated rows stay; an empty table stays empty; an existing column named as the new one is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # some hundred weights

    def make():
        m = shared.value
        claim("pages", lambda: (_frame_features.cache_clear(), _name_features.cache_clear()))
        return lambda texts: [pa.array([main_text(t, m) for t in texts], pa.string())]

    return append_columns(pages, html_col, [T.StructField(text_col, T.StringType())], make)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
