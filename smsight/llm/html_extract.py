"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read once, forgiving unclosed and wrongly nested tags. Every run of text between block boundaries is a leaf block
with the tags, classes and ids of its ancestors. The field has two labels, main and other; a block's score comes from
features of its ancestors and its text, a pair of neighbours' from their labels. Weights are trained on labelled pages by
gradient steps on the log-likelihood (forward and backward sums); the best labels of a page come from Viterbi's recursion.

Labelled pages are composed by rule from page parts whose label is known (``labelled_pages``), since the tables have none;
``train`` takes any others. Scripts, styles, comments in the source, form fields, elements with the attribute ``hidden`` or the
style ``display:none`` and other content that isn't shown make no blocks. A page's time grows with its length, however deep
its elements lie: a block names only the ancestor features that changed since the block before.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones left
out, main ones joined by a line feed. ``<br>`` is white space inside its block.

Defined results: a null or empty page, or one without main blocks, has the empty text; a page that breaks off inside a tag
ends there; repeated rows repeat. Columns with the names of the results are replaced, others are untouched.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from smsight.llm.frames import by_slices

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title "
    "tr ul noscript select optgroup button label".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# what isn't shown up to the end tag; scripts, styles, frames, templates and text fields are raw, so tags inside them are none
HIDDEN_TAGS = frozenset("svg object canvas math audio video".split())
# a new one of these ends an open one, up to the given containers
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "body": {"head"}}
ENDS_P = BLOCK_TAGS - {"label", "button", "option", "select"}
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html aside nav header footer form blockquote td th".split())
LISTS = frozenset("ul ol dl table select".split())
ENDED = frozenset().union(*IMPLIED_END.values())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|iframe|textarea)(?=[\s/>]|\Z)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s/=]|$)", re.I)
_NOT_SHOWN = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*?\bdisplay\s*:\s*none\b|'[^']*?\bdisplay\s*:\s*none\b|display:none\b)", re.I)

PARTS = frozenset("article aside blockquote body footer form head header main menu nav section table figure".split())

MAIN_MARK, OTHER_MARK = "\ue000", "\ue001"


@dataclass
class LeafBlock:
    begun: list[str]  # ancestor features that hold from this block on
    ended: list[str]  # those that held up to the block before
    tag: str  # the innermost block element
    part: str  # the innermost of PARTS
    named: bool
    text: str
    linked: int  # characters inside links


@dataclass
class _Element:
    name: str
    held: list[str]  # its ancestor features
    hidden: bool


@dataclass
class _Level:
    """An open block element with the inline elements open in it."""
    element: _Element
    part: str
    near: dict[str, int]  # where the innermost element lies that a new one would end
    inline: list[_Element]


def _is_hidden(attrs: str) -> bool:
    return bool(_HIDDEN.search(_QUOTED.sub("", attrs)) or _NOT_SHOWN.search(attrs))


def _hidden_spans(tokens: list[re.Match]) -> dict[int, int]:
    """From the start to the end tag of every hidden element, by their numbers in ``tokens``.

    One that is not ended before a block around it ends, or never, hides nothing.
    """
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    out = {}
    for i, token in enumerate(tokens):
        name = (token["name"] or token["name2"] or "").lower()
        if name in VOID_TAGS or name not in HIDDEN_TAGS and name not in BLOCK_TAGS:
            continue
        if not (token["end"] or token["end2"]):
            if not (name in HIDDEN_TAGS and (token["attrs"] or token["attrs2"] or "").endswith("/")):
                stack.append((name, i))
                opened[name] += 1
        elif opened[name]:
            while True:
                other, begin = stack.pop()
                opened[other] -= 1
                if other == name:
                    break
            if name in HIDDEN_TAGS:
                out[begin] = i
    return out


def leaf_blocks(page: str) -> list[LeafBlock]:
    """The leaf blocks of a page in order, without empty ones."""
    out: list[LeafBlock] = []
    levels = [_Level(_Element("none", [], False), "none", {}, [])]
    count: Counter[str] = Counter()  # ancestor features by the open elements that have them
    told: set[str] = set()  # those that hold for the last block
    changed: dict[str, None] = {}
    pieces: list[str] = []
    linked = named = dark = 0

    def enter(element: _Element) -> None:
        nonlocal named, dark
        for f in element.held:
            count[f] += 1
            changed[f] = None
        named += len(element.held) - 1
        dark += element.hidden

    def leave(element: _Element) -> None:
        nonlocal named, dark
        for f in element.held:
            count[f] -= 1
            changed[f] = None
        named -= len(element.held) - 1
        dark -= element.hidden

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            begun = [f for f in changed if count[f] and f not in told]
            ended = [f for f in changed if not count[f] and f in told]
            told.update(begun)
            told.difference_update(ended)
            changed.clear()
            out.append(LeafBlock(begun, ended, levels[-1].element.name, levels[-1].part, named > 0, text, linked))
        pieces.clear()
        linked = 0

    def cut(depth: int) -> None:
        """End all block elements from a depth on."""
        flush()
        while len(levels) > depth:
            level = levels.pop()
            for element in level.inline:
                leave(element)
            leave(level.element)

    def open_block(element: _Element) -> None:
        above, name = levels[-1], element.name
        near = {t: k for t, k in above.near.items() if name not in (SCOPE if t == "p" else LISTS)}
        if name in ENDED:
            near[name] = len(levels)
        levels.append(_Level(element, name if name in PARTS else above.part, near, []))

    def add(text: str) -> None:
        nonlocal linked
        if text and not dark:
            text = html.unescape(text)
            pieces.append(text)
            if count["in:a"]:
                linked += len(text.strip())

    at, shown = 0, 0
    tokens = list(_TOKEN.finditer(page))
    hidden = _hidden_spans(tokens)
    for i, token in enumerate(tokens):
        if i < shown:
            continue
        add(page[at:token.start()])
        at = token.end()
        if i in hidden:
            shown = hidden[i] + 1
            at = tokens[hidden[i]].end()
            continue
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        attrs = token["attrs"] or token["attrs2"] or ""
        if name == "br":
            pieces.append(" ")
        elif token["end"] or token["end2"]:
            if name in BLOCK_TAGS:
                if count[f"in:{name}"]:
                    cut(next(k for k in range(len(levels) - 1, 0, -1) if levels[k].element.name == name))
            elif count[f"in:{name}"]:  # an inline end must not end blocks
                inline = levels[-1].inline
                k = next((k for k in range(len(inline) - 1, -1, -1) if inline[k].name == name), None)
                if k is not None:
                    leave(inline.pop(k))
        else:
            if name in BLOCK_TAGS:
                flush()
                for ends in (IMPLIED_END["p"] if name in ENDS_P else (), IMPLIED_END.get(name, ())):
                    begin = max((levels[-1].near.get(t, 0) for t in ends), default=0)
                    if begin:
                        cut(begin)
            if name in VOID_TAGS or name in HIDDEN_TAGS:
                continue
            words = dict.fromkeys(w for m in _NAMES.finditer(attrs) for w in _PARTS.findall((m[1] or m[2] or m[3] or "").lower()))
            element = _Element(name, [f"in:{name}", *(f"name:{w}" for w in words)], bool(attrs) and _is_hidden(attrs))
            enter(element)
            if name in BLOCK_TAGS:
                open_block(element)
            else:
                levels[-1].inline.append(element)
    add(page[at:].removesuffix("</"))
    flush()
    return out


def own_features(blocks: list[LeafBlock]) -> Iterator[list[str]]:
    """Names of what holds for each block by itself."""
    for i, b in enumerate(blocks):
        size = len(b.text)
        links = 4 * b.linked // max(size, 1)
        yield [
            "any", f"tag:{b.tag}", f"part:{b.part}", f"links:{min(links, 4)}", f"size:{min(size.bit_length(), 12)}",
            f"ends:{b.text[-1] in '.!?…»”\"\''}", f"commas:{min(b.text.count(','), 3)}", f"named:{b.named}",
            *(["copyright"] if "©" in b.text else []), *(["first"] if i == 0 else []), *(["last"] if i == len(blocks) - 1 else [])]


def features(blocks: list[LeafBlock]) -> list[list[str]]:
    """Names of what holds for each block, by its ancestors and by itself."""
    out, held = [], {}
    for b, own in zip(blocks, own_features(blocks)):
        held |= dict.fromkeys(b.begun)
        for f in b.ended:
            del held[f]
        out.append([*own, *held])
    return out


@dataclass
class Model:
    weights: dict[str, float]  # score of main over other, in whole multiples of 2 ** -30, so that sums are exact
    move: np.ndarray  # [before, after], other = 0, main = 1
    begin: np.ndarray


def decode(model: Model, blocks: list[LeafBlock]) -> list[int]:
    """The best labels by Viterbi's recursion."""
    if not blocks:
        return []
    weight, move = model.weights, model.move.tolist()
    score, held = [], 0.0
    for b, own in zip(blocks, own_features(blocks)):
        held += sum(weight.get(f, 0.0) for f in b.begun) - sum(weight.get(f, 0.0) for f in b.ended)
        score.append(held + sum(weight.get(f, 0.0) for f in own))
    other, main = float(model.begin[0]), float(model.begin[1]) + score[0]
    back = []
    for s in score[1:]:
        to_other = (other + move[0][0], main + move[1][0])
        to_main = (other + move[0][1], main + move[1][1])
        back.append((int(to_other[1] > to_other[0]), int(to_main[1] > to_main[0])))
        other, main = max(to_other), max(to_main) + s
    labels = [int(main > other)]
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def train(pages: list[str], steps: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Fit the field to pages whose texts carry MAIN_MARK or OTHER_MARK in front."""
    names: dict[str, int] = {}
    index, owner, gold, place = [], [], [], []
    longest = 0
    for p, page in enumerate(pages):
        blocks = leaf_blocks(page)
        labels = [int(MAIN_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MAIN_MARK, "").replace(OTHER_MARK, "") or "-"
        for t, (fs, y) in enumerate(zip(features(blocks), labels)):
            index += [names.setdefault(f, len(names)) for f in fs]
            owner += [len(gold)] * len(fs)
            gold.append(y)
            place.append((t, p))
        longest = max(longest, len(blocks))
    index, owner, gold = np.array(index), np.array(owner), np.array(gold)
    t, p = np.array(place).T
    there = np.zeros((longest, len(pages)), bool)
    there[t, p] = True
    y = np.zeros((longest, len(pages)), int)
    y[t, p] = gold
    weight, move, begin = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-8) for x in (weight, move, begin)]
    pair = there[1:] & there[:-1]
    seen_move = np.array([[((y[:-1] == a) & (y[1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_begin = np.array([(y[0][there[0]] == a).sum() for a in (0, 1)], float)
    for _ in range(steps):
        score = np.zeros((longest, len(pages), 2))
        score[t, p, 1] = np.bincount(owner, weights=weight[index], minlength=len(gold))
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = begin + score[0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(ahead[k - 1][:, :, None] + move, axis=1) + score[k]
            ahead[k] = np.where(there[k][:, None], step, ahead[k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move[None] + (score[k + 1] + behind[k + 1])[:, None, :], axis=2)
            behind[k] = np.where(there[k + 1][:, None], step, behind[k + 1])
        whole = np.logaddexp.reduce(ahead[-1], axis=1)
        marginal = np.exp(ahead + behind - whole[None, :, None])
        both = np.exp(ahead[:-1, :, :, None] + move + (score[1:] + behind[1:])[:, :, None, :] - whole[None, :, None, None])
        slope = [np.bincount(index, weights=(gold - marginal[t, p, 1])[owner], minlength=len(names)),
                 seen_move - (both * pair[:, :, None, None]).sum((0, 1)), seen_begin - marginal[0][there[0]].sum(0)]
        for x, g, total in zip((weight, move, begin), slope, sums):
            g = g / len(pages) - penalty * x
            total += g * g
            x += rate * g / np.sqrt(total)
    return Model({f: round(float(weight[i]) * 2 ** 30) / 2 ** 30 for f, i in names.items()}, move, begin)


def labelled_pages(n: int = 500, seed: int = 7) -> list[str]:
    """Pages composed by rule from parts whose label is known; main texts carry MAIN_MARK, others OTHER_MARK."""
    rnd = random.Random(seed)
    pick, some = rnd.choice, lambda low, high: range(rnd.randint(low, high))

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("abcdefghilmnoprstu") for _ in some(2, 9)) for _ in some(low, high))

    def sentence(low: int = 4, high: int = 40) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", "", ", &amp; " + words(1, 5) + "."])

    def main(low: int = 4, high: int = 40) -> str:
        return MAIN_MARK + " ".join(sentence(low, high) for _ in some(1, 4))

    def other(low: int = 2, high: int = 12, n_most: int = 2) -> str:
        return OTHER_MARK + " ".join(sentence(low, high) for _ in some(1, n_most))

    def long_other() -> str:
        return other(4, 40, 4)

    def named(tag: str, *choices: str) -> tuple[str, str]:
        attr = pick(["class", "class", "id"])
        return f'<{tag} {attr}="{pick(choices)}">', f"</{tag}>"

    def wrap(marks: tuple[str, str], inner: str) -> str:
        return marks[0] + inner + marks[1]

    def links() -> str:
        items = "".join(f'<li><a href="/{words(1, 1)}">{OTHER_MARK}{words(1, 3)}</a></li>' for _ in some(2, 8))
        return pick([f"<ul>{items}</ul>", f"<ol>{items}</ol>", items.replace("<li>", "<span>").replace("</li>", "</span> ")])

    def menu() -> str:
        return wrap(pick([("<nav>", "</nav>"), named("div", "menu", "navbar", "nav-links", "breadcrumb", "main-menu"), named("ul", "menu", "nav")]), links())

    def header() -> str:
        return wrap(pick([("<header>", "</header>"), named("div", "header", "masthead", "topbar", "site-header")]),
                    pick([f"<h1>{other(1, 4, 1)}</h1>", f"<p>{other()}</p>", f"<div>{other(1, 4, 1)}</div>"]) + pick(["", menu()]))

    def footer() -> str:
        return wrap(pick([("<footer>", "</footer>"), named("div", "footer", "site-footer", "copyright", "bottom")]),
                    pick([f"&copy; {other()} &middot; {long_other()}", f"<p>{long_other()}</p>", links() + f"<p>{other()}</p>"]))

    def notice() -> str:
        return wrap(named(pick(["div", "section", "p"]), "cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup"),
                    pick([long_other(), f"<p>{long_other()}</p><button>{OTHER_MARK}ok</button>"]).replace("<p>", "").replace("</p>", ""))

    def advert() -> str:
        return wrap(named(pick(["div", "section", "aside", "p"]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"), long_other())

    def sidebar() -> str:
        return wrap(pick([("<aside>", "</aside>"), named("div", "sidebar", "related", "widget", "recommended", "rail")]),
                    f"<h3>{other(1, 4, 1)}</h3>" + pick([links(), f"<p>{long_other()}</p>"]))

    def form() -> str:
        return wrap(pick([("<form>", "</form>"), named("form", "newsletter", "search", "subscribe", "login")]),
                    f"<p>{long_other()}</p><label>{other(1, 3, 1)}</label><input type=text><button>{OTHER_MARK}send</button>")

    def comments() -> str:
        one = lambda: wrap(pick([("<p>", "</p>"), ("<li>", "</li>"), named("div", "comment", "reply")]), long_other())
        return wrap(pick([named("section", "comments", "discussion", "responses"), named("div", "comments", "comment-list", "replies"), named("ol", "comments")]),
                    pick(["", f"<h2>{other(1, 3, 1)}</h2>"]) + "".join(one() for _ in some(1, 4)))

    def share() -> str:
        return wrap(named("div", "share", "social", "tags", "toolbar"), links())

    def paragraph(low: int = 4, high: int = 40) -> str:
        text = main(low, high)
        text = pick([text, text, text, f"<b>{text}", f"<em>{text}</em>", text + "<br>" + words(2, 20), text + f' <a href="/x">{words(1, 4)}</a> ' + words(1, 9)])
        return pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text}<br>", f"<div>{text}</div>"])

    def body_part() -> str:
        kind = rnd.random()
        if kind < 0.72:
            return paragraph()
        if kind < 0.78:
            return f"<h2>{main(1, 8)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{main(1, 12)}</li>" for _ in some(1, 5)) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{paragraph()}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{main(1, 3)}</td><td>{main(1, 6)}</td></tr>" for _ in some(1, 3)) + "</table>"
        if kind < 0.93:
            return f"<figure><img src=x><figcaption>{main(2, 12)}</figcaption></figure>"
        if kind < 0.95:
            return f"<pre>{main(1, 20)}</pre>"
        return pick([advert, share, form, sidebar, notice])()

    def frame() -> tuple[str, str]:
        return pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                     named("div", "content", "post", "entry", "article-body", "story", "post-content"), named("section", "content", "article"),
                     ("<div>", "</div>")])

    def article() -> str:
        inner = pick([f"<h1>{main(1, 10)}</h1>", f"<h1>{main(1, 10)}</h1>", f"<h2>{main(1, 10)}</h2>", ""]) + "".join(body_part() for _ in some(1, 10))
        if MAIN_MARK not in inner:
            inner += paragraph()
        inner += pick(["", "", "", comments()])
        return wrap(frame(), inner)

    def short() -> str:
        """A page of little but a short text, of that alone, or of none."""
        least, most = pick([(1, 6), (2, 12), (4, 30)])
        text = "".join(pick([paragraph, paragraph, body_part])() if rnd.random() < 0.2 else paragraph(least, most) for _ in some(1, 3))
        if rnd.random() < 0.15:
            text = main(least, most)
        around = [f() if rnd.random() < 0.3 else "" for f in (header, menu, footer)]
        if rnd.random() < 0.1:
            return f"<html><body>{menu()}{pick([header, advert, notice])()}{footer()}</body></html>"
        begin = pick(["", "<html><body>", "<!DOCTYPE html><html><body>", f"<html><head><title>{other(2, 9, 1)}</title></head><body>"])
        return begin + "".join(around[:2]) + wrap(pick([frame(), ("", "")]), text) + around[2]

    pages = []
    for _ in range(n):
        if rnd.random() < 0.25:
            pages.append(short())
            continue
        top = [f for f in (header, menu, notice, advert, sidebar, form) if rnd.random() < 0.45]
        low = [f for f in (comments, sidebar, advert, form, menu, notice) if rnd.random() < 0.4]
        rnd.shuffle(top)
        rnd.shuffle(low)
        head = f"<head><title>{other(2, 9, 1)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{head}<body>" + "".join(f() for f in top) + article() + "".join(f() for f in low) + pick(["", footer(), footer()])
        pages.append(page + pick(["</body></html>", ""]))
    return pages


def main_text(model: Model, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, y in zip(blocks, decode(model, blocks)) if y)


def extract(pages: DataFrame, model: Model, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages with their main text in ``out_col`` and its code points in ``n_chars``; the html column goes."""
    own = [c for c in pages.columns if c.lower() not in (html_col.lower(), out_col.lower(), "n_chars")]
    source = next(c for c in map("page_{}".format, range(len(own) + 1)) if c not in {o.lower() for o in own})
    rows = pages.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{html_col}`").cast("string").alias(source))
    schema = StructType([f for f in rows.schema if f.name != source]).add(out_col, "string").add("n_chars", "long")
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(sent.value, page) for page in batch.column(source).to_pylist()]
        return pa.record_batch({c: batch.column(c) for c in own} | {out_col: pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return by_slices(rows, source, work, schema)
