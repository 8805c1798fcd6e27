"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its ancestors
(tags, words of class, id and role) and of its text; the field labels the whole sequence of blocks as main text or
not, and Viterbi's path decides. It is trained on labelled pages that ``labelled_pages`` composes: articles
in many containers, between menus, notices, adverts, forms and comments, all labelled as they are made.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bookflow.llm.common import free_name

PAGES, EPOCHS, RATE, SEED = 500, 6, 0.3, 11      # of the training

# What HTML says of its elements.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
                   "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes template".split())    # no text of the page
INERT = frozenset("iframe noembed noframes template".split())                    # of these a start tag without an end is passed over
PLAIN = frozenset("title textarea".split())       # text without tags inside
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
                       "pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = BLOCKS - frozenset("body head html button caption option optgroup tbody td tfoot th thead tr".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div aside nav header footer main body td th select form".split())
TELLING = frozenset("article main aside nav header footer form".split())
LETTER, SPACES = re.compile(r"[^\W\d_]"), re.compile(r"\s+")
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
                 r"(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?P<close>>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True, eq=False)
class Place:
    """An element with its ancestors; what it adds to theirs, so that a page's cost doesn't grow with its depth."""
    parent: Place | None
    tag: str
    words: frozenset[str]                # of class, id and role
    new: tuple[str, ...]                 # features of the path that no ancestor has
    told: Place | None                   # the innermost container that says something of its content


@dataclass(slots=True)
class Block:
    text: str
    path: Place | None                   # the innermost open element
    linked: int           # characters inside links
    label: int = 0


def _words(rest: str) -> frozenset[str]:
    found = set()
    for m in ATTRIBUTE.finditer(rest):
        found.update(PARTS.findall(CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()))
    return frozenset(found)


def _drawings(page: str) -> dict[int, int]:
    """Of every svg with an end of its own: where its start tag ends, and where it ends. HTML's tags leave an open svg."""
    found, opened = {}, []               # opened: (name, end of the start tag)
    for m in TAG.finditer(page):
        name = (m["name"] or "").lower()
        if name == "foreignobject" and m["end"]:
            if opened and opened[-1][0] == name:
                opened.pop()
        elif name == "svg" and m["end"]:
            while opened:
                last, start = opened.pop()
                if last == "svg":
                    found[start] = m.end()
                    break
        elif name in ("svg", "foreignobject"):
            if not m["rest"].rstrip().endswith("/") and (name == "svg" or opened):
                opened.append((name, m.end()))
        elif name in LEAVES_SVG and not m["end"] and opened and opened[-1][0] == "svg":
            opened.clear()
    return found


def leaf_blocks(page: str | None) -> list[Block]:
    """Runs of text between block-level tags in page order; references decoded, white space runs as one space."""
    page = page or ""
    blocks: list[Block] = []
    path: list[Place] = []
    opened: Counter = Counter()          # open elements by tag, and open features of the path
    ends: dict[str, bool] = {}           # whether an end tag of the name is still to come
    buffer: list[tuple[str, bool]] = []
    links = 0
    drawings: dict[int, int] | None = None

    def flush() -> None:
        if buffer:
            text = SPACES.sub(" ", "".join(t for t, _ in buffer)).strip()
            if text:
                blocks.append(Block(text, path[-1] if path else None, sum(len(t) for t, linked in buffer if linked)))
            buffer.clear()

    def features_of(tag: str, words: frozenset[str]) -> list[str]:
        return [*([] if tag in ("html", "body") else [f"in={tag}"]), *(f"word={w}" for w in sorted(words))]

    def push(tag: str, words: frozenset[str]) -> None:
        own, parent = features_of(tag, words), path[-1] if path else None
        node = Place(parent, tag, words, tuple(x for x in own if not opened[x]), parent.told if parent else None)
        if tag in TELLING or words and tag in ("div", "section"):
            node.told = node
        path.append(node)
        opened.update([tag, *own])

    def close(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(path) - 1, -1, -1):
            if path[k].tag in names:
                for node in path[k:]:
                    opened.subtract([node.tag, *features_of(node.tag, node.words)])
                del path[k:]
                return
            if path[k].tag in stop:
                return

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            buffer.append((html.unescape(text), links > 0))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            continue
        name = (m["name"] or "").lower()
        if not name or not m["close"]:           # a comment, or a tag that the page's end cuts off
            continue
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                flush()
                close({name})
            continue
        if name == "svg":
            drawings = _drawings(page) if drawings is None else drawings
            at = drawings.get(at, at)            # without an end of its own its text is the page's
            continue
        if name in RAW or name in PLAIN:
            if ends.get(name, True):                 # looked for once more only while there was one
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                ends[name] = end is not None
                at = end.end() if end else at if name in INERT else len(page)
            elif name not in INERT:
                at = len(page)
            continue
        if name == "br":
            buffer.append((" ", False))
        elif name == "a":
            links = 1                            # links don't nest
        elif name in BLOCKS:
            flush()
            if name in CLOSES_P:
                close({"p"}, SCOPES)
            if name in IMPLIED:
                close(IMPLIED[name], SCOPES - {"td", "th"} if name == "tr" else SCOPES)
            if name not in VOID:
                push(name, _words(m["rest"]))
    flush()
    return blocks


def ancestors(place: Place | None) -> Iterator[Place]:
    while place is not None:
        yield place
        place = place.parent


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block apart from those that its path gives to all blocks below it."""
    out = []
    for k, b in enumerate(blocks):
        tag = b.path.tag if b.path and b.path.tag not in ("html", "body") else ""
        inner = next((x.tag for x in ancestors(b.path) if x.tag not in ("html", "body")), "") if b.path and not tag else tag
        names = {"bias", f"tag={inner}"} | {f"last={w}" for w in (b.path.words if b.path else ())}
        if b.path and b.path.told:
            names |= {f"inner={b.path.told.tag}"} | {f"inner={w}" for w in b.path.told.words}
        n, words = len(b.text), b.text.count(" ") + 1
        names.add(f"length={min(6, (n // 20).bit_length())}")
        names.add(f"links={round(4 * min(1, b.linked / max(1, n)))}")
        names.add(f"stops={min(3, sum(map(b.text.count, '.!?;:')))}")
        names.add("ends" if b.text[-1] in ".!?:\"”»" else "open")
        names.add(f"words={min(5, words.bit_length())}")
        if not LETTER.search(b.text):
            names.add("letterless")
        if "©" in b.text or "·" in b.text:
            names.add("marks")
        if k == 0:
            names.add("first")
        if k == len(blocks) - 1:
            names.add("final")
        out.append(sorted(names))
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of all features that hold for each block (of training pages, which are shallow)."""
    return [sorted({*own, *(x for a in ancestors(b.path) for x in a.new)}) for b, own in zip(blocks, own_features(blocks), strict=True)]


class Field:
    """A chain of two labels: weights of (feature, label), of label pairs, and of the first label."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.emit = np.zeros((0, 2))
        self.step = np.zeros((2, 2))

    def _ids(self, names: list[list[str]], grow: bool) -> list[np.ndarray]:
        if grow:
            for own in names:
                for x in own:
                    self.number.setdefault(x, len(self.number))
        return [np.array([self.number[x] for x in own if x in self.number], np.int64) for own in names]

    def _emissions(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[own].sum(0) for own in ids]).reshape(-1, 2)

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Field:
        """Stochastic ascent of the labels' log likelihood (forward-backward), steps scaled by past gradients."""
        data = [(self._ids(names, True), np.array(labels)) for names, labels in pages if labels]
        self.emit = np.zeros((len(self.number), 2))
        seen, seen_step = np.full_like(self.emit, 1e-2), np.full_like(self.step, 1e-2)
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(data)
            for ids, y in data:
                e = self._emissions(ids)
                n = len(y)
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = e[0]
                for k in range(1, n):
                    forward[k] = e[k] + np.logaddexp(forward[k - 1, 0] + self.step[0], forward[k - 1, 1] + self.step[1])
                for k in range(n - 2, -1, -1):
                    x = e[k + 1] + backward[k + 1]
                    backward[k] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
                total = np.logaddexp(*forward[-1])
                p = np.exp(forward + backward - total)
                g = -p
                g[np.arange(n), y] += 1
                sizes = [len(own) for own in ids]
                flat, grads = np.concatenate(ids), np.repeat(g, sizes, axis=0)
                step = np.zeros((len(self.number), 2))
                np.add.at(step, flat, grads)
                touched = np.unique(flat)
                d = step[touched] - 1e-3 * self.emit[touched]
                seen[touched] += d * d
                self.emit[touched] += rate * d / np.sqrt(seen[touched])
                pairs = np.zeros((2, 2))
                for k in range(1, n):
                    pairs[y[k - 1], y[k]] += 1
                    pairs -= np.exp(forward[k - 1][:, None] + self.step + (e[k] + backward[k])[None, :] - total)
                seen_step += pairs * pairs
                self.step += rate * pairs / np.sqrt(seen_step)
        return self

    def page_emissions(self, blocks: list[Block]) -> np.ndarray:
        """As of all features of each block; those of a path are added up once for each element."""
        weight, known = (lambda names: self.emit[[self.number[x] for x in names if x in self.number]].sum(0)), {None: np.zeros(2)}
        for b in blocks:
            missing = []
            for a in ancestors(b.path):
                if a in known:
                    break
                missing.append(a)
            for a in reversed(missing):
                known[a] = known[a.parent] + weight(a.new) if a.new else known[a.parent]
        return np.array([known[b.path] + weight(own) for b, own in zip(blocks, own_features(blocks), strict=True)]).reshape(-1, 2)

    def viterbi(self, names: list[list[str]]) -> list[int]:
        return self.best_path(self._emissions(self._ids(names, False)))

    def best_path(self, emissions: np.ndarray) -> list[int]:
        if not len(emissions):
            return []
        e = emissions.tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = e[0][0], e[0][1], []
        for x, y in e[1:]:
            back.append((0 if a + s00 >= b + s10 else 1, 0 if a + s01 >= b + s11 else 1))
            a, b = x + max(a + s00, b + s10), y + max(a + s01, b + s11)
        out = [0 if a >= b else 1]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[int]]]:
    """Composed pages with the label of each of their leaf blocks (1: main text)."""
    r = random.Random(seed)
    vowels, consonants = "aeiouy", "bcdfghklmnprstvwz"

    def word() -> str:
        return "".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.randint(1, 3)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + r.choice("....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return r.choice([" ", " ", "\n"]).join(sentence() for _ in range(r.randint(low, high)))

    def phrase() -> str:
        return " ".join(word() for _ in range(r.randint(1, 4)))

    def link() -> str:
        return f'<a href="/{word()}">{phrase()}</a>'

    def box(names: str, tags: str = "div div section aside") -> tuple[str, str]:
        tag, name = r.choice(tags.split()), r.choice(names.split())
        kind = r.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{r.choice(["", "", "site-", "page-", "js-"])}{name}{r.choice(["", "", "-box", "-area", " wide"])}">', f"</{tag}>"

    def menu() -> tuple[str, int]:
        k = r.randint(2, 9)
        a, z = r.choice([("<nav>", "</nav>"), box("menu nav navigation navbar breadcrumbs topbar"), ('<div role="navigation">', "</div>")])
        return f"{a}<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + f"</ul>{z}", k

    def note(names: str, tags: str = "div div section aside") -> tuple[str, int]:
        a, z = box(names, tags)
        k = r.randint(1, 3)
        if r.random() < 0.4:
            return f"{a}{prose(1, 2)}{z}", 1
        return a + "".join(r.choice([f"<p>{prose(1, 2)}</p>", f"<p>{link()}</p>", f"<h3>{phrase()}</h3>"]) for _ in range(k)) + z, k

    def form() -> tuple[str, int]:
        a, z = r.choice([("<form>", "</form>"), ('<form class="newsletter signup">', "</form>"), ('<form class="search">', "</form>")])
        return f"{a}<p>{sentence()}</p><label>{phrase()}</label> <input type=text><button>{word()}</button>{z}", 3

    def comments() -> tuple[str, int]:
        a, z = box("comments comment-list responses discussion disqus replies", "div section ol")
        k = r.randint(1, 5)
        one = r.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<div class="reply">{}</div>', '<li class="comment">{}</li>',
                        '<article class="comment"><p>{}</p></article>'])
        head = r.random() < 0.5
        return a + (f"<h3>{phrase()}</h3>" if head else "") + "".join(one.format(prose(1, 3)) for _ in range(k)) + z, k + head

    def footer() -> tuple[str, int]:
        a, z = r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), box("footer copyright colophon bottom", "div section")])
        return f"{a}&copy; {word()}.example &middot; {prose(1, 2)}{z}", 1

    def header() -> tuple[str, int]:
        a, z = r.choice([("<header>", "</header>"), box("header masthead banner branding", "div header")])
        return f"{a}<h2>{phrase()}</h2><p>{phrase()}</p>{z}", 2

    def clutter() -> tuple[str, int]:
        return r.choice([menu, form, lambda: note("ad ads advert advertisement banner sponsor sponsored promo promotion"),
                         lambda: note("sidebar related widget recommended popular trending teaser more", "aside aside div section"),
                         lambda: note("cookie consent notice gdpr alert popup modal privacy subscribe newsletter paywall"),
                         lambda: note("share social meta byline tags author toolbar", "div ul p")])()

    def body() -> tuple[str, list[int]]:
        parts, labels = [], []
        if r.random() < 0.8:
            title = prose(1, 2)[:60]
            parts.append(f"<h1>{title}</h1>")
            labels.append(1)
        for _ in range(r.randint(1, 9)):
            roll = r.random()
            if roll < 0.75:
                text = prose(1, 7) if r.random() < 0.8 else sentence(1, 5)
                text = r.choice(["{}", "{}", "{}", "<b>{}<br>", "<b>{}</b>", "<em>{}</em> " + phrase()]).format(text)
                parts.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div><p>{text}</p></div>"]))
                labels.append(1)
            elif roll < 0.82:
                parts.append(f"<h2>{phrase()}</h2>")
                labels.append(1)
            elif roll < 0.9:
                k = r.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{sentence(2, 10)}</li>" for _ in range(k)) + "</ul>")
                labels += [1] * k
            elif roll < 0.94:
                parts.append(f"<blockquote>{prose(1, 2)}</blockquote>")
                labels.append(1)
            else:
                x, k = clutter()
                parts.append(x)
                labels += [0] * k
        return "".join(parts), labels

    for _ in range(n):
        parts, labels = [f"<title>{phrase()}</title><style>p{{margin:0}}</style><body>"], []
        for make, chance in ((header, 0.4), (menu, 0.8), (clutter, 0.7), (clutter, 0.2)):
            if r.random() < chance:
                x, k = make()
                parts.append(x)
                labels += [0] * k
        a, z = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                         ('<div role="main">', "</div>"), box("content post entry article story text body main", "div div section")])
        x, own = body()
        parts.append(a + x)
        labels += own
        inside = r.random() < 0.3
        parts += [] if inside else [z]
        for make, chance in ((comments, 0.4), (clutter, 0.3)):
            if r.random() < chance:
                x, k = make()
                parts.append(x)
                labels += [0] * k
        parts += [z] if inside else []
        for make, chance in ((clutter, 0.3), (footer, 0.9)):
            if r.random() < chance:
                x, k = make()
                parts.append(x)
                labels += [0] * k
        yield "".join(parts), labels


def train(n: int = PAGES, seed: int = SEED) -> Field:
    """The field, learned from composed pages; pages whose blocks don't match their labels are an error."""
    data = []
    for page, labels in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a composed page has other blocks than labels")
        data.append((block_features(blocks), labels))
    return Field().train(data)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.best_path(field.page_emissions(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field, html: str = "html", text: str = "text", n_chars: str = "n_chars",
            keep: list[str] | None = None) -> DataFrame:
    """Add the main text of every whole page and its number of code points.

    Null and empty pages, and pages without main text, have the empty text. ``keep`` names the columns to keep (default:
    all); of clashing names the new ones win. Pages don't depend on each other: repeated rows come out repeated, an
    empty table stays empty.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in (text.lower(), n_chars.lower())]
    src = free_name(pages, "_html")[0]
    rows = pages.select(pages[html].alias(src), *[pages[c] for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(src).schema), f"`{text}` string, `{n_chars}` bigint"])
    return rows.mapInArrow(_extract_batches(field, text, n_chars), schema)


def _extract_batches(field: Field, text: str, n_chars: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p, field) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                                             [*b.schema.names[1:], text, n_chars])
    return run
