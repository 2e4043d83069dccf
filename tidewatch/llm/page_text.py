"""Main text of web pages: a bidirectional LSTM labels every block of a page in the context of the whole page."""
from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Shape and training of the labeller."""
    paths: int = 1024         # cells for the tags, classes and ids of a block's ancestors
    words: int = 2048         # cells for a block's words
    path_size: int = 16       # numbers that a path, and the words, are turned into
    word_size: int = 8
    hidden: int = 12          # units per direction
    ancestors: int = 16       # nearest ancestors that count
    sample: int = 240         # pages that training sees at most, about
    blocks: int = 48          # blocks in a row that training sees of a page
    batch: int = 32
    steps: int = 400
    rate: float = 0.02
    unseen: float = 0.8       # share of blocks whose words training hides, so that no sentence is learned by heart
    seed: int = 3


# HTML elements by their role in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title template noscript svg math iframe object select textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr br".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div main aside nav header footer body form".split())
# Elements, and words of class and id names, that mark what is no article.
AROUND_TAGS = frozenset("nav header footer aside form button dialog menu".split())
AROUND_WORDS = frozenset("nav menu navbar breadcrumb breadcrumbs header masthead footer foot sidebar aside widget related ad ads advert banner promo sponsor "
                         "cookie consent notice alert popup modal newsletter subscribe share social login form search comment comments reply replies "
                         "disqus pagination toolbar".split())
ARTICLE_WORDS = frozenset("article content main post entry story body text".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int


def blocks_of(page: str | None, ancestors: int = 16) -> list[Block]:
    """The page's text blocks in order: text between block elements, white space as one space, character references decoded.

    Inline elements do not part a block, a line break is white space. Scripts, styles, comments, titles and the like hold no text.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    held: list[str] = []
    linked = at = 0
    path: list[str] = []

    def flush():
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, path, linked))
        held, linked = [], 0

    def say(chunk: str):
        nonlocal path, linked
        if not chunk:
            return
        said = entities.unescape(chunk) if "&" in chunk else chunk
        if not held or not path:
            path = ["root"] + [n for _, names in stack[-ancestors:] for n in names]
        held.append(said)
        if any(t == "a" for t, _ in stack[-4:]):
            linked += len(said)

    n = len(page)
    while at < n:
        found = MARKUP.search(page, at)
        if not found:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, rest = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in SILENT and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        names = [name]
        if rest:
            for a in NAMES.findall(rest):
                names += [f".{w}" for w in WORD.findall("".join(a).lower())]
        stack.append((name, names))
    flush()
    return out


def marked(block: Block) -> float | None:
    """What the markup itself says of a block: 1 article, 0 around it, None where it is silent. Used for training only."""
    names = block.path[1:]
    if any(n in AROUND_TAGS or (n[0] == "." and n[1:] in AROUND_WORDS) for n in names):
        return 0.0
    if "article" in names or "main" in names or any(n[0] == "." and n[1:] in ARTICLE_WORDS for n in names):
        return 1.0
    return None


def _cells(names: list[str], n: int) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % n for x in names]


@dataclass
class Inputs:
    """Blocks of pages, one after the other: cells with the block they belong to, and a few plain numbers per block."""
    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    plain: np.ndarray
    sizes: np.ndarray


def inputs(pages: list[list[Block]], settings: Settings) -> Inputs:
    from tidewatch.llm.line_dedup import words_of

    blocks = [b for p in pages for b in p]
    cells = [_cells(b.path, settings.paths) for b in blocks]
    hashes, owner = words_of("\n".join(b.text for b in blocks).encode("utf-8", "surrogatepass"))
    sizes = np.array([len(p) for p in pages], np.int64)
    place = np.concatenate([np.linspace(0, 1, n) for n in sizes]) if len(blocks) else np.zeros(0)
    length = np.array([len(b.text) for b in blocks], float)
    share = np.array([b.linked for b in blocks], float) / np.maximum(length, 1)
    stops = np.array([sum(map(b.text.count, ".!?,;")) for b in blocks], float)
    plain = np.stack([np.log1p(length) / 6, np.minimum(share, 1), np.log1p(stops) / 4, place], 1) if len(blocks) else np.zeros((0, 4))
    return Inputs(np.array([c for cs in cells for c in cs], np.int64), np.repeat(np.arange(len(blocks)), [len(c) for c in cells]),
                  (hashes % np.uint64(settings.words)).astype(np.int64), owner.astype(np.int64), plain.astype(np.float32), sizes)


def _bag(table: np.ndarray, cell: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the cells' vectors over the root of their number, for each block, and each cell's share in it."""
    counts = np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))
    flat = np.bincount(of[:, None].repeat(table.shape[1], 1).ravel() * table.shape[1] + np.tile(np.arange(table.shape[1]), len(of)),
                       table[cell].ravel(), n * table.shape[1]) if len(of) else np.zeros(n * table.shape[1])
    return (flat.reshape(n, -1) / counts[:, None]).astype(np.float32), (1 / counts).astype(np.float32)


@dataclass
class Labeller:
    path: np.ndarray     # cells x path_size
    word: np.ndarray     # cells x word_size
    into: np.ndarray     # 2 x D x 4H
    recur: np.ndarray    # 2 x H x 4H
    bias: np.ndarray     # 2 x 4H
    out: np.ndarray      # 2H + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(net: Labeller, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of both directions for padded pages x (B x T x D): 2 x T x B x H. A masked step leaves the state as it is."""
    b, t, _ = x.shape
    h = net.recur.shape[1]
    pre = np.stack([np.einsum("btd,dk->tbk", x, net.into[i], optimize=True) + net.bias[i] for i in (0, 1)])
    state, cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    states, saved = np.zeros((2, t, b, h), np.float32), []
    for k in range(t):
        z = np.stack([pre[0, k], pre[1, t - 1 - k]]) + np.matmul(state, net.recur)
        m = np.stack([mask[:, k], mask[:, t - 1 - k]])[:, :, None]
        i, f, o, g = _sigmoid(z[..., :h]), _sigmoid(z[..., h:2 * h]), _sigmoid(z[..., 2 * h:3 * h]), np.tanh(z[..., 3 * h:])
        new = f * cell + i * g
        squashed = np.tanh(new)
        if keep:
            saved.append((state, cell, i, f, o, g, squashed, m))
        state, cell = m * (o * squashed) + (1 - m) * state, m * new + (1 - m) * cell
        states[0, k], states[1, t - 1 - k] = state[0], state[1]
    return states, saved


def _padded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks as pages x positions, a mask, and each block's place."""
    t = int(sizes.max())
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((len(sizes), t, values.shape[1]), np.float32)
    x[page, place] = values
    mask = np.zeros((len(sizes), t), np.float32)
    mask[page, place] = 1
    return x, mask, page * t + place


def label(net: Labeller, data: Inputs) -> np.ndarray:
    """Probability of each block to belong to the article. Pages of like length are read together, each as a whole."""
    n = int(data.sizes.sum())
    values = np.concatenate([_bag(net.path, data.path, data.path_of, n)[0], _bag(net.word, data.word, data.word_of, n)[0], data.plain], 1)
    first = np.cumsum(data.sizes) - data.sizes
    out = np.zeros(n)
    order = np.argsort(data.sizes, kind="stable")
    order = order[data.sizes[order] > 0]
    for pages in np.array_split(order, max(1, len(order) // 256)) if len(order) else []:
        rows = np.concatenate([np.arange(first[p], first[p] + data.sizes[p]) for p in pages])
        x, mask, at = _padded(values[rows], data.sizes[pages])
        states, _ = _lstm(net, x, mask)
        z = states[0] @ net.out[:net.recur.shape[1]] + states[1] @ net.out[net.recur.shape[1]:-1] + net.out[-1]
        out[rows] = _sigmoid(z.T.ravel()[at])
    return out


def train(pages: list[list[Block]], labels: list[np.ndarray], settings: Settings) -> Labeller:
    """Fits the labeller by backpropagation through time; labels are 1, 0 or NaN (no say) per block."""
    rng = np.random.default_rng(settings.seed)
    h, d = settings.hidden, settings.path_size + settings.word_size + 4
    make = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    net = Labeller(make(settings.paths, settings.path_size), make(settings.words, settings.word_size) * 0.2, make(2, d, 4 * h), make(2, h, 4 * h),
                   np.zeros((2, 4 * h), np.float32), make(2 * h + 1))
    net.bias[:, h:2 * h] = 1
    weights = [net.path, net.word, net.into, net.recur, net.bias, net.out]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, settings.steps + 1):
        cut, y = [], []
        for p in rng.choice(len(pages), min(settings.batch, len(pages)), replace=False):
            start = int(rng.integers(0, max(1, len(pages[p]) - settings.blocks + 1)))
            cut.append(pages[p][start:start + settings.blocks])
            y.append(labels[p][start:start + settings.blocks])
        data, y = inputs(cut, settings), np.concatenate(y)
        n = len(y)
        one, one_share = _bag(net.path, data.path, data.path_of, n)
        two, two_share = _bag(net.word, data.word, data.word_of, n)
        two_share = two_share * (rng.random(n) >= settings.unseen)
        two *= (two_share > 0)[:, None]
        x, mask, at = _padded(np.concatenate([one, two, data.plain], 1), data.sizes)
        states, saved = _lstm(net, x, mask, keep=True)
        z = (states[0] @ net.out[:h] + states[1] @ net.out[h:-1] + net.out[-1]).T.ravel()[at]
        known = ~np.isnan(y)
        dz = np.where(known, _sigmoid(z) - np.nan_to_num(y), 0) / max(known.sum(), 1)
        b, t = mask.shape
        full = np.zeros(b * t, np.float32)
        full[at] = dz
        full = full.reshape(b, t).T
        g_out = np.concatenate([np.einsum("tb,tbh->h", full, states[0]), np.einsum("tb,tbh->h", full, states[1]), [full.sum()]]).astype(np.float32)
        d_states = np.stack([full[:, :, None] * net.out[:h], full[:, :, None] * net.out[h:-1]])
        g_into, g_recur, g_bias, dx = np.zeros_like(net.into), np.zeros_like(net.recur), np.zeros_like(net.bias), np.zeros_like(x)
        carry, carry_cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        for k in range(t - 1, -1, -1):
            state, cell, i, f, o, g, squashed, m = saved[k]
            carry = carry + np.stack([d_states[0, k], d_states[1, t - 1 - k]])
            d_new = m * (carry_cell + carry * o * (1 - squashed * squashed))
            d_o = m * carry * squashed
            gates = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - g * g)], 2)
            g_recur += np.matmul(state.transpose(0, 2, 1), gates)
            g_bias += gates.sum(axis=1)
            for w, place in enumerate((k, t - 1 - k)):
                g_into[w] += x[:, place].T @ gates[w]
                dx[:, place] += gates[w] @ net.into[w].T
            carry_cell = d_new * f + (1 - m) * carry_cell
            carry = np.matmul(gates, net.recur.transpose(0, 2, 1)) + (1 - m) * carry
        flat = dx.reshape(b * t, -1)[at]
        g_path, g_word = np.zeros_like(net.path), np.zeros_like(net.word)
        np.add.at(g_path, data.path, (flat[:, :settings.path_size] * one_share[:, None])[data.path_of])
        np.add.at(g_word, data.word, (flat[:, settings.path_size:-4] * two_share[:, None])[data.word_of])
        grads = [g_path, g_word, g_into, g_recur, g_bias, g_out]
        rate = settings.rate * (1 - 0.9 * step / settings.steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        net.word *= 0.998
        for w, g, (m1, m2) in zip(weights, grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            w -= (rate * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
    return net


#: Ways to mark up an article and what lies around it, for rendering sampled pages anew: ancestors from the outside.
ARTICLE_FRAMES = [["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".main", "div", ".post"], ["div", ".entry", ".content"],
                  ["section", ".story", ".body"], ["div", ".article", ".text"], ["div"], ["div", "div"]]
AROUND_FRAMES = [["nav", "ul", "li"], ["div", ".menu", "ul", "li"], ["header"], ["div", ".header"], ["footer"], ["div", ".footer"], ["aside"],
                 ["div", ".sidebar"], ["div", ".ad"], ["div", ".banner"], ["div", ".cookie", ".notice"], ["div", ".alert"], ["form"], ["form", "label"],
                 ["div", ".comments", "div", ".comment"], ["section", ".comments", "ul", "li"], ["div", ".related", "ul", "li"], ["div", ".share"],
                 ["div", ".newsletter"], ["div", ".breadcrumb"], ["div", ".widget"], ["article", "aside"], ["article", "div", ".ad"], ["article", "footer"],
                 ["main", "form"], ["main", "section", ".comments", "p"], ["article", "div", ".comments", "p"]]


#: Elements that a block around the article may have within its frame.
INNER = [[], ["p"], ["p"], ["div"], ["ul", "li"], ["h3"], ["span"], ["div", "p"]]


def rendered_anew(page: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page's own texts under another markup: what is known to be article or around it keeps its label."""
    frame = ARTICLE_FRAMES[rng.integers(len(ARTICLE_FRAMES))]
    rest = [AROUND_FRAMES[k] for k in rng.choice(len(AROUND_FRAMES), 3)]
    blocks, said = [], []
    around = [b for b, y in zip(page, labels) if y == 0]
    extra = lambda: [(b, 0.0) for b in rng.permutation(np.array(around, object))[:rng.integers(0, 4)]] if around else []
    sequence = extra() + list(zip(page, labels)) + extra()
    for k, (b, y) in enumerate(sequence):
        if y == 1:
            inner = "h1" if not blocks else "p"
            blocks.append(Block(b.text, ["root", "html", "body", *frame, inner], 0))
        else:
            at = [*rest[min(2, 3 * k // max(1, len(sequence)))], *INNER[rng.integers(len(INNER))]]
            blocks.append(Block(b.text, ["root", "html", "body", *at], b.linked if "li" in at else 0))
        said.append(y)
    return blocks, np.array(said, float)


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", settings: Settings = Settings()) -> Labeller | None:
    """A labeller trained on a bounded sample of the pages, drawn by a hash of the id; None where no page has text.

    Labels come from markup that speaks for itself (`marked`); half of training shows the sampled texts under other markup
    (`rendered_anew`), so the labeller learns from context and words where names are silent.
    """
    total = pages.where(F.length(html_col) > 0).count()
    if not total:
        return None
    rate = min(1.0, settings.sample / total)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(settings.seed)), F.lit(1_000_000)) < rate * 1_000_000
    drawn = pages.where(draw & (F.length(html_col) > 0)).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    rows = sorted(drawn.collect(), key=lambda r: (str(r["id"]), r["html"])) or pages.where(F.length(html_col) > 0).select(F.col(html_col).alias("html")).limit(1).collect()
    seen = [b for b in (blocks_of(r["html"], settings.ancestors) for r in rows) if b]
    if not seen:
        return None
    labels = [np.array([np.nan if (m := marked(b)) is None else m for b in p]) for p in seen]
    rng = np.random.default_rng(settings.seed)
    again = [rendered_anew(p, y, rng) for p, y in zip(seen, labels) for _ in range(2)]
    return train([*seen, *(p for p, _ in again)], [*labels, *(y for _, y in again)], settings)


def extract(pages: DataFrame, net: Labeller | None, html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """Adds `text` and `n_chars` to every row; existing columns of these names are replaced.

    The whole page is taken apart and every block labelled in the page's context; blocks of the article are joined in page order by
    line feeds. A null or empty page, or one without a block of the article, has empty text.
    """
    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            texts: list[str] = []
            for at in range(0, len(html), 512):
                found = [blocks_of(p, settings.ancestors) for p in html.iloc[at:at + 512]]
                if net is None or not any(found):
                    texts += [""] * len(found)
                    continue
                keep = label(net, inputs(found, settings)) >= 0.5
                first = 0
                for p in found:
                    texts.append("\n".join(b.text for b, k in zip(p, keep[first:first + len(p)]) if k))
                    first += len(p)
            yield pd.Series(texts)

    out = pages.drop("text", "n_chars").withColumn("text", main_text(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
