"""Main text of web pages: a recurrent labeller over blocks.

A page is cut at its block tags into leaf blocks of text. A block is seen as the hashed names of the elements around it (tag,
class and id words), the hashed words of its text, and how long and how densely linked it is. A bidirectional LSTM in numpy
reads the blocks of the page in order and calls each of them main text or not, so that every block is judged in the context of
the whole page; long pages are read in runs that carry their states on. It is trained on a sample of about ``pages`` pages, drawn
by a hash of url and html, and of each at most ``stretch`` blocks in a row, of which each has at most ``chars`` characters. These
three bound what reaches the driver; every page is extracted whole. Labels of the sample come from markup
(text of an article that is in no menu, header, footer, aside, form, notice, advert or comment); copies of the pages with such
parts strewn in, or with other names for the same elements, are trained on as well.

Cases: null html is an empty page with an empty text; text outside elements is a block of the page's body; unclosed and
wrongly nested tags close where a block tag of their own kind, or the page, ends; scripts, styles, form controls and the page's head
hold no blocks; drawings and formulas are part of the block around them, and embedded elements hold blocks, up to their own end or
that of an element around them; a self-closed one is empty; a tag cut off at the end of the page is no text; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is part of the block around them.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style textarea title select".split())
#: Elements whose own tags, whatever they are called, are part of the block around them, until a tag of BREAKOUT.
FOREIGN = {"svg", "math"}
BREAKOUT = set("article aside blockquote body center dd div dl dt figure footer h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table ul".split())
#: Elements that hold blocks of their own but may lie within a paragraph, which goes on after them.
EMBEDDED = set("template noscript iframe object canvas".split())
#: Elements that a block tag of their own kind closes.
LEAVES = set("p li dt dd option tr td th h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = set("nav header footer aside form menu dialog button fieldset".split())
#: Words in a class or id that mark what is not the article.
BOILERPLATE_WORDS = set("ad ads advert advertisement banner sponsor promo nav navbar menu breadcrumb header footer sidebar aside cookie consent notice popup modal newsletter subscribe comment comments reply replies respond form search share social related widget login".split())
MAIN = {"article", "main"}
MAIN_WORDS = set("article content main post entry story body text".split())

#: Inside of a tag a quote means something only where a value begins; a value without quotes ends at white space or the tag's end.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z)", re.S)
_BARE_END = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class PageParams:
    pages: int = 400
    stretch: int = 96
    chars: int = 2000
    path_buckets: int = 1024
    word_buckets: int = 2048
    path_size: int = 12
    word_size: int = 4
    hidden: int = 12
    rounds: int = 400
    batch: int = 32
    length: int = 48
    rate: float = 0.01
    seed: int = 5


@dataclass
class Block:
    text: str
    #: Elements around it, outermost first: tag, then the words of its class and id.
    path: list[tuple[str, ...]]
    link_chars: int


def _names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in _NAMES.finditer(attributes):
        out += [w for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    if _HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = [0]

    def flush() -> None:
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                found.append(Block(whole, [e for e in stack if e[0] not in INLINE and (e[0] not in EMBEDDED or e[1:])], min(linked[0], len(whole))))
            text.clear()
            linked[0] = 0

    def say(part: str) -> None:
        if part and not any(e[0] == "head" for e in stack):
            text.append(part)
            if any(e[0] == "a" for e in stack):
                linked[0] += len(part.strip())

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        closed = (m[3] or "").endswith("/") and not _BARE_END.search(m[3])
        foreign = next((i for i, e in enumerate(stack) if e[0] in FOREIGN), None)
        if m[1]:
            known = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE and (foreign is None or known is not None and known < foreign or tag in BREAKOUT):
                flush()
            if known is not None:
                del stack[known:]
            continue
        if foreign is not None and tag in BREAKOUT:
            flush()
            del stack[foreign:]
        elif tag in FOREIGN or foreign is not None and (closed or tag not in RAW):
            if not closed and tag not in VOID:
                stack.append((tag, *_names(m[3] or "")))
            continue
        if tag in INLINE:
            if tag not in VOID:
                stack.append((tag, *_names(m[3] or "")))
            continue
        if foreign is None or tag not in RAW:
            flush()
        if tag == "body":  # the head ends here, closed or not
            stack = [e for e in stack if e[0] != "head"]
        if tag in VOID or closed and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        # A paragraph ends where another block begins; a list item, cell or heading where one of its kind does. Inline
        # elements left open within go with it.
        cut = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
        if cut is not None and (stack[cut][0] == "p" and tag not in EMBEDDED or stack[cut][0] == tag and tag in LEAVES):
            del stack[cut:]
        stack.append((tag, *_names(m[3] or "")))
    tail = page[at:]
    say(tail[: cut_off.start()] if (cut_off := re.search(r"<[a-zA-Z/!][^>]*\Z", tail)) else tail)
    flush()
    return found


def markup_label(path: list[tuple[str, ...]]) -> bool:
    """What a page's own markup says of a block: within an article, and in nothing that is not part of it."""
    inside = False
    for tag, *words in path:
        if tag in BOILERPLATE or "hidden" in words or BOILERPLATE_WORDS.intersection(words):
            return False
        inside = inside or tag in MAIN or bool(MAIN_WORDS.intersection(words))
    return inside


# -- features ---------------------------------------------------------------------------------------------------------


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


class Encoder:
    """Blocks as index lists and numbers; names and words are hashed once."""

    def __init__(self, params: PageParams):
        self.params = params
        self.paths: dict[tuple, list[int]] = {}

    def path(self, path: list[tuple[str, ...]]) -> list[int]:
        key = tuple(path)
        if (known := self.paths.get(key)) is None:
            n = self.params.path_buckets
            known = [_bucket(e[0], n) for e in path] + [_bucket("." + w, n) for e in path for w in e[1:]]
            if path:
                known.append(_bucket("last " + path[-1][0], n))
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[key] = known
        return known

    def words(self, text: str) -> list[int]:
        n = self.params.word_buckets
        return [hash_word(w) % n for w in text.lower().split()]

    @staticmethod
    def numbers(block: Block) -> list[float]:
        n = len(block.text)
        ends = block.text[-1] in ".!?…\"”»"
        return [min(n, 2000) ** 0.5 / 20, block.link_chars / n, float(ends), block.text.count(",") / n * 20]


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode())


@dataclass
class Labeller:
    """Embeddings of path and word buckets, an LSTM per direction (gates: input, forget, output, candidate), and the output."""

    path: np.ndarray
    word: np.ndarray
    inputs: np.ndarray
    own: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _mean(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(lists), table.shape[1]), dtype=np.float32)
    sizes = np.array([len(x) for x in lists])
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([np.array(lists[i], dtype=np.int64) for i in some])
        heads = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(table[flat], heads) / sizes[some][:, None]
    return out


def _sum(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    return _mean(table, lists) * sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, inputs: np.ndarray, own: np.ndarray, bias: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, list]:
    """States [T, B, H] over ``x`` [T, B, D]; where ``inside`` [T, B] is 0 the state stays as it is."""
    steps, width, _ = x.shape
    size = own.shape[0]
    h, c = np.zeros((width, size), dtype=np.float32), np.zeros((width, size), dtype=np.float32)
    out, kept = np.empty((steps, width, size), dtype=np.float32), []
    pre = x @ inputs + bias
    for t in range(steps):
        a = pre[t] + h @ own
        gates = _sigmoid(a[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(a[:, 3 * size :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        m = inside[t][:, None]
        kept.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        out[t] = h
    return out, kept


def _lstm_back(dout: np.ndarray, x: np.ndarray, kept: list, inputs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    dinputs, downs, dbias, dx = np.zeros_like(inputs), np.zeros_like(own), np.zeros(inputs.shape[1], dtype=np.float32), np.empty_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + dout[t]
        through, dcell = dh * m, dc * m
        dcell = dcell + through * o * (1 - tc * tc)
        da = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), through * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
        dinputs += x[t].T @ da
        downs += h.T @ da
        dbias += da.sum(0)
        dx[t] = da @ inputs.T
        dh, dc = da @ own.T + dh * (1 - m), dcell * f + dc * (1 - m)
    return dinputs, downs, dbias, dx


#: Steps of a run, and blocks (padding included) of pages that are read side by side.
RUN, CELLS = 1024, 1 << 16


def _logits(model: Labeller, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """[T, B] for ``x`` [T, B, D]. Nothing of a step is kept but its logit; gates are made for a run of steps at a time."""
    steps, width, _ = x.shape
    size = model.own.shape[1]
    out = np.full((steps, width), model.out_bias[0], dtype=np.float32)
    runs = [(at, min(at + RUN, steps)) for at in range(0, steps, RUN)]
    for way in (0, 1):
        inputs, own, bias, weight = model.inputs[way], model.own[way], model.bias[way], model.out[way * size : (way + 1) * size, 0]
        h, c = np.zeros((width, size), dtype=np.float32), np.zeros((width, size), dtype=np.float32)
        for a, b in runs[::-1] if way else runs:
            pre = x[a:b] @ inputs + bias
            for t in range(b - 1, a - 1, -1) if way else range(a, b):
                z = pre[t - a] + h @ own
                gates = _sigmoid(z[:, : 3 * size])
                c_new = gates[:, size : 2 * size] * c + gates[:, :size] * np.tanh(z[:, 3 * size :])
                m = inside[t][:, None]
                h, c = np.where(m, gates[:, 2 * size :] * np.tanh(c_new), h), np.where(m, c_new, c)
                out[t] += h @ weight
    return out


# -- training ---------------------------------------------------------------------------------------------------------

_RENAMED = [("article",), ("main",), ("div", "content"), ("div", "post", "entry"), ("section", "article", "body"), ("div", "story")]
_STREWN = [
    (("nav",), ("ul",), ("li",)), (("header",),), (("header",), ("h1",)), (("footer",), ("p",)), (("aside",), ("p",)), (("aside", "sidebar"), ("h3",)),
    (("div", "sidebar"), ("p",)), (("div", "ad"),), (("div", "advert"), ("p",)), (("div", "ads", "banner"),), (("div", "cookie", "banner"), ("p",)),
    (("div", "cookie", "notice"),), (("div", "notice"), ("p",)), (("form",), ("p",)), (("form", "newsletter"), ("div",)), (("form",), ("button",)),
    (("section", "comments"), ("p",)), (("div", "comments"), ("div", "comment"), ("p",)), (("ol", "comments"), ("li", "comment")), (("div", "comment"), ("p",)),
    (("section", "related"), ("ul",), ("li",)), (("div", "share"),), (("div", "menu"), ("ul",), ("li",)), (("div", "footer"), ("p",)), (("div", "header"),),
]


def _varied(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with its article under another name, and parts that are no article strewn between its blocks."""
    name = _RENAMED[rng.integers(len(_RENAMED))]
    other = [Block(b.text, [name if e[0] in MAIN else e for e in b.path], b.link_chars) for b in page]
    texts = [b.text for b in page]
    out: list[Block] = []
    for b in other:
        out.append(b)
        if rng.random() < 0.35:
            extra = _STREWN[rng.integers(len(_STREWN))]
            around = next((i for i, e in enumerate(b.path) if e == name), len(b.path) - 1)
            outside = b.path[: around + int(rng.random() < 0.5)]
            for _ in range(int(rng.integers(1, 4))):
                text = texts[rng.integers(len(texts))]
                out.append(Block(text, [*outside, *extra], len(text) if rng.random() < 0.2 else 0))
    return out


def train(pages: list[str], params: PageParams = PageParams()) -> Labeller | None:
    """A labeller from raw pages; None if there is no block to learn from."""
    return train_blocks([blocks(p) for p in pages], params)


def train_blocks(pages: list[list[Block]], params: PageParams = PageParams()) -> Labeller | None:
    cut = [p for p in pages if p]
    if not cut:
        return None
    rng = np.random.Generator(np.random.PCG64(params.seed))
    coder, size, width = Encoder(params), params.hidden, params.path_size + params.word_size + 4
    model = Labeller(
        rng.normal(0, 0.3, (params.path_buckets, params.path_size)).astype(np.float32), rng.normal(0, 0.1, (params.word_buckets, params.word_size)).astype(np.float32),
        rng.normal(0, 0.3, (2, width, 4 * size)).astype(np.float32), rng.normal(0, 0.2, (2, size, 4 * size)).astype(np.float32), np.zeros((2, 4 * size), dtype=np.float32),
        rng.normal(0, 0.3, (2 * size, 1)).astype(np.float32), np.zeros(1, dtype=np.float32),
    )
    params_of = vars(model)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params_of.items()}
    for step in range(1, params.rounds + 1):
        x = np.zeros((params.length, params.batch, width), dtype=np.float32)
        y, inside = np.zeros((params.length, params.batch), dtype=np.float32), np.zeros((params.length, params.batch), dtype=bool)
        lists: list[tuple[int, int, list[int], list[int]]] = []
        for b in range(params.batch):
            page = cut[rng.integers(len(cut))]
            page = _varied(page, rng) if rng.random() < 0.7 else page
            start = int(rng.integers(max(1, len(page) - params.length + 1)))
            for t, block in enumerate(page[start : start + params.length]):
                lists.append((t, b, coder.path(block.path), coder.words(block.text)[:200]))
                x[t, b, -4:] = coder.numbers(block)
                y[t, b], inside[t, b] = markup_label(block.path), True
        ts, bs = np.array([q[0] for q in lists]), np.array([q[1] for q in lists])
        x[ts, bs, : params.path_size] = _sum(model.path, [q[2] for q in lists])
        x[ts, bs, params.path_size : -4] = _mean(model.word, [q[3] for q in lists])
        ahead, kept_a = _lstm(x, model.inputs[0], model.own[0], model.bias[0], inside)
        behind, kept_b = _lstm(x[::-1], model.inputs[1], model.own[1], model.bias[1], inside[::-1])
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        error = (_sigmoid((both @ model.out + model.out_bias)[..., 0]) - y) * inside / max(1, inside.sum())
        dboth = error[..., None] * model.out[:, 0]
        one = _lstm_back(dboth[..., :size], x, kept_a, model.inputs[0], model.own[0])
        two = _lstm_back(dboth[::-1, :, size:], x[::-1], kept_b, model.inputs[1], model.own[1])
        dx = one[3] + two[3][::-1]
        grads = {
            "inputs": np.stack([one[0], two[0]]), "own": np.stack([one[1], two[1]]), "bias": np.stack([one[2], two[2]]),
            "out": np.einsum("tbh,tb->h", both, error)[:, None], "out_bias": np.array([error.sum()]), "path": np.zeros_like(model.path), "word": np.zeros_like(model.word),
        }
        for t, b, path, words in lists:
            np.add.at(grads["path"], path, dx[t, b, : params.path_size])
            if words:
                np.add.at(grads["word"], words, dx[t, b, params.path_size : -4] / len(words))
        rate = params.rate * min(1.0, 2 * (1 - step / (params.rounds + 1)))
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params_of[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# -- use --------------------------------------------------------------------------------------------------------------


def label(model: Labeller | None, pages: list[list[Block]], params: PageParams, coder: Encoder) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length run together; each is read whole."""
    out: list[np.ndarray] = [np.zeros(len(p), dtype=bool) for p in pages]
    if model is None:
        return out
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        # as many of the shortest as fit side by side, padded to the longest of them; a page is never cut
        n = 1
        while n < min(128, len(order)) and (n + 1) * len(pages[order[n]]) <= CELLS:
            n += 1
        some, order = order[:n], order[n:]
        steps = len(pages[some[-1]])
        x = np.zeros((steps, n, params.path_size + params.word_size + 4), dtype=np.float32)
        inside = np.zeros((steps, n), dtype=bool)
        for k, i in enumerate(some):
            for at in range(0, len(pages[i]), CELLS):
                part = pages[i][at : at + CELLS]
                rows = x[at : at + len(part), k]
                rows[:, : params.path_size] = _sum(model.path, [coder.path(b.path) for b in part])
                rows[:, params.path_size : -4] = _mean(model.word, [coder.words(b.text) for b in part])
                rows[:, -4:] = [coder.numbers(b) for b in part]
            inside[: len(pages[i]), k] = True
        found = _logits(model, x, inside)
        for k, i in enumerate(some):
            out[i] = found[: len(pages[i]), k] >= 0
    return out


def _stretch(page: str, params: PageParams) -> list[Block]:
    """Blocks of a page that are learned from: all of a short one, else some in a row from a place its content decides."""
    found = blocks(page)
    at = zlib.crc32(page[:1000].encode()) % (len(found) - params.stretch + 1) if len(found) > params.stretch else 0
    return [Block(b.text[: params.chars], b.path, min(b.link_chars, len(b.text), params.chars)) for b in found[at : at + params.stretch]]


def sample(pages: DataFrame, params: PageParams = PageParams()) -> list[list[Block]]:
    """Blocks of about ``params.pages`` pages, whatever their length: chosen and cut in the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[(b.text, b.path, b.link_chars) for b in _stretch(h, params)] for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(c) for c in cut], pa.string())], names=["blocks"])

    some = pages.select("url", "html").where(F.col("html").isNotNull())
    share = min(1.0, params.pages / max(1, some.count()))
    drawn = some.where(F.pmod(F.xxhash64("url", "html"), F.lit(1 << 30)) < int(share * (1 << 30))).select("html")
    rows = drawn.mapInArrow(run, "blocks string").collect()
    return sorted(([Block(t, [tuple(e) for e in path], n) for t, path, n in json.loads(r.blocks)] for r in rows), key=lambda p: [(b.text, b.path) for b in p])


def extract(pages: DataFrame, params: PageParams = PageParams(), model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train_blocks(sample(pages, params), params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(params)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cut = [blocks(h or "") for h in part["html"].to_pylist()]
                marks = label(shared.value, cut, params, coder)
                texts = [" ".join(b.text for b, m in zip(bs, ms, strict=True) if m) for bs, ms in zip(cut, marks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in cut], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_main long")
