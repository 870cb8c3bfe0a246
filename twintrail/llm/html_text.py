"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages of the table that the field is trained on, at most, and characters of each.
MAX_TRAINING_PAGES, MAX_TRAINING_CHARS = 150, 100_000
#: Pages written for training, in layouts with class names instead of meaningful tags.
WRITTEN_PAGES = 260
EPOCHS, RATE, L2, SEED = 12, 0.5, 1e-3, 11

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements whose content is not text, elements that never have content, elements
# that make blocks, and those that the start of another block closes. Formulas (math) are part of the line.
RAW = frozenset("script style iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """html head title body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th
    blockquote pre figure figcaption form fieldset legend label button details summary address hr dialog menu option center
    select template noscript object svg text""".split()
)
#: Blocks that say nothing of what is in them: the elements around them do. They may close themselves.
NEUTRAL = frozenset("select template noscript object svg text".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th option thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    """A leaf block: its text, the block elements around it from the outside in, class and id words of these, characters in links."""

    text: str
    path: tuple[str, ...]
    names: frozenset[str]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("hidden", "aria-hidden"):
            found += ["hidden"] if "false" not in values else []
        else:
            found += [w.lower() for w in NAME_PART.findall("".join(values))]
    return tuple(found)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order. Broken markup is read as far as it makes sense."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, tuple(t for t, _ in stack), frozenset(w for _, ws in stack for w in ws), linked))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    endless: set[str] = set()  # elements that nothing ends from here on
    while at < size:
        match = TAG.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            said = page[at:stop]
            parts.append(said)
            if links:
                linked += len(said)
        if match is None:
            break
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            if match[3].rstrip().endswith("/"):
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            flush()
            if tag in NEUTRAL:
                if not (match[3] or "").rstrip().endswith("/"):
                    stack.append((tag, _names(match[3]) if match[3] else ()))
                continue
            while stack and stack[-1][0] in CLOSED_BY_BLOCK:
                stack.pop()
            if tag in CLOSED_BY_SAME and stack and stack[-1][0] == tag:
                stack.pop()
            if tag == "body":
                stack = [x for x in stack if x[0] not in ("head", "title")]
            if tag not in VOID:
                stack.append((tag, _names(match[3]) if match[3] else ()))
    flush()
    return blocks


WORDS = re.compile(r"\w+")
NOTICE = re.compile(r"[©®]|copyright|rights reserved|cookie|subscribe|newsletter|sign in|log in|advert|sponsor|privacy policy", re.I)


def _size(n: int) -> str:
    return "0" if n < 2 else "1" if n < 5 else "2" if n < 10 else "3" if n < 25 else "4" if n < 60 else "5"


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out = []
    for k, block in enumerate(blocks):
        path = block.path
        words = len(WORDS.findall(block.text))
        own = path[-1] if path else "none"
        share = block.linked / max(1, len(block.text))
        found = ["bias", f"size{_size(words)}", f"own:{own}", f"links{0 if share < 0.1 else 1 if share < 0.6 else 2}"]
        found += [f"in:{t}" for t in set(path)]
        found += [f"name:{w}" for w in block.names]
        container = next((t for t in reversed(path) if t not in ("p", "div", "ul", "ol", "li", "span", "section") and t not in HEADINGS and t not in NEUTRAL), "none")
        found.append(f"box:{container}")
        if block.text[-1:] in ".!?":
            found.append("ends")
        if NOTICE.search(block.text):
            found.append("notice")
        if own in HEADINGS:
            found.append("heading")
        if k == 0:
            found.append("first")
        if k == len(blocks) - 1:
            found.append("last")
        out.append(found)
    return out


@dataclass
class Field:
    """Weights of a two-label chain: for each feature (other, main), and for each step between labels."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]] = field(default=((0.0, 0.0), (0.0, 0.0)))

    def decode(self, found: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        zero, weights, back = (0.0, 0.0), self.weights, []
        (s00, s01), (s10, s11) = self.steps
        a = b = 0.0
        for k, names in enumerate(found):
            u = v = 0.0
            for name in names:
                w = weights.get(name, zero)
                u += w[0]
                v += w[1]
            if k:
                back.append((0 if a + s00 >= b + s10 else 1, 0 if a + s01 > b + s11 else 1))
                a, b = max(a + s00, b + s10) + u, max(a + s01, b + s11) + v
            else:
                a, b = u, v
        label = int(b >= a)
        labels = [label] if found else []
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Field:
    """Maximise the likelihood of the labels by gradient steps, page by page, with expectations by forward-backward."""
    index: dict[str, int] = {}
    encoded = []
    for found, labels in pages:
        if found:
            encoded.append(([np.array([index.setdefault(n, len(index)) for n in names]) for names in found], np.array(labels)))
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(encoded)
        for ids, labels in encoded:
            n = len(ids)
            emit = np.array([w[i].sum(axis=0) for i in ids])
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for k in range(1, n):
                forward[k] = emit[k] + np.logaddexp(forward[k - 1, 0] + t[0], forward[k - 1, 1] + t[1])
            for k in range(n - 2, -1, -1):
                after = emit[k + 1] + backward[k + 1]
                backward[k] = np.logaddexp(t[:, 0] + after[0], t[:, 1] + after[1])
            total = np.logaddexp(*forward[-1])
            missing = -np.exp(forward + backward - total)
            missing[np.arange(n), labels] += 1
            grad_t = -l2 * t
            for k in range(1, n):
                grad_t = grad_t - np.exp(forward[k - 1][:, None] + t + emit[k] + backward[k] - total)
                grad_t[labels[k - 1], labels[k]] += 1
            touched = np.concatenate(ids)
            rows, where = np.unique(touched, return_inverse=True)
            grad = np.zeros((len(rows), 2))
            np.add.at(grad, where, np.repeat(missing, [len(i) for i in ids], axis=0))
            grad -= l2 * w[rows]
            gw[rows] += grad**2
            w[rows] += rate * grad / np.sqrt(gw[rows])
            gt += grad_t**2
            t += rate * grad_t / np.sqrt(gt)
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in index.items()}, tuple(map(tuple, t.tolist())))


# --- labelled pages -------------------------------------------------------------------------

MAIN_BOX = frozenset("article main".split())
OTHER_BOX = frozenset("nav aside header footer form head title button menu dialog".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored sidebar comment comments reply replies respond cookie cookies consent notice popup modal menu nav navbar breadcrumb breadcrumbs share social related recommended newsletter subscribe footer header widget toolbar pagination hidden".split()
)


def labelled(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that says itself where its article is; None if it does not."""
    if not any(MAIN_BOX & set(b.path) for b in blocks):
        return None
    return [int(bool(MAIN_BOX & set(b.path)) and not OTHER_BOX & set(b.path) and not OTHER_NAMES & b.names) for b in blocks]


def written_pages(n: int = WRITTEN_PAGES, seed: int = SEED) -> Iterator[tuple[str, list[int]]]:
    """Pages in many layouts and the labels of their blocks; made by rule, from random words."""
    dice = random.Random(seed)
    box_names = ["content", "post", "entry", "story", "article-body", "main", "text", "post-content", "page", "body"]
    other_names = sorted(OTHER_NAMES)

    def words(low: int, high: int) -> str:
        said = ["".join(dice.choice("abcdefghilmnoprstuv") for _ in range(dice.randint(1, 9))) for _ in range(dice.randint(low, high))]
        return " ".join(said).capitalize() + dice.choice([".", ".", "", "?", "!", " |"])

    def linked(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    for _ in range(n):
        parts, labels = [f"<html><head><title>{words(3, 8)}</title></head><body>"], [0]

        def other(inner: bool = False) -> None:
            name, kind = dice.choice(other_names), dice.randint(0, 4)
            tag = dice.choice(["div", "div", "section", "aside"]) if inner else dice.choice(["div", "div", "div", "section", "nav", "aside", "footer", "header", "form"])
            attribute = dice.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {dice.choice(["box", "wrap", "area", "block"])}"', f' class="site-{name}"'])
            if tag in ("nav", "aside", "footer", "header", "form") and dice.random() < 0.6:
                attribute = ""
            if kind == 0:
                k = dice.randint(2, 6)
                parts.append(f"<{tag}{attribute}><ul>{linked(k)}</ul></{tag}>")
                labels.extend([0] * k)
            elif kind == 1:
                parts.append(f"<{tag}{attribute}>{words(2, 30)}</{tag}>")
                labels.append(0)
            elif kind == 2:
                k = dice.randint(1, 4)
                parts.append(f"<{tag}{attribute}>" + "".join(f"<p>{words(1, 40)}</p>" for _ in range(k)) + f"</{tag}>")
                labels.extend([0] * k)
            elif kind == 3:
                parts.append(f"<{tag}{attribute}><h3>{words(1, 4)}</h3><p>{words(3, 25)}</p></{tag}>")
                labels.extend([0, 0])
            else:
                parts.append(f"<{tag}{attribute}>&copy; {words(1, 4)} {dice.choice(['All rights reserved.', '', words(2, 12)])}</{tag}>")
                labels.append(0)

        for _ in range(dice.randint(0, 4)):
            other()
        tag, name = dice.choice([("article", ""), ("main", ""), ("article", ' class="post"'), ("div", None), ("section", None)])
        if name is None:
            name = f' {dice.choice(["class", "id"])}="{dice.choice(box_names)}"'
        parts.append(f"<{tag}{name}>")
        if dice.random() < 0.7:
            parts.append(f"<h1>{words(2, 10)}</h1>")
            labels.append(1)
        for _ in range(dice.randint(1, 9)):
            kind = dice.random()
            if kind < 0.75:
                parts.append(f"<p>{words(1, 4) if dice.random() < 0.3 else words(5, 90)}</p>")
                labels.append(1)
            elif kind < 0.82:
                parts.append(f"<h2>{words(1, 6)}</h2>")
                labels.append(1)
            elif kind < 0.88:
                k = dice.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{words(1, 15)}</li>" for _ in range(k)) + "</ul>")
                labels.extend([1] * k)
            elif kind < 0.93:
                parts.append(f"<blockquote>{words(4, 40)}</blockquote>")
                labels.append(1)
            else:
                other(inner=True)
        if dice.random() < 0.3:
            other(inner=True)
        parts.append(f"</{tag}>")
        for _ in range(dice.randint(0, 4)):
            other()
        parts.append("</body></html>")
        yield "".join(parts), labels


def fit(pages: DataFrame | None = None, max_pages: int = MAX_TRAINING_PAGES) -> Field:
    """The field, trained on written pages and on those pages of the table, ``max_pages`` of lowest hash, that mark their article.

    Ids are chosen first, so that no task sends pages that are not among the chosen ones. Of rows
    that share a page_id one is taken; rows without a page_id or html are not.
    """
    examples = []
    for page, labels in written_pages():
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            examples.append((block_features(blocks), labels))
    if pages is not None:
        fit_for_it = pages.where(F.col("page_id").isNotNull() & (F.length("html") <= MAX_TRAINING_CHARS))
        ids = fit_for_it.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
        chosen = fit_for_it.where(F.col("page_id").isin([r[0] for r in ids.collect()])).groupBy("page_id").agg(F.min("html").alias("html"))
        for _, page in sorted(chosen.collect()):
            blocks = leaf_blocks(page)
            labels = labelled(blocks)
            if labels is not None:
                examples.append((block_features(blocks), labels))
    return train(examples)


def main_text(page: str, model: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(block_features(blocks))) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; no shuffle.

    Character references are decoded, white space in a block becomes one space, blocks of the
    main text are joined by a line feed in page order. Null and empty pages, and pages without
    main text, give an empty text. Pages of any length are read whole. Repeated rows are read
    each. An empty table gives no row. Columns other than page_id, url and html are not read.
    """
    model = model or fit(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", sent.value) for p in batch["html"].to_pylist()]
            yield pa.record_batch(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
