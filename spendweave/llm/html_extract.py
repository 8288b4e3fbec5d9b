"""Main text of web pages: a linear-chain conditional random field over a page's leaf blocks.

A page is cut at block-level tags into leaf blocks in page order. A block's features are its ancestors' tags
and the words of their classes and ids, and what its text looks like (length, share of linked words,
sentence end, marks of legal lines). The field has two labels, main text or not; it is trained by gradient
ascent on labelled pages that a small grammar lays out from ``LAYOUTS`` with fixed seeds, and the best
labels of a page are found by Viterbi in the task that reads it.

Defined results: a null, empty or text-free page has the empty text. Character references are decoded once,
white space becomes one space, blocks without text vanish; scripts, styles, closed templates, comments and tags
are no text; a tag that the page's end cuts off is dropped. ``br`` and ``option`` are white space. Buttons, svg
and the like are blocks that the field labels; without an end tag, or as ``<svg/>``, they hold nothing. Rows are extracted one by
one, whatever ids repeat. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Scripts, styles and comments go up to their end, or to the page's end without one. Names end at white space, ``/`` or ``>``.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|(?i:<(script|style)(?=[ \t\n\f\r/>])[^>]*>.*?(?:</\1(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)|\Z))"
    r"|<(/?)([a-zA-Z][^ \t\n\f\r/>\"'<]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
#: Elements that are blocks only if their end tag comes before the next start tag of their name; other start tags of them are ignored.
CLOSED_TAGS = {name: re.compile(rf"<(/?){name}(?=[ \t\n\f\r/>])", re.I) for name in "button iframe noscript select svg template textarea".split()}
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul label".split()) | CLOSED_TAGS.keys()
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
LEGAL = re.compile(r"\(c\) ?\d|\bcopyright\b|\ball rights reserved\b", re.I)
TRAIN_PAGES = 400
TRAIN_STEPS = 120


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(features of the ancestors, text, share of its characters in links) of each leaf block with text."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, path, resume = 0, False, None, 0

    def end_block() -> None:
        nonlocal parts, linked, path
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                if path is None:
                    path = tuple(f for _, features in stack for f in features) + (("in:" + stack[-1][0]) if stack else "in:",)
                out.append((path, text, min(1.0, linked / max(1, len(raw)))))
        parts, linked = [], 0

    for m in TOKEN.finditer(page):
        if m.start() < resume:
            continue
        name = m.group(3)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if in_link:
                    linked += len(piece)
            continue
        name = name.lower()
        if name == "a":
            in_link = not m.group(2)
        elif name in ("br", "option"):
            parts.append(" ")
        elif name in BLOCK_TAGS:
            end_block()
            path = None
            if m.group(2):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if stack and stack[-1][0] in ("p", "li", "td", "th", "dt", "dd", "tr") and (name == stack[-1][0] or stack[-1][0] == "p"):
                    stack.pop()  # their end tags may be missing
                if name in CLOSED_TAGS:
                    following = CLOSED_TAGS[name].search(page, m.end())
                    if not following or not following.group(1) or name == "svg" and m.group(4).endswith("/"):
                        continue
                    if name == "template":
                        resume = following.start()
                        continue
                if name != "hr":
                    named = " ".join(a or b or c for a, b, c in NAMES.findall(m.group(4))) if m.group(4) else ""
                    stack.append((name, ("tag:" + name, *("name:" + w for w in WORD.findall(named.lower())))))
    end_block()
    return out


def _text_features(text: str, linked: float) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4
    return (f"size:{size}", f"linked:{int(linked * 4)}", "stop" if text[-1] in ".!?:;\"'”»。" else "open",
            "legal" if "©" in text or "·" in text or LEGAL.search(text) else "plain")


#: How labelled pages are laid out. Each part is (opening tags, kind of blocks, closing tags), with
#: the kind's label: 1 for main text. ``%`` stands for a block's text.
LAYOUTS = {
    "before": [
        ("<nav><ul>", "menu", "</ul></nav>"), ("<header class=\"site-header\">", "short", "</header>"), ("<div class=\"ad\">", "line", "</div>"),
        ("<div id=\"menu\" class=\"navbar\"><ul>", "menu", "</ul></div>"), ("<div class=\"cookie notice banner\">", "line", "</div>"),
        ("<form class=\"search\">", "short", "</form>"), ("<div class=\"breadcrumbs\">", "short", "</div>"), ("<header><nav><ul>", "menu", "</ul></nav></header>"),
        ("<div class=\"advert sponsored\">", "line", "</div>"), ("<div role=\"navigation\"><ul>", "menu", "</ul></div>"), ("<aside class=\"sidebar\">", "line", "</aside>"),
        ("<div class=\"alert notice\"><p>", "line", "</p></div>"), ("<button>", "short", "</button>"), ("<noscript>", "line", "</noscript>"),
        ("<svg>", "short", "</svg>"), ("<select>", "short", "</select>"), ("<iframe>", "line", "</iframe>"),
        ("<div class=\"cookie-banner\"><p>", "line", "</p></div>"), ("<div class=\"nav\">", "links", "</div>"), ("<div class=\"sidebar\"><h3>", "short", "</h3></div>"),
        ("<table class=\"nav\"><tr><td class=\"menu\">", "links", "</td></tr></table>"), ("<div class=\"topbar\">", "links", "</div>")],
    "inside": [
        ("<aside class=\"related\"><ul>", "menu", "</ul></aside>"), ("<div class=\"ad\">", "line", "</div>"), ("<form class=\"newsletter signup\">", "short", "</form>"),
        ("<div class=\"share social\">", "short", "</div>"), ("<section class=\"comments\">", "long", "</section>"), ("<div class=\"notice\">", "line", "</div>"),
        ("<nav class=\"toc\"><ul>", "menu", "</ul></nav>"), ("<div class=\"promo advertisement\"><p>", "line", "</p></div>"), ("<header class=\"meta\">", "short", "</header>"),
        ("<footer class=\"tags\">", "short", "</footer>"), ("<button>", "short", "</button>"), ("<noscript>", "line", "</noscript>"),
        ("<svg>", "short", "</svg>"), ("<select>", "short", "</select>"), ("<iframe>", "line", "</iframe>"),
        ("<textarea>", "line", "</textarea>"), ("<div class=\"advertisement\"><p>", "line", "</p></div>"), ("<div class=\"ad banner\"><p>", "line", "</p></div>")],
    "after": [
        ("<footer>", "legal", "</footer>"), ("<div class=\"footer\" id=\"footer\">", "legal", "</div>"), ("<section class=\"comments\" id=\"comments\">", "long", "</section>"),
        ("<div class=\"comment-list\"><ol><li class=\"comment\">", "long", "</li></ol></div>"), ("<aside class=\"sidebar widget\"><ul>", "menu", "</ul></aside>"),
        ("<div class=\"related posts\"><ul>", "menu", "</ul></div>"), ("<form id=\"subscribe\">", "short", "</form>"), ("<div class=\"copyright legal\">", "legal", "</div>"),
        ("<div>", "plain legal", "</div>"), ("<p>", "plain legal", "</p>"), ("<div class=\"cookie-banner\"><p>", "line", "</p></div>"),
        ("<div class=\"sidebar\"><h3>", "short", "</h3></div>"), ("<div class=\"widget sidebar\"><h4>", "short", "</h4></div>"), ("<div class=\"links\">", "links", "</div>")],
    "main": [
        ("<article>", "</article>"), ("<main><article class=\"post\">", "</article></main>"), ("<main>", "</main>"), ("<div class=\"content\">", "</div>"),
        ("<div id=\"content\" class=\"article-body\">", "</div>"), ("<section class=\"entry post\">", "</section>"), ("<div class=\"story text\" role=\"main\">", "</div>"),
        ("<div><div>", "</div></div>"), ("<div>", "</div>"), ("", ""), ("<div id=\"wrapper\"><div class=\"row\">", "</div></div>"), ("<section>", "</section>"),
        ("<table><tr><td>", "</td></tr></table>"), ("<article class=\"entry\">", "</article>"), ("<div><article>", "</article></div>"),
        ("<main id=\"main\">", "</main>"), ("<article>", "</article>"), ("<article itemscope>", "</article>")],
    "main blocks": ["<p>%</p>", "<p>%</p>", "<p>%</p>", "<p>%", "<p><b>%<br>", "<h2>%</h2>", "<ul><li>%</li></ul>", "<blockquote><p>%</p></blockquote>", "<pre>%</pre>", "<div>%</div>",
                    "<table><tr><td>%</td></tr></table>", "<ol><li>%</li></ol>", "<ol><li>%</li></ol>", "<ul><li><p>%</p></li></ul>", "<dl><dt>%</dt></dl>", "<dl><dd>%</dd></dl>",
                    "<figure><img src=\"x\"><figcaption>%</figcaption></figure>", "<div><div><p>%</p></div></div>", "<section><h3>%</h3></section>",
                    "<section id=\"share-prices\"><p>%</p></section>", "<div class=\"related-work\"><p>%</p></div>", "<section class=\"notice-period\"><p>%</p></section>",
                    "<div id=\"comment-on-results\"><p>%</p></div>", "<section id=\"social-history\"><p>%</p></section>", "<div class=\"header-text\"><p>%</p></div>",
                    "<section id=\"footer-of-the-page-explained\"><p>%</p></section>", "<div class=\"menu-of-the-week\"><p>%</p></div>", "<details><summary>%</summary></details>"],
    "main phrases": ["All rights reserved.", "Copyright 2020 of the text and its pictures.", "All rights reserved by the owner.", "(c) 2019 stands below each of them."],
    "other blocks": {"menu": "<li><a href=\"/x\">%</a></li>", "short": "<span>%</span>", "line": "%", "long": "<p>%</p>", "legal": "<p>&copy; % &middot;</p>", "plain legal": "(c) 2020 %", "links": "<a href=\"/x\">%</a><br>"},
}
_MARKS = {0: "", 1: ""}


def _words(rng: random.Random, low: int, high: int, stop: float) -> str:
    words = ["".join(rng.choice(("an", "er", "to", "in", "sh", "ou", "re", "th", "le", "mi")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words) + ("." if rng.random() < stop else "")


def labelled_page(seed: int) -> str:
    """A page of the grammar; each block's text begins with a private-use character that tells its label."""
    rng = random.Random(seed)
    sizes = {"menu": (1, 3, 0.1), "short": (1, 6, 0.2), "line": (4, 25, 0.8), "long": (5, 60, 0.9), "legal": (3, 15, 0.7), "plain legal": (1, 8, 0.5), "links": (1, 3, 0.1)}

    def other(part: tuple[str, str, str]) -> str:
        opening, kind, closing = part
        several = rng.randint(2, 7) if kind in ("menu", "long", "links") else 1
        block = LAYOUTS["other blocks"][kind]
        texts = [_MARKS[0] + _words(rng, *sizes[kind]) for _ in range(several)]
        return opening + "".join(block.replace("%", t) for t in texts) + closing

    opening, closing = rng.choice(LAYOUTS["main"])
    body = [f"<h1>{_MARKS[1]}{_words(rng, 2, 12, 0.1)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.randint(0, 14)):
        size = rng.choice(((1, 4), (3, 15), (10, 60), (30, 150)))
        text = rng.choice(LAYOUTS["main phrases"]) if rng.random() < 0.08 else _words(rng, *size, 0.9)
        body.append(rng.choice(LAYOUTS["main blocks"]).replace("%", _MARKS[1] + text))
    for _ in range(rng.choice((0, 0, 1, 2))):
        body.insert(rng.randint(0, len(body)), other(rng.choice(LAYOUTS["inside"])))
    before = [other(p) for p in rng.sample(LAYOUTS["before"], rng.choice((0, 0, 1, 2, 3, 4)))]
    after = [other(p) for p in rng.sample(LAYOUTS["after"], rng.randint(0, 3))]
    head = f"<html><head><title>{_MARKS[0]}{_words(rng, 2, 12, 0.1)}</title></head><body>" if rng.random() < 0.5 else ""
    page = head + "".join(before) + opening + "".join(body) + closing + "".join(after) + rng.choice(("</body></html>", ""))
    return page[:rng.randint(len(page) // 4, len(page))] if rng.random() < 0.3 else page  # some pages are cut off


@functools.lru_cache(maxsize=1)
def train(pages: int = TRAIN_PAGES, steps: int = TRAIN_STEPS) -> tuple[dict[str, float], np.ndarray, float]:
    """(weight of each feature for label 1, transitions between labels, weight of label 1 at the start)."""
    numbers: dict[str, int] = {}
    rows, labels, starts = [], [], []
    for seed in range(pages):
        found = blocks_of(labelled_page(seed))
        starts.append(len(rows))
        for path, text, linked in found:
            mark = next((c for c in text if c in _MARKS.values()), _MARKS[0])
            labels.append(int(mark == _MARKS[1]))
            clean = text.translate({ord(c): None for c in _MARKS.values()}).strip() or "."
            rows.append([numbers.setdefault(f, len(numbers)) for f in (*dict.fromkeys(path), *_text_features(clean, linked))])
    labels, bounds = np.array(labels), [*starts, len(rows)]
    x = np.zeros((len(rows), len(numbers)))
    for k, features in enumerate(rows):
        x[k, features] = 1
    w, trans, start = np.zeros(len(numbers)), np.zeros((2, 2)), 0.0
    sums = [np.full_like(w, 1e-8), np.full_like(trans, 1e-8), 1e-8]
    for _ in range(steps):  # AdaGrad on the log-likelihood with a small quadratic penalty
        score = x @ w
        expected, g_trans, g_start = np.zeros(len(rows)), np.zeros((2, 2)), 0.0
        for a, b in zip(bounds, bounds[1:], strict=False):
            n = b - a
            if not n:
                continue
            emit = np.stack([np.zeros(n), score[a:b]], axis=1)
            ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = emit[0] + (0, start)
            for k in range(1, n):
                ahead[k] = emit[k] + np.logaddexp(ahead[k - 1, 0] + trans[0], ahead[k - 1, 1] + trans[1])
            for k in range(n - 2, -1, -1):
                after = emit[k + 1] + back[k + 1]
                back[k] = np.logaddexp(trans[:, 0] + after[0], trans[:, 1] + after[1])
            whole = np.logaddexp(*ahead[-1])
            expected[a:b] = np.exp(ahead[:, 1] + back[:, 1] - whole)
            pair = np.exp(ahead[:-1, :, None] + trans + (emit[1:] + back[1:])[:, None, :] - whole).sum(axis=0) if n > 1 else 0
            y = labels[a:b]
            real = np.zeros((2, 2))
            np.add.at(real, (y[:-1], y[1:]), 1)
            g_trans += real - pair
            g_start += y[0] - expected[a]
        gradients = [x.T @ (labels - expected) - 0.1 * w, g_trans - 0.1 * trans, g_start - 0.1 * start]
        for k, g in enumerate(gradients):
            sums[k] = sums[k] + g * g
        w = w + 0.5 * gradients[0] / np.sqrt(sums[0])
        trans = trans + 0.5 * gradients[1] / np.sqrt(sums[1])
        start = start + 0.5 * gradients[2] / np.sqrt(sums[2])
    return {f: float(w[k]) for f, k in numbers.items()}, trans, float(start)


def best_labels(scores: list[float], trans: list[list[float]], start: float) -> list[int]:
    """Viterbi over the scores of label 1 (label 0 scores 0)."""
    if not scores:
        return []
    zero, one = 0.0, scores[0] + start
    came: list[tuple[int, int]] = []
    for s in scores[1:]:
        z0, z1, o0, o1 = zero + trans[0][0], one + trans[1][0], zero + trans[0][1], one + trans[1][1]
        came.append((int(z1 > z0), int(o1 > o0)))
        zero, one = max(z0, z1), max(o0, o1) + s
    label = int(one > zero)
    out = [label]
    for back in reversed(came):
        label = back[label]
        out.append(label)
    return out[::-1]


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html column, as ``out_col``, and ``n_chars``; these replace columns of their names."""
    shared = pages.sparkSession.sparkContext.broadcast(train())
    rest = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def main_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trans, start = shared.value
        trans = trans.tolist()
        by_path: dict[tuple[str, ...], float] = {}
        by_text: dict[tuple[str, ...], float] = {}

        def score(known: dict, features: tuple[str, ...]) -> float:
            if features not in known:
                if len(known) > 100_000:
                    known.clear()
                known[features] = sum(weights.get(f, 0.0) for f in dict.fromkeys(features))
            return known[features]

        for batch in batches:
            texts = []
            for page in batch.column(len(rest)).to_pylist():
                found = blocks_of(page or "")
                scores = [score(by_path, path) + score(by_text, _text_features(text, linked)) for path, text, linked in found]
                texts.append("\n\n".join(b[1] for b, y in zip(found, best_labels(scores, trans, start), strict=True) if y))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*rest, html_col).mapInArrow(main_texts, schema)
