"""Main text of web pages as the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.selection import thinned
from siftlab.llm.words import bounded

SAMPLE_PAGES = 1000
MAX_FEATURES = 5000
_CLIP = 4.0
_TAG_COST = (0.05, 1.0)
_BLOCK_COST = 4.0  # an advert inside the text must not outweigh what follows it

# HTML elements by role.
_RAW_TEXT = ("script", "style", "textarea", "title")
_HIDDEN = frozenset((
    "noscript", "template", "head", "svg", "math", "iframe", "object", "select", "button", "canvas", "audio", "video",
))
_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
_BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
)
_SELF_CLOSING = frozenset((
    "p", "li", "dt", "dd", "tr", "td", "th",
))
_NEUTRAL = frozenset((
    "html", "body", "div", "article", "main", "section", "span",
))
_CONTENT = frozenset(("article", "main"))
# Names of elements, classes and ids that mark parts around the main text.
_AROUND = frozenset((
    "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "sponsor",
    "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "form", "search", "comment", "comments", "respond", "reply", "disqus", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "widget", "toolbar", "copyright", "legal", "skip",
)
)
_AROUND_WEIGHT = 400.0

_RAW = "|".join(_RAW_TEXT)
_ATTRS = r"(?:(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+(?=>)|[^<>]*)"  # quoted values may hold a ">"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>]){_ATTRS}>(?:.*?</(?P=raw)\s*>|.*\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|<[!?][^<>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Parts of a class name after which a name says what the element has or lacks, not what it is,
# and first parts that name a topic.
_ABOUT_OTHERS = frozenset(("no", "not", "has", "with", "without", "hide"))
_TOPICS = frozenset(("category", "tag", "format", "type", "post-type", "post-format"))
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    """Text of one block, the features of its place, and the tags seen since the block before it."""

    text: str
    features: frozenset[str]
    tags: list[str]
    labelled: bool


def _names(token: str, whole_page: bool) -> set[str]:
    """Parts of one class, id or role. Names of surroundings count only where they say what the element is."""
    parts = _PART.findall(token)
    topic = any(token.startswith(f"{t}-") for t in _TOPICS)
    return {
        p
        for i, p in enumerate(parts)
        if p not in _AROUND or not (whole_page or topic or _ABOUT_OTHERS.intersection(parts[:i]) or "free" in parts[i + 1 :])
    }


def _features(name: str, attrs: str) -> frozenset[str]:
    found = set() if name in _NEUTRAL else {f"tag:{name}"}
    for groups in _NAMED.findall(attrs) if attrs else ():
        for token in "".join(groups).lower().split():
            found.update(f"name:{p}" for p in _names(token, name in ("html", "body")))
    return frozenset(found)


def _is_around(feature: str) -> bool:
    return feature.startswith("name:") and feature[5:] in _AROUND


def _hidden_spans(page: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost hidden elements that are closed, in page order.

    An element that is not closed hides nothing, one that closes itself is empty, and a head ends
    at the first block at the latest.
    """
    spans: list[tuple[int, int]] = []
    open_: dict[str, list[int]] = {}
    for m in _TOKEN.finditer(page):
        name = m["name"] and m["name"].lower()
        if name in _BLOCK and not m["close"] and open_.get("head"):
            inside = [n for n in ("noscript", "template") if open_.get(n)]
            if not inside:
                spans.append((open_.pop("head")[0], m.start()))
        if name not in _HIDDEN:
            continue
        if not m["close"]:
            if not m["attrs"].endswith("/"):
                open_.setdefault(name, []).append(m.start())
        elif open_.get(name):
            spans.append((open_[name].pop(), m.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not merged or a >= merged[-1][1]:
            merged.append((a, b))
        elif b > merged[-1][1]:
            merged[-1] = (merged[-1][0], b)
    return merged


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order. Block elements cut, others do not; hidden elements are left out."""
    hidden = iter(_hidden_spans(page))
    span = next(hidden, None)
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    opened: Counter = Counter()
    place: frozenset[str] = frozenset()
    labelled = False
    parts: list[str] = []
    tags: list[str] = []
    pending: list[str] = []

    def close_block() -> None:
        nonlocal tags, pending
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append(Block(text, place, tags, labelled))
            tags, pending = pending, []
        else:
            tags += pending
            pending = []

    for m in _TOKEN.finditer(page):
        while span and m.start() >= span[1]:
            span = next(hidden, None)
        if span and m.start() >= span[0]:
            continue
        if m["text"] is not None:
            parts.append(m["text"])
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _HIDDEN:
            continue
        if name == "br":
            parts.append(" ")
            continue
        (pending if parts else tags).append(name)
        if name not in _BLOCK:
            continue
        close_block()
        if name in _VOID:
            continue
        if m["close"]:
            while opened[name]:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    break
        else:
            if stack and stack[-1][0] == name in _SELF_CLOSING:
                opened[stack.pop()[0]] -= 1
            above, inside = stack[-1][1:] if stack else (frozenset(), False)
            if name == "main" and any(map(_is_around, above)):  # the main part of a page is no part of its surroundings
                above = frozenset(f for f in above if not _is_around(f))
            own = _features(name, m["attrs"])
            stack.append((name, above if own <= above else above | own, inside or name in _CONTENT))
            opened[name] += 1
        place, labelled = stack[-1][1:] if stack else (frozenset(), False)
    close_block()
    return out


@dataclass(frozen=True)
class Weights:
    """Log-odds of the main text: per feature of a word's place, per tag, and for any word."""

    word: float
    features: dict[str, float]
    tags: dict[str, float]

    def of_word(self, block: Block) -> float:
        score = self.word + sum(self.features.get(f, _prior(f)) for f in block.features)
        return max(-_CLIP, min(_CLIP, score))

    def of_tags(self, tags: list[str]) -> float:
        return sum(self.tags.get(t, -_TAG_COST[0]) for t in tags)


def _prior(feature: str) -> float:
    return -3 * _CLIP if feature.partition(":")[2] in _AROUND else 0.0


def count_features(pages: list[str]) -> Counter:
    """Words and tags inside (True) and outside (False) the labelled part of each page."""
    seen: Counter = Counter()
    for page in pages:
        blocks = blocks_of(page)
        if not any(b.labelled for b in blocks):
            continue
        for b in blocks:
            n = len(b.text.split())
            around = {f for f in b.features if f.partition(":")[2] in _AROUND}
            for f in around or b.features:  # such a name explains the place alone
                seen[f, b.labelled] += n
            seen["word:", b.labelled] += n
            for t in b.tags:
                seen[f"open:{t}", b.labelled] += 1
    return seen


def fit(counts: dict[tuple[str, bool], float]) -> Weights:
    """Weights from counts; the fixed names carry some outside counts of their own."""
    inside = counts.get(("word:", True), 0) + 1.0
    outside = counts.get(("word:", False), 0) + 1.0
    features, tags = {}, {}
    for key in {k for k, _ in counts}:
        a, b = counts.get((key, True), 0), counts.get((key, False), 0)
        if key.startswith("open:"):
            tags[key[5:]] = -max(_TAG_COST[0], min(_TAG_COST[1], math.log((b + 1) / (a + 1))))
        elif key != "word:":
            b += _AROUND_WEIGHT if key.partition(":")[2] in _AROUND else 0
            odds = math.log((a + 5) / inside) - math.log((b + 5) / outside)
            features[key] = min(_prior(key), 0.0) if odds < 0 and _prior(key) else max(-_CLIP, min(_CLIP, odds))
    return Weights(max(1.0, min(2.0, math.log((inside + 20) / (outside + 10)))), features, tags)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the earliest contiguous run of the largest sum, by one linear scan; empty if none is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best run without those whose place speaks against them, joined by line ends."""
    blocks = blocks_of(page)
    per_word = [weights.of_word(b) for b in blocks]
    scores = []
    for b, w in zip(blocks, per_word, strict=True):
        scores += [weights.of_tags(b.tags), max(w * len(b.text.split()), -_BLOCK_COST)]
    start, end = best_run(scores)
    return "\n".join(b.text for i, b in enumerate(blocks) if start <= 2 * i + 1 < end and per_word[i] > 0)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample`` pages that mark their main text with <article> or <main>.

    Pages are taken by id hash; only counts per feature reach the driver, of
    the ``MAX_FEATURES`` most frequent features. Without labelled pages the fixed names decide.
    """
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    marked = marked.where(thinned(F.xxhash64("id"), sample, pages.count()))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = count_features(batch.column("html").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"key": [k for k, _ in seen], "inside": [i for _, i in seen], "n": [float(n) for n in seen.values()]},
                schema=pa.schema([("key", pa.string()), ("inside", pa.bool_()), ("n", pa.float64())]),
            )

    totals = chosen.mapInArrow(count, "key string, inside boolean, n double").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    rows = totals.orderBy(F.desc("n"), "key", "inside").limit(MAX_FEATURES).collect()
    return fit({(r["key"], r["inside"]): r["n"] for r in rows})


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None
) -> DataFrame:
    """(id, url, text, n_chars) per page: the main text of the whole page.

    Words score by the place they stand in, tags cost; the best contiguous run is the content
    region, and blocks inside it that stand in menus, adverts, forms, comments and the like are
    left out. Class names count for the element that carries them and what is inside it, not where
    they say what it has or lacks (``no-sidebar``, ``with-share``, ``ad-free``) or its topic
    (``category-legal``), and never on the whole page. A header inside an article is a header and
    left out with its title. Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one line end. A null, empty or textless page gives an empty text;
    broken markup is read as far as it goes; repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows.
    """
    weights = weights or learn_weights(pages, id_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return bounded(rows).mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
