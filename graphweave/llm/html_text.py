"""Main text of web pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import small_batches
from graphweave.llm.models import fit_logistic, sigmoid

#: Bounds of the fit: labelled pages sampled (a fifth of them held out), words a name must go with, names that get a weight.
SAMPLE_PAGES = 2000
LEAST_WORDS = 20
FEATURE_NAMES = 2000
#: How far a listed name, an element that holds no article, and the page's own article element move a word's log odds before any fit.
LISTED, ASIDE, ARTICLE = -4.0, -8.0, 4.0
#: What links that make up most of their block take from their words' log odds; words that an article must keep beside its listed elements.
LINKS, LEAST_LEFT = -5.0, 10

# Element names of HTML and class words in common use for what is no article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math".split())
OUTSIDE = set("nav footer aside form script style noscript template head title iframe svg math select button textarea menu dialog header object".split())
BOILERPLATE = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent notice gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond replies reply disqus discussion pagination pager copyright legal disclaimer widget skip hidden".split())
# Parts of longer names that say what an element is, words beside which headers and the like belong to the article, and words that tell of another element.
NOUNS = BOILERPLATE - set("ad banner header footer masthead legal hidden skip notice login copyright share sharing social related".split())
LOOSE = set("ad banner header footer masthead legal notice login copyright share sharing social related".split())
TEXTUAL = set("article post entry content story main body text page title section".split())
ABOUT = set("no has with without open closed free is".split())
CONTENT = {"article", "main"}
WHOLE = CONTENT | {"html", "body"}

# A quote opens a value only right after the equals sign, as in the HTML standard. Atomic groups keep the match linear.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTER = re.compile(r"[^\W_]")
_PARTS = re.compile(r"[^-_:.]+")
_CLOSES_P = BLOCKS - {"body", "html", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_LISTS = {"ul", "ol", "menu"}


@dataclass
class Page:
    """Tokens (``tag`` or None, ``text``, ``at``: the innermost open element or -1) with their ``counts`` of words, and elements, parents first.

    An element has its tag, its class, id and role names that no element around it has, its parent, and whether an article or main element is around it.
    ``linked`` tells the tokens in links that hold more than half of their block's own words. What scripts, styles and the like hold is no text and has no token.
    """

    counts: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    tokens: list[tuple[str | None, str, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    fresh: list[list[str]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)


def read_page(page: str) -> Page:
    """One pass over the page, linear in its length; unclosed and misnested elements are closed as browsers roughly do."""
    out, stack = Page(), []
    depths: dict[str, list[int]] = {}  # per tag, and for blocks other than p, the depths at which one is open
    held: dict[str, int] = {}  # open elements per name

    def last(kind: str) -> int:
        return depths[kind][-1] if depths.get(kind) else -1

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            depths[out.tags[e]].pop()
            if out.tags[e] in BLOCKS and out.tags[e] != "p":
                depths["#block"].pop()
            for name in names_of[e]:
                held[name] -= 1

    names_of: dict[int, list[str]] = {}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        here = stack[-1] if stack else -1
        if m is None or m.start() > at:
            out.tokens.append((None, page[at : m.start() if m else n], here))
        if m is None:
            break
        at = max(m.end(), at + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if last(tag) >= 0:
                close(last(tag))
            out.tokens.append(("/" + tag, "", stack[-1] if stack else -1))
            continue
        if tag in _CLOSES_P and last("p") > last("#block"):
            close(last("p"))
        if tag == "li" and last("li") > max(map(last, _LISTS)):
            close(last("li"))
        up = stack[-1] if stack else -1
        attributes = m[3]
        found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split() if attributes else []
        names = list(dict.fromkeys([tag, *("." + w for w in found)]))
        e = len(out.tags)
        out.tags.append(tag)
        out.fresh.append([name for name in names if not held.get(name)])
        out.parents.append(up)
        out.inside.append(up >= 0 and (out.inside[up] or out.tags[up] in CONTENT))
        out.tokens.append((tag, "", e))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            at = end.end() if end else n
            out.tokens.append(("/" + tag, "", up))
        elif tag not in VOID and not attributes.endswith("/"):
            depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS and tag != "p":
                depths.setdefault("#block", []).append(len(stack))
            names_of[e] = names
            for name in names:
                held[name] = held.get(name, 0) + 1
            stack.append(e)
    out.counts = [0 if tag else len(text.split()) for tag, text, _ in out.tokens]
    out.linked = _linked(out)
    return out


def _linked(p: Page) -> list[bool]:
    """Text in links, and separators between them, in blocks most of whose own words are in links."""
    block, link = [], []
    for e, up in enumerate(p.parents):
        block.append(e if p.tags[e] in BLOCKS else block[up] if up >= 0 else -1)
        link.append(p.tags[e] == "a" or up >= 0 and link[up])
    own: dict[int, list[int]] = {}
    places = [(block[at], link[at]) if at >= 0 else (-1, False) for _, _, at in p.tokens]
    for (of, within), n in zip(places, p.counts):
        if n:
            own.setdefault(of, [0, 0])[within] += n
    mostly = {of for of, (plain, linked) in own.items() if linked > plain}
    return [n > 0 and of in mostly and (within or not _LETTER.search(text)) for (_, text, _), (of, within), n in zip(p.tokens, places, p.counts)]


@lru_cache(10_000)
def listed(name: str) -> bool:
    """Whether a class, id or role name is in common use for what is no article: a whole listed word, or a compound that has one as a part.

    Headers, footers and the like of an article, post or entry are none, nor are names that tell whether another element is there (``has-sidebar``).
    """
    if name in BOILERPLATE:
        return True
    parts = _PARTS.findall(name)
    if len(parts) < 2 or not ABOUT.isdisjoint(parts):
        return False
    return not NOUNS.isdisjoint(parts) or not LOOSE.isdisjoint(parts) and TEXTUAL.isdisjoint(parts)


@dataclass
class Weights:
    """Log odds that a word belongs to the article: ``bias`` and what each name (a tag, or ``.`` and a class) around it adds. A word scores
    twice its probability less 1; negative scores count ``gap`` times. ``tag`` and ``tags``: the negative score of a tag. ``on``: listed names that say nothing after all."""

    bias: float = 2.0
    names: dict[str, float] = field(default_factory=dict)
    tag: float = -0.3
    tags: dict[str, float] = field(default_factory=dict)
    gap: float = 0.25
    on: set[str] = field(default_factory=set)

    def of(self, name: str) -> float:
        return self.names.get(name, LISTED if name[0] == "." and name not in self.on and listed(name[1:]) else 0.0)


def _aside(p: Page, e: int) -> bool:
    """Elements that hold no article by their meaning; an article's own header belongs to it."""
    return p.tags[e] in OUTSIDE and not (p.tags[e] == "header" and p.inside[e])


def _asides(p: Page) -> list[bool]:
    out = []
    for e, up in enumerate(p.parents):
        out.append(up >= 0 and out[up] or _aside(p, e))
    return out


def _labelled(p: Page, at: int) -> bool:
    return at >= 0 and (p.inside[at] or p.tags[at] in CONTENT)


def _held(p: Page, off: list[bool]) -> tuple[list[int], int]:
    """Words that each element holds, those in elements ``off`` left out, and the words of the page."""
    words, total = [0] * len(p.tags), 0
    for (_, _, at), n in zip(p.tokens, p.counts):
        if n and not (at >= 0 and off[at]):
            total += n
            if at >= 0:
                words[at] += n
    for e in range(len(p.tags) - 1, -1, -1):
        if p.parents[e] >= 0:
            words[p.parents[e]] += words[e]
    return words, total


def _own_head(p: Page, e: int, name: str) -> bool:
    """Whether a header's name stands in an article, whose own it is."""
    return p.inside[e] and name in (".header", ".masthead")


def _set_off(p: Page, aside: list[bool], weights: Weights) -> list[float]:
    """Per element the least that its class names, and those of the elements around it, leave its words; 0 where they set nothing off.

    A name is passed over on html, body, main and article, and on an element that holds most of the page's words and its heads (h1, else article and main
    elements; without any, every element holds them). So are those in an article that would be left with fewer than LEAST_LEFT words.
    """
    words, total = _held(p, aside)
    heads = [e for e, t in enumerate(p.tags) if t == "h1" and not aside[e]] or [e for e, t in enumerate(p.tags) if t in CONTENT and not aside[e]]
    heading = set()
    for e in heads:
        while e >= 0 and e not in heading:
            heading.add(e)
            e = p.parents[e]
    own, top, inner, article = [], [], [], []
    for e, up in enumerate(p.parents):
        rest = sum(weights.of(x) for x in p.fresh[e] if x[0] == "." and not _own_head(p, e, x))
        if rest < 0 and (p.tags[e] in WHOLE or 2 * words[e] > total and (e in heading or not heads)):
            rest = 0.0
        own.append(rest)
        article.append(article[up] if up >= 0 and article[up] >= 0 else e if p.tags[e] in CONTENT else -1)
        inner.append(up >= 0 and (inner[up] or top[up]))
        top.append(rest <= LISTED / 2 and not inner[e])
    lost: dict[int, int] = {}
    for e, first in enumerate(top):
        if first and article[e] >= 0:
            lost[article[e]] = lost.get(article[e], 0) + words[e]
    spared = {a for a, n in lost.items() if words[a] - n < LEAST_LEFT}
    return [0.0 if r <= LISTED / 2 and article[e] in spared else r for e, r in enumerate(own)]


def log_odds(p: Page, weights: Weights) -> tuple[list[float], list[bool], list[bool]]:
    """Per token the log odds of its words, whether it stands in an element that labels the article, and whether it is set off there.

    Names add up along the open elements, each once. Elements that hold no article by their meaning or by a listed name set their words off: these have at most
    ASIDE or LISTED, whatever stands around them, and nothing in them counts for them. Outside such elements, links that make up their block lose LINKS. Where article and main elements hold most of
    the words that are likely so far, other words in them gain ARTICLE and those outside lose it.
    """
    aside = _asides(p)
    own = _set_off(p, aside, weights)
    odds, off = [], []
    for e, up in enumerate(p.parents):
        more = own[e] + sum(weights.of(x) for x in p.fresh[e] if x == p.tags[e])
        within = up >= 0 and off[up]
        value = (odds[up] if up >= 0 else weights.bias) + (min(more, 0.0) if within else more)
        if _aside(p, e):
            value = min(value, ASIDE)
        elif own[e] <= LISTED / 2:
            value = min(value, LISTED)
        odds.append(value)
        off.append(within or _aside(p, e) or own[e] <= LISTED / 2)
    content = [p.inside[e] or t in CONTENT for e, t in enumerate(p.tags)]
    likely, total = _held(p, [o <= 0 for o in odds])
    within = sum(likely[e] for e, t in enumerate(p.tags) if t in CONTENT and not p.inside[e])
    labelled = 2 * within > total
    out, inside, set_off = [], [], []
    for (_, _, at), linked in zip(p.tokens, p.linked):
        value = odds[at] if at >= 0 else weights.bias
        if labelled and at >= 0 and content[at] and not off[at]:
            value += ARTICLE
        else:
            value += linked * LINKS - (ARTICLE if labelled and not (at >= 0 and content[at]) else 0.0)
        out.append(value)
        inside.append(labelled and at >= 0 and content[at])
        set_off.append(inside[-1] and off[at])
    return out, inside, set_off


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run with the largest sum, (0, 0) if no sum is positive; the first and shortest of equals. One linear scan."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def chosen(p: Page, weights: Weights) -> tuple[int, int, np.ndarray]:
    """Bounds of the best run of tokens and whether the words of each token are more likely the article's than not. In an element that labels the article a tag costs no more than an unknown one, and what is set off there costs nothing."""
    odds, inside, set_off = log_odds(p, weights)
    word = 2 * sigmoid(np.array(odds)) - 1
    score = np.where(word < 0, weights.gap * word, word) * p.counts
    cost = [weights.tags.get(tag, weights.tag) if tag else 0.0 for tag, _, _ in p.tokens]
    scores = [0.0 if off else s + (max(c, weights.tag) if known else c) for s, c, known, off in zip(score.tolist(), cost, inside, set_off)]
    return *best_run(scores), word > 0


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best run, joined by two line feeds; words in it whose own score is negative are left out."""
    p = read_page(page or "")
    start, end, wanted = chosen(p, weights)
    blocks, now = [], []
    for (tag, text, _), keep in zip(p.tokens[start:end], wanted[start:end].tolist()):
        if tag is None:
            if keep:
                now.append(html.unescape(text))
        elif tag.lstrip("/") in BLOCKS:
            blocks.append(now)
            now = []
        elif tag == "br":
            now.append(" ")
    cleaned = (" ".join("".join(b).split()) for b in [*blocks, now])
    return "\n\n".join(c for c in cleaned if c)


def _sides(p: Page) -> Iterator[tuple[int, int, int]]:
    """Tokens with words that no aside element holds, nor one with a listed name inside the labelled article: place, words and side (0 in the article, else 1)."""
    off = []
    for e, up in enumerate(p.parents):
        named = p.inside[e] and p.tags[e] not in WHOLE and any(x[0] == "." and listed(x[1:]) and not _own_head(p, e, x) for x in p.fresh[e])
        off.append(up >= 0 and off[up] or _aside(p, e) or named)
    for i, ((_, _, at), n) in enumerate(zip(p.tokens, p.counts)):
        if n and not (at >= 0 and off[at]):
            yield i, n, 0 if _labelled(p, at) else 1


def count_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words inside and outside the labelled article by every name around them, and tags by the side they stand on."""
    for pdf in batches:
        rows: dict[tuple[str, str], list[int]] = {}
        for page in pdf["html"]:
            p = read_page(page)
            held = [[0, 0] for _ in p.tags]
            for i, n, side in _sides(p):
                rows.setdefault(("all", ""), [0, 0])[side] += n
                if p.tokens[i][2] >= 0:
                    held[p.tokens[i][2]][side] += n
            for e in range(len(p.tags) - 1, -1, -1):
                for side in (0, 1) if any(held[e]) else ():
                    if p.parents[e] >= 0:
                        held[p.parents[e]][side] += held[e][side]
                    for name in p.fresh[e]:
                        if name not in WHOLE:
                            rows.setdefault(("name", name), [0, 0])[side] += held[e][side]
            for tag, _, at in p.tokens:
                if tag:
                    rows.setdefault(("tag", tag), [0, 0])[0 if _labelled(p, at) else 1] += 1
        yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["kind", "name", "inside", "outside"])


def count_sets(names: list[str]):
    """Words inside and outside by the set of ``names`` around them."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[frozenset, list[int]] = {}
            for page in pdf["html"]:
                p, around = read_page(page), {-1: frozenset()}
                for e, up in enumerate(p.parents):
                    own = [place[x] for x in p.fresh[e] if x in place]
                    around[e] = around[up].union(own) if own else around[up]
                for i, n, side in _sides(p):
                    rows.setdefault(around[p.tokens[i][2]], [0, 0])[side] += n
            yield pd.DataFrame([(sorted(k), *v) for k, v in rows.items()], columns=["around", "inside", "outside"])

    return run


_LABEL = re.compile(r"</?(?:article|main)\b[^>]*>", re.I)


def judge(tried: list[Weights]):
    """Words of held-out pages that each of ``tried`` finds, wrongly takes and misses, with the label elements taken out of the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page in pdf["html"]:
                labelled = read_page(page)
                sides = {i: side for i, _, side in _sides(labelled)}
                want = " ".join(t[1] for i, t in enumerate(labelled.tokens) if sides.get(i) == 0).split()
                bare = read_page(_LABEL.sub("", page))
                for k, w in enumerate(tried):
                    start, end, wanted = chosen(bare, w)
                    got = " ".join(text for (tag, text, _), keep in zip(bare.tokens[start:end], wanted[start:end]) if tag is None and keep).split()
                    hit = (Counter(want) & Counter(got)).total()
                    rows.append((k, hit, len(got) - hit, len(want) - hit))
            yield pd.DataFrame(rows, columns=["tried", "hit", "wrong", "missed"])

    return run


def fit_weights(pages: DataFrame, most: int = SAMPLE_PAGES) -> Weights:
    """Weights from pages that label their article themselves by one article or main element; defaults where none does.

    About ``most`` such pages at most, chosen by hash of the url; of these a fifth is held out. A logistic regression of words on the names around them
    (not on the label element) moves the listed names' weights and gives others one; words of aside elements teach nothing. A tag costs more the more it
    stands outside. How much of a negative score counts, and whether tags cost as fitted or half, is what does best on the held-out pages without their label elements.
    """
    one = F.regexp_count(F.col("html"), F.lit(r"(?i)<(article|main)[\s>]")) == 1
    known = pages.select("url", "html").where(F.col("html").isNotNull()).where(one)
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("url", F.lit("pages")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    held_out = F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0
    taught = known.where(~F.coalesce(held_out, F.lit(False))).select("html")
    totals = taught.mapInPandas(count_names, "kind string, name string, inside long, outside long").groupBy("kind", "name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    whole = totals.where("kind = 'all'").first()
    out = Weights()
    if whole is None or not min(whole["i"], whole["o"]):
        return out
    frequent = totals.where("kind <> 'all'").where(F.col("i") + F.col("o") >= LEAST_WORDS).orderBy(F.desc(F.col("i") + F.col("o")), "kind", "name").limit(FEATURE_NAMES).collect()
    tags = [r for r in frequent if r["kind"] == "tag"]
    inside, outside = sum(r["i"] for r in tags) + 1, sum(r["o"] for r in tags) + 1
    for r in tags:
        odds = np.log((r["i"] + 0.5) / inside) - np.log((r["o"] + 0.5) / outside)
        out.tags[r["name"]] = -float(np.clip(0.3 - odds / 4, 0.1, 2.0))
    names = sorted(r["name"] for r in frequent if r["kind"] == "name")
    sets = taught.mapInPandas(count_sets(names), "around array<int>, inside long, outside long").groupBy("around").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy("around").collect()
    x = np.zeros((len(sets), len(names)), np.float32)
    for r, s in enumerate(sets):
        x[r, s["around"]] = 1
    prior = np.array([out.of(name) for name in names])
    y = np.repeat([1.0, 0.0], len(sets))
    share = np.array([s["i"] for s in sets] + [s["o"] for s in sets], float)
    w, out.bias = fit_logistic(np.concatenate([x, x]), y, 0.01, counted=share, around=prior)
    out.names = {name: float(v) for name, v in zip(names, w)}
    tried = [replace(out, gap=gap, tags={t: c * cost for t, c in out.tags.items()}) for cost in (1.0, 0.5) for gap in (0.25, 0.5, 1.0)]
    seen = known.where(held_out).select("html").mapInPandas(judge(tried), "tried int, hit long, wrong long, missed long").groupBy("tried").agg(F.sum("hit").alias("h"), F.sum("wrong").alias("w"), F.sum("missed").alias("m")).collect()
    return tried[max(seen, key=lambda r: (2 * r["h"] / max(1, 2 * r["h"] + r["w"] + r["m"]), -r["tried"]))["tried"]] if seen else out


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) of every page from its whole html.

    Words score positive and tags negative; names of menus, adverts and the like around words make their score negative. The run of tokens
    with the largest sum is the article; words in it with a negative score are left out. Null, empty or wordless pages give an empty
    text. Repeated rows come out repeated; no rows give no rows. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    cast = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, cast.value) for p in page], dtype=object)

    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit_weights(pages))
