"""Main text of web pages, with a host suffix array for boilerplate.

A page is cut into blocks at block-level tags; character references are decoded and white space is
collapsed. Markup sorts the blocks: what stands in menus, headers, footers, sidebars, adverts, notices,
forms, scripts, styles or reader comments is page furniture and goes; what stands in an article or main
element is the article and stays; the rest is undecided. The token streams of a host's distinct pages, articles
included, are concatenated and their suffixes sorted: an undecided token goes if a substring of ``run`` or more
tokens around it, however long, also occurs in another page of the host. Unique runs are kept. A substring may span
blocks, but not the border between undecided and decided ones: pages whose articles begin alike lose no line before them.

A host's streams are sorted in shards of bounded token mass; each shard of several reports the ``run``-token heads
of its suffixes, and heads that meet again in another shard count as repeated too: a substring repeats exactly if
all its heads do, so the covered places are those of one array over the whole host. Wholly equal pages of a host
count as one. Hosts without undecided text need no array.

Defined cases: null or empty html gives an empty text; truncated tags end with the page; a null url is a
host of its own; repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urls import host_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed word lists of HTML element and role names.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "title", "textarea", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = BLOCK - {"br", "hr", "p", "li", "dd", "dt", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "head", "dialog", "dir"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Names, as classes or ids, of what the result leaves out: adverts, notices, sidebars, menus, headers, footers, reader comments.
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|sidebar|side-bar|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|comment-\w+|disqus)(?:$|[\s_-]|\d)", re.I)
_SPACE = re.compile(r"\s+")
ARTICLE, FURNISHED, OPEN = 0, 1, 2


def _furnished(name: str, attrs: str, article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not article):
        return True
    if "=" not in attrs:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if (key.lower() in ("class", "id") and name not in ("html", "body", "main", "article") and _NAMED.search(value)) or (key.lower() == "role" and value.lower() in ROLES):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks that hold text, in page order."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, bool]] = []  # name, furniture inside, article inside
    held: list[str] = []
    bad = art = False

    def end() -> None:
        if held:
            t = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            if t:
                out.append((t, FURNISHED if bad else ARTICLE if art else OPEN))
            held.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                held.append(t)
            elif t.startswith("<![CDATA["):
                held.append(_html.escape(t[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name in BLOCK:
            end()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    end()
                    del stack[i:]
                    bad, art = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            continue
        if name in BLOCK and stack and stack[-1][0] in ("p", "li") and (name == stack[-1][0] or (stack[-1][0] == "p" and name != "br")):
            stack.pop()
            bad, art = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else size
            if not close:
                break
            continue
        if name in VOID:
            continue
        wrong = _furnished(name, m[3], art)
        inside = art or name in ("article", "main") or (("role" in m[3] or "itemprop" in m[3]) and bool(re.search(r"role\s*=\s*[\"']?main|articleBody", m[3], re.I)))
        if name in CONTAINER or wrong:
            end()
            stack.append((name, bad or wrong, inside))
            bad, art = bad or wrong, inside
    end()
    return out


#: What ends a block of a page's stream: a mark, or between an undecided block and a decided one a border, which equals nothing.
MARK, BORDER = "¶", "\n"


def stream(found: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a page, each block ending with a mark or border, and the places of the undecided ones."""
    words: list[str] = []
    undecided: list[int] = []
    for i, (t, kind) in enumerate(found):
        own = t.split(" ")
        if kind == OPEN:
            undecided += range(len(words), len(words) + len(own))
        ends = i + 1 < len(found) and (kind == OPEN) != (found[i + 1][1] == OPEN)
        words += [*own, BORDER if ends else MARK]
    return words, undecided


def stream_key(host: str | None, found: list[tuple[str, int]]) -> bytes:
    return hashlib.blake2b("\x00".join([host or "", *(f"{k}{t}" for t, k in found)]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes in order, by prefix doubling, and what each shares with the one before it. The ids must
    tell all suffixes apart (a mark of its own after each page)."""
    n = ids.size
    rank, levels, step = np.unique(ids, return_inverse=True)[1].astype(np.int64), [], 1
    while True:
        levels.append(rank)
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        order = np.lexsort((ahead, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0))))
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            break
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        inside = (a < n) & (b < n)
        same = np.zeros(a.size, dtype=bool)
        same[inside] = level[a[inside]] == level[b[inside]]
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def shared_lengths(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the concatenated streams: page and place of each token, and the length of the longest substring from there on
    that another page has too."""
    sizes = np.array([len(p) + 1 for p in pages])
    page = np.repeat(np.arange(len(pages)), sizes)
    place = np.arange(page.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tokens = np.array([w for p in pages for w in [*p, ""]], dtype=object)
    words = pd.factorize(tokens)[0].astype(np.int64)
    last = place == sizes[page] - 1
    single = last | (tokens == BORDER)
    words[single] = words.max() + 1 + np.arange(single.sum())  # a mark of its own ends each page, and is each border
    order, lcp = suffix_array(words)
    of = page[order]

    def reach(of: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """What each suffix shares with the nearest one before it of another page: the least of the steps between."""
        new = np.concatenate(([True], of[1:] != of[:-1]))
        run, big = np.cumsum(new), np.int64(page.size + 1)
        return np.minimum.accumulate(lcp - run * big) + run * big

    after = np.concatenate((lcp[1:], [0]))
    longest = np.maximum(reach(of, lcp), reach(of[::-1], after[::-1])[::-1])
    out = np.empty_like(longest)
    out[order] = longest
    return page[~last], place[~last], out[~last]


def head_keys(words: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``run`` tokens from each place on, as far as the page goes, and whether they hold no border."""
    if len(words) < run:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    borders = np.concatenate(([0], np.cumsum([w == BORDER for w in words])))
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    key = np.zeros(h.size - run + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(run):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : h.size - run + 1 + j]
    return key.view(np.int64), borders[run:] == borders[:-run]


def keep_text(found: list[tuple[str, int]], covered: np.ndarray | None = None) -> tuple[str, int]:
    """Article blocks whole and undecided blocks without their covered tokens; how many tokens went."""
    out, at, gone = [], 0, 0
    for t, kind in found:
        if kind == ARTICLE:
            out.append(t)
        elif kind == OPEN:
            words = t.split(" ")
            left = words if covered is None else [w for j, w in enumerate(words) if not covered[at + j]]
            gone += len(words) - len(left)
            if left:
                out.append(" ".join(left))
        at += t.count(" ") + 2
    return "\n".join(out), gone


def extract(pages: DataFrame, run: int = 6, shard_tokens: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (undecided tokens that repeats cover) for every row of pages. Each page is
    parsed once; what its array needs is written."""
    spark = pages.sparkSession
    common.text_batches(spark)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            undecided, keys, kept = [], [], []
            for h, x in zip(p["host"], p["html"]):
                b = blocks(x)
                undecided.append(any(k == OPEN for _, k in b))
                keys.append(stream_key(h, b))
                kept.append([{"t": t, "k": k} for t, k in b])
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "host": p["host"], "undecided": undecided, "sk": keys, "blocks": kept})

    kinds = dict(rows.dtypes)
    seen = common.cut(rows.mapInPandas(parsed, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, undecided boolean, sk binary, blocks array<struct<t:string,k:int>>"), codec="zstd")
    article = F.transform(F.filter("blocks", lambda b: b["k"] == ARTICLE), lambda b: b["t"])
    decided = seen.where("not undecided").select("page_id", "url", F.array_join(article, "\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    undecided = seen.where("undecided")
    if undecided.isEmpty():
        return _counted(decided)

    hosts = undecided.select(F.col("host").alias("open_host")).distinct()
    mine = seen.join(hosts, F.col("host").eqNullSafe(F.col("open_host")), "left_semi")
    tokens = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(b["t"]) - F.length(F.replace(b["t"], F.lit(" "), F.lit(""))) + 2)
    streams = common.cut(mine.groupBy("host", "sk").agg(F.first("blocks").alias("blocks")).withColumn("n", tokens))
    shards = streams.groupBy(F.col("host").alias("of_host")).agg(F.ceil(F.sum("n") / shard_tokens).alias("shards"))
    dealt = streams.join(shards, F.col("host").eqNullSafe(F.col("of_host"))).select("host", "sk", "blocks", "shards", F.pmod(F.xxhash64("sk"), F.col("shards")).alias("shard"))

    def places(p: pd.DataFrame) -> pd.DataFrame:
        """Undecided places that repeats of the shard cover (key null); of several shards also all heads, with their places where they touch undecided text."""
        host, several = p["host"].iloc[0], p["shards"].iloc[0] > 1
        words, spots = zip(*[stream([(x["t"], x["k"]) for x in b]) for b in p["blocks"]])
        page, place, longest = shared_lengths(list(words))
        out = []
        for i, sk in enumerate(p["sk"]):
            own = page == i
            long = np.where(longest[own] >= run, longest[own], 0)
            end = np.maximum.accumulate(np.arange(long.size) + long)
            at = np.array(spots[i], dtype=np.int64)
            out.append(pd.DataFrame({"host": host, "sk": sk, "key": None, "place": at[end[at] > at] if at.size else at}))
            if several:
                keys, whole = head_keys(words[i], run)
                touch = whole & (np.searchsorted(at, np.arange(keys.size) + run) > np.searchsorted(at, np.arange(keys.size)))
                uniq = np.unique(keys[whole])
                out += [pd.DataFrame({"host": host, "sk": None, "key": uniq, "place": -1}), pd.DataFrame({"host": host, "sk": sk, "key": keys[touch], "place": np.flatnonzero(touch)})]
        got = pd.concat(out)
        alone = got["sk"].isna()
        return pd.concat([got[~alone], got[alone].drop_duplicates("key")]).astype({"key": "Int64"})

    found = common.cut(dealt.groupBy("host", "shard").applyInPandas(places, "host string, sk binary, key long, place int"))
    there = found.where("key is null").select("sk", "place", F.lit(1).alias("length"))
    elsewhere = found.where("sk is null").groupBy("host", "key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("host").alias("eh"), F.col("key").alias("ek"))
    over = found.where("sk is not null and key is not null").join(elsewhere, F.col("host").eqNullSafe(F.col("eh")) & (F.col("key") == F.col("ek")), "left_semi").select("sk", "place", F.lit(run).alias("length"))
    marks = there.unionByName(over).groupBy("sk").agg(F.collect_set(F.struct("place", "length")).alias("marks"))
    joined = undecided.join(marks, "sk", "left")

    @F.pandas_udf("text string, n long")
    def finish(found_blocks: pd.Series, marked: pd.Series) -> pd.DataFrame:
        out = []
        for b, m in zip(found_blocks, marked):
            pairs = [(x["t"], x["k"]) for x in b]
            covered = np.zeros(sum(t.count(" ") + 2 for t, _ in pairs), dtype=bool)
            for x in m if m is not None else ():
                covered[x["place"] : x["place"] + x["length"]] = True
            out.append(keep_text(pairs, covered))
        return pd.DataFrame(out, columns=["text", "n"])

    done = joined.select("page_id", "url", finish("blocks", "marks").alias("x")).select("page_id", "url", F.col("x.text").alias("text"), F.col("x.n").alias("n_repeated"))
    return _counted(decided.unionByName(done))


def _counted(done: DataFrame) -> DataFrame:
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
