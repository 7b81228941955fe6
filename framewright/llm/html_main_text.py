"""Operator 8: main text of web pages with a suffix array for each host.

Each page becomes a stream of text blocks. Markup gives each block a prior: text inside an ``article`` or ``main`` element is main text by the page's own statement; elements and roles that HTML
defines as navigation, footer, aside, form and the like, and blocks whose class or id is one of ``BOILER_NAMES``, are boilerplate; a class or id that only contains such a name is a hint; all else is open.
Names that contain one of ``CERTAIN_NAMES`` (reader comments, adverts, notices and the like: ``comment-list``, ``adSlot``) drop what they hold wherever it stands, in marked main text too, unless one element holds more than half
of the page's main text: then its name is only a hint.
Repeated runs decide what markup leaves open: the pages of a host are dealt by hash to groups of about ``PAGES_PER_GROUP`` pages, so
a hot host is many groups and no group grows with the corpus. In a group the token streams of distinct pages are concatenated, a suffix array is built by prefix
doubling, and neighbours whose common prefix is ``LEAST_TOKENS`` or longer give the substrings that repeat; those that occur on ``LEAST_PAGES`` distinct
pages cover tokens. For a host of several groups the runs are also counted over all its groups, by host and hash of the run, so the deal decides nothing. Covered tokens of open blocks are removed and
unique runs stay; a hinted block goes if runs cover half of it, or if it stands outside the main text that its page marks.

Marked main text is kept even where copies of the article repeat it, and is no evidence against text elsewhere, so streams leave it out; a page that marks none is in them as a whole. An open block that is mostly links is a menu.

Null and empty html gives an empty text; a null url is a host of its own. Pages of equal blocks count once for the suffix array and are all returned. Cut-off markup at the end of a page is markup.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import materialize, slices

PAGES_PER_GROUP, LEAST_TOKENS, LEAST_PAGES = 256, 8, 3
#: A group has about so many bytes of pages at most; a single larger page is a group of its own.
BYTES_PER_GROUP = 16 << 20
#: So many runs are held by a task before it sends their pages on.
RUNS_HELD = 1_000_000
LINK_SHARE = 0.6
#: At most so many hosts of more than one group are sent to all tasks, about 100 bytes each.
LARGE_HOSTS = 200_000
SALTS = 64

# Elements by what HTML says they are.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object")
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"article", "aside", "body", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "main", "menu", "nav", "ol", "section", "select", "button", "table", "ul", "a", "td", "th", "span", "p", "li"}
MAIN_ROLES, BOILER_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
BOILER_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
CERTAIN_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "consent", "cookie", "cookies", "disqus", "modal", "newsletter", "notice", "notices", "popup", "promo", "replies", "reply", "respond", "sidebar", "signup", "sponsor", "sponsored", "subscribe"}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"

KEPT, DROPPED, OPEN, HINTED = 1, 0, 2, 3  # roles of blocks: main text, boilerplate, to be decided, to be decided but named like boilerplate
CERTAIN = 4  # role of elements: boilerplate unless it is most of the main text


def _role(tag: str, attributes: str, inside_main: bool) -> int | None:
    """What an element says of its text; None: nothing."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    if tag in BOILER or (tag == "header" and not inside_main):
        return DROPPED
    role = found.get("role", "").lower()
    if role in BOILER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return DROPPED
    if tag in ("article", "main") or role in MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody":
        return KEPT
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag not in ("body", "html") and names != " ":
        if {w.lower() for w in names.split()} & BOILER_NAMES:
            return DROPPED
        parts = {w.lower() for w in _NAME.findall(names)} & BOILER_NAMES
        if parts:
            return CERTAIN if parts & CERTAIN_NAMES else HINTED
    return None


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, role) of each block in page order; character references are decoded, white space is single and trimmed."""
    page = page or ""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = at = 0
    stack: list[tuple[str, int | None]] = []
    inside = {KEPT: 0, DROPPED: 0, HINTED: 0, CERTAIN: 0, None: 0}
    opened: Counter[str] = Counter()
    within, named = [-1], [-1]  # elements of certain names: those that are open, and what each stands in
    links, marked = 0, False

    def flush():
        nonlocal linked, marked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if inside[DROPPED]:
                    role = DROPPED
                elif inside[KEPT]:
                    role, marked = HINTED if inside[HINTED] or inside[CERTAIN] else KEPT, True
                elif linked > LINK_SHARE * len(text):
                    role = DROPPED
                else:
                    role = -HINTED if inside[HINTED] or inside[CERTAIN] else OPEN
                out.append((text, role, within[-1]))
            parts.clear()
        linked = 0

    def text_of(piece: str):
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def leave() -> str:
        nonlocal links
        tag, role = stack.pop()
        inside[role] -= 1
        opened[tag] -= 1
        links -= tag == "a"
        if role == CERTAIN:
            within.pop()
        return tag

    while True:
        m = _MARKUP.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text_of(html.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        if tag in VOID or tag not in CONTAINERS:
            continue
        if closing:
            if opened[tag]:
                while leave() != tag:
                    pass
        else:
            if tag == "body":  # a head that wasn't closed ends here
                while stack:
                    leave()
            elif tag in ("p", "li") and stack and stack[-1][0] == tag:  # their end tags may be left out
                leave()
            if attributes.endswith("/") and tag not in ("p", "div"):
                continue
            role = _role(tag, attributes, inside[KEPT] > 0)
            stack.append((tag, role))
            inside[role] += 1
            opened[tag] += 1
            links += tag == "a"
            if role == CERTAIN:
                named.append(within[-1])
                within.append(len(named) - 1)
    flush()
    # a hint outside main text is enough where the page marks its main text
    out = [(text, (DROPPED if marked else HINTED) if role == -HINTED else role, element) for text, role, element in out]
    held, main = [0] * len(named), 0
    for text, role, element in out:
        if role != DROPPED and (role != OPEN or not marked):
            main += len(text)
            if element >= 0:
                held[element] += len(text)
    for element in range(len(named) - 1, 0, -1):
        if named[element] > 0:
            held[named[element]] += held[element]
    gone = [False] * len(named)
    for element in range(1, len(named)):
        gone[element] = 2 * held[element] <= main or (named[element] > 0 and gone[named[element]])
    return [(text, DROPPED if element > 0 and gone[element] else role) for text, role, element in out]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of each doubling (of prefixes of 1, 2, 4, ... tokens)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, size = [rank], 1
    order = np.argsort(rank, kind="stable")
    while size < n and rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[:-size] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        run = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        rank = new
        levels.append(rank)
        size *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the next in the array, by binary lifting over the ranks."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        # ranks of the last level may differ for equal prefixes only past the end of the text
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        length, a, b = length + step, a + step, b + step
    return length


def repeated(streams: list[list[list[str]]], pages: list[int], least_tokens: int = LEAST_TOKENS) -> list[np.ndarray]:
    """For each page's stream, given in segments that no run crosses, which tokens lie in a substring of at least least_tokens tokens that occurs on enough distinct pages. pages: tells pages apart."""
    distinct = {page: stream for page, stream in zip(pages, streams)}
    number: dict[str, int] = {}
    codes, owners, ends = [], [], [0]
    for k, stream in enumerate(distinct.values()):
        for segment in stream:
            codes += [number.setdefault(t, len(number)) for t in segment]
            codes.append(-1 - len(owners))  # a separator of its own
            owners += [k] * (len(segment) + 1)
        ends.append(len(owners))
    hit = np.zeros(len(codes), bool)
    if len(distinct) >= LEAST_PAGES and codes:
        owner = np.array(owners)
        order, levels = suffix_array(np.array(codes))
        shared = common_prefixes(order, levels) >= least_tokens
        group = np.concatenate([[0], np.cumsum(~shared)])
        of = np.unique(group * len(distinct) + owner[order]) // len(distinct)
        hit[order] = (np.bincount(of, minlength=group[-1] + 1) >= LEAST_PAGES)[group]
    real = np.array(codes) >= 0 if codes else hit
    covered = cover(hit, least_tokens)
    found = {page: covered[s:e][real[s:e]] for page, s, e in zip(distinct, ends, ends[1:])}
    return [found[page] for page in pages]


def cover(starts: np.ndarray, least_tokens: int = LEAST_TOKENS) -> np.ndarray:
    """The tokens in runs of least_tokens tokens with the given starts."""
    change = np.zeros(len(starts) + least_tokens + 1, np.int64)
    at = np.flatnonzero(starts)
    change[at] += 1
    change[at + least_tokens] -= 1
    return np.cumsum(change)[: len(starts)] > 0


def segments_of(page: list) -> list[str]:
    """A page's token stream without marked main text, in stretches between such text."""
    out, open_ = [], False
    for text, role in page:
        if role == KEPT:
            open_ = False
        elif open_:
            out[-1] += f" {text}"
        else:
            out.append(text)
            open_ = True
    return out


def runs_of(segments: list[list[str]], least_tokens: int = LEAST_TOKENS) -> list[np.ndarray]:
    """Hashes of the runs of least_tokens tokens at each place of each segment where one starts."""
    return [np.array([xxhash.xxh3_64_intdigest(" ".join(s[i : i + least_tokens])) for i in range(len(s) - least_tokens + 1)], np.uint64).view(np.int64) for s in segments]


def main_text(page: list, covered: np.ndarray) -> str:
    """Blocks of main text, and what is unique of undecided blocks. covered: of the tokens outside marked main text."""
    kept, at = [], 0
    for text, role in page:
        if role == KEPT:
            kept.append(text)
            continue
        tokens = text.split(" ")
        here = covered[at : at + len(tokens)]
        at += len(tokens)
        if role == HINTED and 2 * here.sum() < len(tokens):
            kept.append(text)
        elif role == OPEN:
            rest = " ".join(t for t, c in zip(tokens, here) if not c) if here.any() else text
            if rest:
                kept.append(rest)
    return "\n\n".join(kept)


def _host():
    """The url's host, empty if it has none or is null."""
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))


def _unpacked(data: bytes):
    return json.loads(zstandard.ZstdDecompressor().decompress(data))


def deal(pages: DataFrame, large: DataFrame, most_broadcast: int = LARGE_HOSTS) -> DataFrame:
    """pages (page_id, url, html, host) with groups, how many its host has, and part, the page's group by a hash of all it holds. large: host, groups of the hosts of more than one group; sent to all
    tasks only if they are at most ``most_broadcast``, else joined by host and salt so that a hot host's pages never gather."""
    placed = pages.withColumn("place", F.xxhash64("page_id", "url", "html"))
    if large.count() <= most_broadcast:
        found = placed.join(F.broadcast(large), "host", "left")
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = placed.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    return found.select(*pages.columns, F.coalesce("groups", F.lit(1)).alias("groups"), F.pmod(F.hash("place"), F.coalesce("groups", F.lit(1))).cast("long").alias("part"))


def _parsed(batches, column: int):
    """Parts of the batches with their pages' blocks and a hash of all blocks of each page."""
    for whole in batches:
        for batch in slices(whole, column):
            found = [blocks(p) for p in batch.column(column).to_pylist()]
            written = [json.dumps(b, ensure_ascii=False).encode() for b in found]
            yield batch, found, written, np.array([xxhash.xxh3_64_intdigest(w) for w in written], np.uint64).view(np.int64)


def host_runs(dealt: DataFrame) -> DataFrame:
    """host, part, run: the runs outside marked main text that occur on LEAST_PAGES distinct pages of a host, for each of its groups that has them.

    A task sends on at most LEAST_PAGES distinct pages of a run, which is all that the threshold asks, and else only the groups it is in, so a run of a hot host doesn't gather;
    pages of equal blocks are one page.
    """

    def run(batches):
        keys, pages, parts, names, held = [], [], [], [], 0

        def send():
            sizes = [len(k) for k in keys]
            table = pd.DataFrame({"host": np.repeat(names, sizes), "part": np.repeat(parts, sizes), "run": np.concatenate(keys), "page": np.repeat(np.array(pages, np.int64), sizes)}).drop_duplicates()
            counts = table.groupby(["host", "run"]).cumcount() < LEAST_PAGES
            table["page"] = table["page"].astype("Int64").where(counts)
            return pa.RecordBatch.from_pandas(table[counts | ~table.duplicated(["host", "part", "run"])], schema=pa.schema([("host", pa.string()), ("part", pa.int64()), ("run", pa.int64()), ("page", pa.int64())]), preserve_index=False)

        for batch, found, _, hashes in _parsed(batches, 2):
            for host, part, page, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, hashes.tolist()):
                here = runs_of([s.split(" ") for s in segments_of(page)])
                if any(map(len, here)):
                    keys.append(np.unique(np.concatenate(here)))
                    pages.append(name)
                    parts.append(part)
                    names.append(host)
                    held += len(keys[-1])
                if held > RUNS_HELD:
                    yield send()
                    for column in (keys, pages, parts, names):
                        column.clear()
                    held = 0
        if keys:
            yield send()

    found = dealt.select("host", "part", "html").mapInArrow(run, "host string, part long, run long, page long")
    counted = found.groupBy("host", "run").agg(F.size(F.collect_set("page")).alias("n"), F.collect_set("part").alias("parts"))
    return counted.where(F.col("n") >= LEAST_PAGES).select("host", F.explode("parts").alias("part"), "run")


def _groups(pages: int, times: int = 1):
    """How many groups rows make, by number and by bytes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / (times * pages)), F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")) / (times * BYTES_PER_GROUP)))


def extract(pages: DataFrame, pages_per_group: int = PAGES_PER_GROUP) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (tokens outside marked main text in repeated runs) of each row of pages (page_id, url, html).

    Pages of hosts of several groups are parsed twice, once for the runs, which costs less than to keep all blocks on disk. Equal rows share a part; where they make it large it is split by place,
    which decides nothing.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    large = materialize(read.groupBy("host").agg(_groups(pages_per_group).alias("groups")).where("groups > 1"), "large-hosts")
    dealt = deal(read, large)
    several = dealt.where("groups > 1")
    runs = materialize(host_runs(several).groupBy("host", "part").agg(F.collect_list("run").alias("runs")), "host-runs")
    crowded = several.groupBy("host", "part").agg(_groups(pages_per_group, 4).alias("splits"))
    crowded = materialize(crowded.where("splits > 1"), "crowded-parts")

    def split(df: DataFrame) -> DataFrame:
        side = F.broadcast(crowded) if crowded.count() <= LARGE_HOSTS else crowded
        return df.join(side, ["host", "part"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))

    def parse(batches):
        for batch, found, written, hashes in _parsed(batches, 5):
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hashes), pa.array([pack(w) for w in written], pa.binary()), pa.array([segments_of(f) for f in found], pa.list_(pa.string()))], names=["host", "part", "sub", "page_id", "url", "page", "blocks", "segments"])

    parsed = split(dealt).select("host", "part", F.pmod(F.monotonically_increasing_id(), F.col("splits")).alias("sub"), "page_id", "url", "html")
    parsed = parsed.mapInArrow(parse, "host string, part long, sub long, page_id long, url string, page long, blocks binary, segments array<string>")
    runs = split(runs).select("host", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("sub"), "runs")

    def run(pdf, known):
        segments = [[s.split(" ") for s in page] for page in pdf["segments"]]
        covered = repeated(segments, pdf["page"].tolist())
        if len(known):  # runs of the whole host, which hold those of this group
            common = np.asarray(known["runs"].iloc[0], np.int64)
            for k, page in enumerate(segments):
                more = [cover(np.append(np.isin(found, common), np.zeros(len(s) - len(found), bool))) for s, found in zip(page, runs_of(page))]
                covered[k] = covered[k] | np.concatenate([np.zeros(0, bool), *more])
        texts = [main_text(json.loads(zstandard.ZstdDecompressor().decompress(b)), c) for b, c in zip(pdf["blocks"], covered)]
        return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").to_numpy(), "url": pdf["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts], "n_repeated": [int(c.sum()) for c in covered]})

    groups = [df.groupBy("host", "part", "sub") for df in (parsed, runs)]
    return groups[0].cogroup(groups[1]).applyInPandas(run, "page_id long, url string, text string, n_chars long, n_repeated long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
