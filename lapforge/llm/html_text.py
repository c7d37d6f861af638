"""Main text of web pages: markup, and a suffix array of each host's token streams.

1. Each page is cut into blocks by one linear scan. Elements that never hold main text
   (scripts, navigation, asides, forms, footers, the page's header, articles inside an
   article, which are reader comments) and elements whose class, id or role is made of
   boilerplate words alone (``cookie-notice``, but not ``ad-hoc``) are dropped with all they
   hold, if they are closed: one that is left open to the end of its parent takes nothing
   along. Not dropped are elements that hold ``main``; forms that hold an article or more than half
   of the page's text; articles inside one that has little text of its own (a container).
   Blocks inside ``main``, else inside ``article``, are noted as marked, those of ``h1`` as titles.
2. The blocks of a page are one token stream. Runs of ``run`` tokens found on ``min_pages``
   distinct pages of a host are boilerplate. Equal runs have equal least phrases (by hash),
   so a host's suffix array is built in pieces by that phrase: phrases on fewer pages are
   left out in a first pass, the stretches of the others are concatenated by shard (equal
   ones once, with their pages), their suffix array is sorted by ``run`` tokens, and each of
   its intervals adds up the distinct pages of its stretches.
3. A block goes by the share of its tokens that lie in such runs; markup only weighs it: a
   block of a page that marks nothing goes from ``OPEN_SHARE`` on, a marked block or title from
   ``ARTICLE_SHARE`` on; another block beside the marked ones stays if it has ``run`` tokens and
   none is repeated. Where more than half of the marked text is repeated, the page is a copy
   of others and its marked text stays whole: copies are no boilerplate.

Scale: no host, page or text is shuffled, only hashes and the stretches of recurring phrases;
shards follow the size of the texts, however pages spread over hosts. The parsed blocks are
staged once.

Edge cases: a null or empty html gives the empty text; stray end tags are ignored; a null
url counts as one host; repeated rows of a page id are one page of its host (pages without
an id are told apart by their html) and stay rows; text in no block element is a block; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import HashArrays, pack, packed_schema, ranges, reduced, run_starts, units, unpack
from .common import shards_for, staged
from .wordhash import grams, mix, utf8_parts, words

RUN, PHRASE, MIN_PAGES = 8, 4, 3
OPEN_SHARE, ARTICLE_SHARE = 0.5, 0.8
CONTAINER_SHARE = 0.25  # an article with less own text than this share of the one inside only contains it
MARKED, TITLE = 1, 2
SHARD_BYTES = 48 << 20
U64 = np.uint64

# Element names of HTML, and words that name boilerplate in class, id and role, or only place it.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OPTIONAL_END = frozenset("p li dd dt option optgroup tr td th thead tbody tfoot".split())
DROPPED = frozenset("nav aside footer form button select option fieldset dialog svg canvas object audio video map head menu".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist disqus "
    "reply replies related recommended share sharing social newsletter subscribe signup login search pagination pager popup modal overlay "
    "complementary contentinfo".split()
)
PLACES = frozenset("site page main top bottom left right side upper lower box bar block wrapper wrap container section list item items area inner outer widget links buttons icons form post reader user global header".split())

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/><]*))")
_ATTRS = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _named_boilerplate(attrs: str) -> bool:
    """Whether a class, id or role consists of words for boilerplate and for its place, one of the former at least."""
    for m in _NAMES.finditer(attrs):
        for name in m[1].strip("\"'").lower().split():
            parts = [p for p in _SPLIT.split(name) if p]
            if any(p in BOILERPLATE for p in parts) and all(p in BOILERPLATE or p in PLACES for p in parts):
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag; comments and the like have no name. One pass, whatever is left open."""
    at, quoted, end_mark = 0, True, {"-->": True, "]]>": True}
    while m := _OPEN.search(page, at):
        start = m.start()
        if m[1] or m[2]:
            mark = "-->" if m[1] else "]]>"
            end = page.find(mark, m.end()) if end_mark[mark] else -1
            end_mark[mark] = end >= 0
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        closed = _ATTRS.match(page, m.end()) if quoted and m[5] else None
        if closed is None:
            quoted = quoted and not m[5]  # a quote is left open: from here on, quotes hide no tag's end
            end = page.find(">", m.end())
            if end < 0:
                return  # what looks like a tag and never ends is text, and so is all after it
            at = end + 1
        else:
            at = closed.end()
        back = yield start, at, m[4] or "", (m[5] or "").lower(), page[m.end() : at - 1] if m[5] else ""
        if back is not None:
            at = back


class Drop:
    """An element to drop: its name (none if it goes by its class, id or role), the article around it, and how many main and article elements had been opened when it opened and closed."""

    def __init__(self, name: str, around: int, mains: int, articles: int):
        self.name, self.around, self.opened, self.ended = name, around, (mains, articles), None


def _spared(drops: list[Drop], parent: list[int], out: list[tuple]) -> set[int]:
    """Numbers of the elements to drop that are kept after all, by what they hold."""
    inside, own = [0] * len(drops), {}
    for text, _, _, article, _, at in out:
        inside[at] += len(text)
        own[article] = own.get(article, 0) + len(text)  # of the innermost article
    total = sum(len(b[0]) for b in out)
    for at in range(len(drops) - 1, 0, -1):  # what lies inside an element has a higher number
        inside[parent[at]] += inside[at]
    spared = set()
    for number, d in enumerate(drops[1:], 1):
        main, article = (b > a for a, b in zip(d.opened, d.ended))
        if main or (d.name in ("form", "fieldset") and (article or 2 * inside[number] > total)) or (d.name == "article" and own.get(d.around, 0) < CONTAINER_SHARE * inside[number]):
            spared.add(number)
    return spared


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, MARKED if marked as main text and TITLE if a title) of the blocks in page order."""
    page, out, buffer = page or "", [], []  # out: text, inside article, inside main, innermost article, title, innermost element to drop around it
    stack: list[tuple[str, int]] = []  # open elements and, for those to drop, their number (else 0)
    place: dict[str, list[int]] = {}  # of each name in the stack
    around, parent, closed = [0], [0], set()  # elements to drop: open ones, the one around each, those closed
    drops, articles, mains, n_articles = [Drop("", 0, 0, 0)], [0], 0, 0  # articles: numbers of the open ones
    missing, at = set(), 0

    def flush() -> None:
        if buffer:
            if text := _SPACE.sub(" ", html.unescape("".join(buffer))).strip():
                out.append((text, bool(place.get("article")), bool(place.get("main")), articles[-1], bool(place.get("h1")), around[-1]))
            buffer.clear()

    def close(depth: int) -> None:
        """Close what is open from ``depth`` on; what is left open inside was to have an end tag, or not."""
        while len(stack) > depth:
            name, number = stack.pop()
            place[name].pop()
            if name == "article":
                articles.pop()
            if number:
                around.pop()
                drops[number].ended = (mains, n_articles)
                if len(stack) == depth or name in OPTIONAL_END:
                    closed.add(number)

    tags, jump = _tags(page), None
    while True:
        try:
            start, end, slash, name, attrs = tags.send(jump) if jump is not None else next(tags)
        except StopIteration:
            break
        jump = None
        if start > at:
            buffer.append(page[at:start])
        at = end
        if not name:
            continue
        inline = name in INLINE
        if slash:
            if place.get(name):
                flush()
                close(place[name][-1])
            elif not inline:
                flush()
            continue
        named = name not in ("html", "body", "main") and bool(attrs) and _named_boilerplate(attrs)
        bad = named or name in DROPPED or (name == "header" and not (place.get("article") or place.get("main"))) or (name == "article" and bool(place.get("article")))
        if inline and not bad:
            if name == "br":
                buffer.append(" ")
            continue
        flush()
        if name in RAW and name not in missing:
            if ended := _RAW_END[name].search(page, at):
                at = jump = ended.end()
            elif name in ("script", "style"):
                at = jump = len(page)
            else:
                missing.add(name)
        elif name not in VOID and name not in RAW and not attrs.endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                close(len(stack) - 1)  # a new paragraph or item ends an open one
            stack.append((name, len(parent) if bad else 0))
            place.setdefault(name, []).append(len(stack) - 1)
            mains, n_articles = mains + (name == "main"), n_articles + (name == "article")
            if bad:
                drops.append(Drop("" if named else name, articles[-1], mains, n_articles))
                parent.append(around[-1])
                around.append(len(parent) - 1)
            if name == "article":
                articles.append(n_articles)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    closed.update(number for name, number in stack if name in OPTIONAL_END)
    for d in drops:
        d.ended = d.ended or (mains, n_articles)
    gone, spared = [False], _spared(drops, parent, out)
    for number in range(1, len(parent)):
        gone.append((number in closed and number not in spared) or gone[parent[number]])
    kept = [b for b in out if not gone[b[-1]]]
    by = 2 if any(b[2] for b in kept) else 1
    return [(b[0], MARKED * b[by] + TITLE * b[4]) for b in kept]


def host_runs(token: np.ndarray, stretch: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all runs of ``run`` tokens in suffix-array order, the interval of equal runs of each).

    ``token`` concatenates streams of numbers from 1 on, ``stretch`` numbers them. The
    suffix array is built by doubling until suffixes are sorted by ``run`` tokens.
    """
    n = len(token)
    whole = np.flatnonzero(stretch[: n - run + 1] == stretch[run - 1 :]) if n >= run else np.zeros(0, np.int64)
    rank, width = token.astype(np.int64), 1
    while width < run and len(whole):
        step = min(width, run - width)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        order = np.lexsort((after, rank))
        change = np.ones(n, np.int64)
        change[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        width += step
    suffix = whole[np.argsort(rank[whole], kind="stable")]
    begin = run_starts(rank[suffix])
    return suffix, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(suffix))))


class Streams:
    """Token streams of the pages of a batch (host, page, blocks)."""

    def __init__(self, batch: pa.RecordBatch, run: int):
        host, self.page = (np.asarray(batch.column(i), np.int64).view(U64) for i in (0, 1))
        lists = batch.column(2)
        data, offsets = utf8_parts(lists.flatten())
        word, _, _, self.block_ptr = words(data, offsets)
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
        self.ptr, self.blocks_of = self.block_ptr[at], at
        self.token = mix(word ^ np.repeat(mix(host), np.diff(self.ptr)))  # tokens of different hosts differ
        self.phrase, self.first_word, phrase_ptr = grams(self.token, self.ptr, min(PHRASE, run))
        self.at, self.low, self.high = units(self.phrase, phrase_ptr, run - min(PHRASE, run) + 1)
        self.row = np.searchsorted(phrase_ptr, self.at, "right") - 1
        self.run = run

    def keep(self, recurring: HashArrays) -> None:
        key = self.phrase[self.at]
        hit, _ = recurring.lookup(key >> U64(32), key)
        self.at, self.low, self.high, self.row = self.at[hit], self.low[hit], self.high[hit], self.row[hit]

    def run_hash(self, start: np.ndarray) -> np.ndarray:
        """Hash of the run from each start word."""
        return run_hash(self.token, start, self.run)


def run_hash(token: np.ndarray, start: np.ndarray, run: int) -> np.ndarray:
    out = np.zeros(len(start), U64)
    for k in range(run):
        out = (out ^ token[start + k]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return out


def _recurring(pages: DataFrame, run: int, min_pages: int, n_shards: int) -> HashArrays:
    """Least phrases (by the upper half of their hash, enough for a first sieve) on ``min_pages`` pages of a host."""
    phrases = HashArrays.named(pages, "html-phrases", {}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Streams(batch, run)
            key, page = s.phrase[s.at], s.page[s.row]
            order = np.lexsort((page, key))
            one = order[run_starts(key[order], page[order])]
            start = run_starts(key[one])
            count = np.minimum(np.diff(np.append(start, len(one))), min_pages).astype(np.uint8)
            key = key[one][start]
            yield pack((key >> U64(32)).astype(np.uint32), [count], n_shards, (key % U64(n_shards)).astype(np.int64))

    def merge(rows: pa.Table):
        key, count = unpack(rows, [np.uint32, np.uint8])
        order = np.argsort(key, kind="stable")
        start = run_starts(key[order])
        return key[order][start][reduced(np.add, count[order].astype(np.int64), start) >= min_pages].astype(U64), {}

    phrases.fill(pages.mapInArrow(send, packed_schema(2)), merge)
    return phrases


def _boilerplate(pages: DataFrame, phrases: HashArrays, run: int, min_pages: int, n_shards: int) -> HashArrays:
    """Hashes of the runs on ``min_pages`` distinct pages of a host, from the suffix arrays of the shards."""
    runs = HashArrays.named(pages, "html-runs", {}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Streams(batch, run)
            s.keep(phrases)
            first, last = s.first_word[s.low], s.first_word[s.high]
            size, page = last - first + run, s.page[s.row]
            key = mix(s.run_hash(first) * U64(3) + mix(s.run_hash(last)) + size.astype(U64))  # the two runs overlap: all words count
            shard = (s.phrase[s.at] % U64(n_shards)).astype(np.int64)
            order = np.lexsort((page, key, shard))
            one = order[run_starts(key[order], page[order])]
            start = run_starts(key[one])  # of the rows of one stretch: a row a page, the first min_pages of them
            nth = np.arange(len(one)) - np.repeat(start, np.diff(np.append(start, len(one))))
            one, lead = one[nth < min_pages], (nth == 0)[nth < min_pages]
            cut = np.searchsorted(shard[one], np.arange(n_shards + 1))
            used = np.flatnonzero(np.diff(cut))
            rows = [[], [], [], []]
            for s_ in used:
                part, leads = one[cut[s_] : cut[s_ + 1]], lead[cut[s_] : cut[s_ + 1]]
                rows[0].append(key[part].tobytes())
                rows[1].append(page[part].tobytes())
                rows[2].append(np.where(leads, size[part], 0).astype(np.uint8).tobytes())  # 0: the words came with the row before
                rows[3].append(s.token[ranges(first[part[leads]], size[part[leads]])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array(r, pa.binary()) for r in rows], names=["shard", "b0", "b1", "b2", "b3"])

    def merge(rows: pa.Table):
        key, page, size, token = unpack(rows, [U64, U64, np.uint8, U64])
        size = size.astype(np.int64)
        low = np.cumsum(size) - size
        order = np.lexsort((size == 0, key))  # a row with words first
        start = run_starts(key[order])
        lead = order[start]
        stream = token[ranges(low[lead], size[lead])]
        _, number = np.unique(stream, return_inverse=True)
        suffix, interval = host_runs(number + 1, np.repeat(np.arange(len(lead)), size[lead]), run)
        of = np.repeat(np.arange(len(lead)), size[lead])[suffix] if len(suffix) else suffix
        # distinct pages of each interval: those of all its stretches
        page, by = page[order], np.append(start, len(order))
        many = np.diff(by)[of] if len(of) else of
        pair_interval, pair_page = np.repeat(interval, many), page[ranges(by[of], many)]
        sort = np.lexsort((pair_page, pair_interval))
        one = run_starts(pair_interval[sort], pair_page[sort])
        pages_of = np.bincount(pair_interval[sort][one], minlength=int(interval.max(initial=-1)) + 1)
        first = suffix[run_starts(interval)]
        return run_hash(stream, first[pages_of >= min_pages], run), {}

    runs.fill(pages.mapInArrow(send, packed_schema(4)), merge)
    return runs


def covered(s: Streams, phrases: HashArrays, runs: HashArrays) -> np.ndarray:
    """Whether each token of the batch lies in a run that is boilerplate of its host."""
    s.keep(phrases)
    count = s.high - s.low + 1
    start = s.first_word[ranges(s.low, count)]
    hit, _ = runs.lookup(s.run_hash(start), np.repeat(s.phrase[s.at], count))
    begins = np.zeros(len(s.token), np.int64)
    begins[start[hit]] = 1
    total = np.concatenate([np.zeros(s.run, np.int64), np.cumsum(begins)])
    return total[s.run :] > total[: -s.run]


def _texts(s: Streams, gone: np.ndarray, lists: list, marks: list) -> list[str]:
    """Text of each page, given the repeated tokens."""
    total = np.concatenate([[0], np.cumsum(gone)])
    hits, sizes, out = np.diff(total[s.block_ptr]).tolist(), np.diff(s.block_ptr).tolist(), []
    for at, texts, inside in zip(s.blocks_of.tolist(), lists, marks):
        size, hit = sizes[at : at + len(texts)], hits[at : at + len(texts)]
        marked = any(i & MARKED for i in inside)
        copy = 2 * sum(h for h, i in zip(hit, inside) if i & MARKED) > sum(n for n, i in zip(size, inside) if i & MARKED)
        kept = []
        for text, i, n, h in zip(texts, inside, size, hit):
            most = h < (ARTICLE_SHARE if i else OPEN_SHARE) * n or not h
            if (copy or most) if i & MARKED else most if i & TITLE or not marked else n >= s.run and not h:
                kept.append(text)
        out.append("\n".join(kept))
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page id, url, text, n_chars) of every page."""
    kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blocks(p) for p in batch.column(4).to_pylist()]
            text = pa.array([[t for t, _ in page] for page in got], pa.list_(pa.string()))
            inside = pa.array([[i for _, i in page] for page in got], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), text, inside], names=["page_id", "url", "host", "page", "blocks", "inside"])

    host = F.xxhash64(F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#:]+)", 1), F.lit("")))
    page = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(html_col))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), page.alias("page"), F.col(html_col).alias("html"))
    n_shards = shards_for(pages, "html", SHARD_BYTES)
    parsed = staged(pages.mapInArrow(parse, f"page_id {kind}, url string, host long, page long, blocks array<string>, inside array<tinyint>"), "pages")
    streams = parsed.select("host", "page", "blocks")
    phrases = _recurring(streams, run, min_pages, n_shards)
    runs = _boilerplate(streams, phrases, run, min_pages, n_shards)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Streams(batch, run)
            text = _texts(s, covered(s, phrases, runs), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    text = parsed.select("host", "page", "blocks", "inside", "page_id", "url").mapInArrow(strip, f"page_id {kind}, url string, text string")
    return text.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
