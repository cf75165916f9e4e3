"""HTML extraction (10): host suffix array over the pages' token streams; markup is a veto and a weight.

A page is cut into blocks, each with what the markup says of it. Blocks in navigation, headers, footers, asides, forms
and the like, or in elements whose class, id or role says so, go. All others are for the host suffix array to decide, and
markup says how much it takes: of blocks in an article whose class or id may mean either, and of all of a page without an
article, what one other page has; of blocks of <article> or <main> that nothing speaks against, what most articles have.

An article's own: its suffixes are counted by (host, first `tokens` tokens). Substrings that more than half of the host's
articles hold, LEAST of them at least, by pages and by distinct articles, are boilerplate; blocks that they cover from end
to end go. Articles of one host may share passages: those of fewer stay, and so does a page of which more than half would
go, as it is a copy. A substring that most of a host's pages have, most pages of some block of pages have too: only those
are counted over all pages (see common).

The rest: the tokens of all blocks but an article's own are concatenated by page; the suffixes of all pages of a host are
sorted by (host, first `tokens` tokens) and neighbours of distinct pages compared. Tokens covered by a repeated substring
are boilerplate and go; the runs between them stay. Where less than `tokens` tokens of a block are covered in a row, and not
all of it, a neighbour's boilerplate has only begun or ended like it: they stay too. Pages with one and the same stream count
as one page. Hosts without an undecided block need no such suffixes. Suffixes of a hot host or a common line meet once a block only (see held_twice).

Character references are decoded, white space inside a block is one space, blocks are joined by an empty line. Null or
empty html, or a page without text: an empty string. url null: the host is empty. Repeated rows come out each.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import blocks as alike
from millrace.llm.shared import held_twice, mix, one_name, scratch, with_id
from millrace.llm.urlfilter import host_and_path

#: Length of a substring that is boilerplate if two pages of a host have it.
TOKENS = 12
#: Hosts with an undecided block are broadcast up to this number; more are shuffled.
BROADCAST_HOSTS = 1_000_000
#: What fewer of a host's distinct articles hold is no boilerplate where markup calls it the article's own.
LEAST = 20
#: Suffixes of articles that are counted at once; and how many, of those that may be common, are broadcast: of more, all are shuffled.
SUFFIXES, WANTED = 500_000, 1_000_000
#: Elements by what they do to text.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "canvas", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder".split())
ASIDE = frozenset("nav footer aside form head menu dialog button select fieldset".split())
MAIN = frozenset(("article", "main"))
#: Elements that are never judged by class or id.
PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
#: Names of what isn't the main text; of readers' comments; and names that may mean either.
STRONG = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted sidebar sponsor sponsored".split())
READERS = frozenset("comment comments disqus replies".split())
WEAK = frozenset("modal recommended related share sharing signup skip social subscribe tags toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
_NAME_ENDS, _ENDS_OR_QUOTES = re.compile(r"[\s/>]"), re.compile("[>\"']")
_SAYS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLOSED_BY_BLOCK = "p"
#: What the markup says of a block: the article's own; outside an article; either, within one; something else.
OWN, LOOSE, EITHER, OTHER = range(4)


def judged(name: str, attributes: str, in_main: bool) -> int:
    """OTHER, EITHER, or OWN where nothing speaks against the element. A name counts by its first or last part; within an
    article parts alone, but for readers' comments, may mean either."""
    if name in ASIDE or name == "header" and not in_main:
        return OTHER
    found = OWN
    for key, *value in _SAYS.findall(attributes) if "=" in attributes else ():
        said = "".join(value).lower()
        if key.lower() == "role":
            found = OTHER if said in ROLES else found
        elif name not in PLAIN:
            for whole in said.split():
                parts = re.split("[-_]+", whole)
                ends = {parts[0], parts[-1]}
                if not READERS.isdisjoint(parts) or whole in STRONG and not (whole == "header" and in_main) or not in_main and not STRONG.isdisjoint(ends):
                    return OTHER
                if not STRONG.isdisjoint(ends) or not WEAK.isdisjoint(ends):
                    found = max(found, EITHER)
    return found


class Tags:
    """Finds the tags of a page one after another, in time that grows with the page, whatever is broken in it.

    A tag ends at the first ">" outside quotes; where none follows, or a quote is never closed, "<" is text. Where each
    ">" or quote leads to is known for all of them from one walk back from the page's end.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.marks = [m.start() for m in _ENDS_OR_QUOTES.finditer(page)]
        self.leads = [-1] * len(self.marks)
        closing: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[i]]
            if c == ">":
                self.leads[i] = self.marks[i]
            else:
                j = closing.get(c, len(self.marks))
                self.leads[i] = self.leads[j + 1] if j + 1 < len(self.marks) else -1
                closing[c] = i
        self.name_end = -1

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at a place, or -1."""
        i = bisect_left(self.marks, at)
        return self.leads[i] if i < len(self.marks) else -1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name, closes, attributes) of the first tag from a place on; name is None for comments and declarations."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), None, False, ""
            first = page[at + 1 : at + 2]
            if first in ("!", "?"):
                end = page.find(">", at) if self.marks and self.marks[-1] > at else -1
                if end >= 0:
                    return at, end + 1, None, False, ""
            else:
                closes = first == "/"
                name = at + 1 + closes
                if (c := page[name : name + 1]).isascii() and c.isalpha():
                    if self.name_end <= name:
                        found = _NAME_ENDS.search(page, name)
                        self.name_end = found.start() if found else len(page)
                    for begin in (self.name_end, name + 1):  # a quote is a name's, unless the tag has no end then
                        if (end := self.end(begin)) >= 0:
                            cut = self.name_end if begin > name + 1 else min(self.name_end, self.marks[bisect_left(self.marks, begin)])
                            return at, end + 1, page[name:cut], closes, page[cut:end]
            at += 1
        return None


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with what the markup says of it."""
    found: list[tuple[str, int]] = []
    if not page:
        return found
    stack: list[tuple[str, bool, int]] = []  # name, in main, what it and all around it say
    held: list[str] = []
    at = 0

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, main, said = stack[-1] if stack else ("", False, OWN)
                found.append((text, said if main or said == OTHER else LOOSE))

    tags, opened = Tags(page), Counter()
    while found_tag := tags.next(at):
        start, stop, name, closes, attributes = found_tag
        if start > at:
            held.append(page[at:start])
        at = stop
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closes and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in INLINE and not ("=" in attributes and judged(name, attributes, False)) and not (stack and stack[-1][0] == name):
            continue
        end()
        if closes:
            if opened[name]:
                while (top := stack.pop()[0]) != name:
                    opened[top] -= 1
                opened[name] -= 1
        elif name not in VOID:
            if stack and stack[-1][0] == _CLOSED_BY_BLOCK and name not in INLINE:
                opened[stack.pop()[0]] -= 1
            _, main, said = stack[-1] if stack else ("", False, OWN)
            if not attributes.endswith("/"):
                stack.append((name, main or name in MAIN, max(said, judged(name, attributes, main))))
                opened[name] += 1
    held.append(page[at:])
    end()
    if any(said == OWN for _, said in found):  # what stands loose beside an article isn't of it
        found = [(t, OTHER if said == LOOSE else said) for t, said in found]
    return found


def windows(host: str, words: list[str], tokens: int, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of (host, first `tokens` tokens) of each suffix that is long enough."""
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    h = np.array([memo[w] for w in words], np.uint64)
    n = max(0, len(h) - tokens + 1)
    seed = xxhash.xxh3_128_intdigest(host)
    a, b = np.full(n, np.uint64(seed >> 64)), np.full(n, np.uint64(seed & (2**64 - 1)))
    for i in range(tokens):
        a, b = mix(a + h[i : i + n]), mix((b ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15))
    return a, b


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def own_blocks(sure: str | None, texts: object, marks: object) -> list[str]:
    """The article's own blocks of a page."""
    return [t for t in sure.split("\n\n") if t] if sure is not None else [t for t, said in zip(texts, marks, strict=True) if said == OWN]


def own_suffixes(places: np.ndarray, articles: list[list[str]], tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 bits of (host, first `tokens` tokens) of each suffix that is long enough: these, the article's number, and the token's place among those of all articles."""
    memo = _Hashes()
    words = [" ".join(x).split() for x in articles]
    h = np.fromiter((memo[w] for x in words for w in x), np.uint64)
    of = np.repeat(np.arange(len(words)), [len(x) for x in words])
    size = 1
    while size * 2 <= tokens:
        h, size = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]), size * 2
    if rest := tokens - size:  # two that overlap
        h = mix(h[:-rest] * np.uint64(0xD6E8FEB86659FD93) + h[rest:])
    at = np.flatnonzero(of[: len(h)] == of[tokens - 1 : tokens - 1 + len(h)]) if len(of) >= tokens else np.zeros(0, np.int64)
    return mix(h[at] ^ places.view(np.uint64)[of[at]]).view(np.int64), of[at], at


def trimmed(place: int, article: list[str], common: np.ndarray, tokens: int) -> list[bool]:
    """Of each block of an article, whether it stays."""
    n = np.array([len(t.split()) for t in article], np.int64)
    slot, _, at = own_suffixes(np.array([place], np.int64), [article], tokens)
    edge = np.zeros(n.sum() + 1, np.int64)
    start = at[np.isin(slot, common)]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + tokens, -1)
    left = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] == 0)])
    ends = np.cumsum(n)
    stays = left[ends] - left[ends - n] > 0
    return [True] * len(article) if 2 * n[~stays].sum() > n.sum() else list(stays)


def common(parsed: DataFrame, tokens: int) -> DataFrame | None:
    """(place, common): the suffixes' heads that most articles of a host (place) hold; None where no host has any.

    Pages come in blocks. Whatever most pages of a host hold, most of its pages in one of the blocks hold: a block
    sends those alone. They are then counted over all pages, by pages and by distinct articles.
    """
    articles = parsed.where("article <> 0 and host <> ''")
    hosts = articles.groupBy("place", "article").agg(F.count("*").alias("n")).groupBy("place").agg(F.sum("n").alias("pages"), F.count("*").alias("articles"))
    hosts = scratch(hosts.where(F.col("articles") >= LEAST), "articles")
    if not (many := hosts.count()):
        return None
    some = F.broadcast(hosts.select("place")) if many <= BROADCAST_HOSTS else hosts.select("place")
    judged = articles.join(some, "place", "left_semi").select("place", "article", "sure", "blocks", "marks")

    def suffixes(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ones of each page, and the page's number."""
        slot, of, _ = own_suffixes(b["place"].to_numpy(np.int64), [own_blocks(*x) for x in zip(b["sure"], b["blocks"], b["marks"], strict=True)], tokens)
        order = np.lexsort((of, slot))
        slot, of = slot[order], of[order]
        first = np.ones(len(slot), bool)
        first[1:] = (slot[1:] != slot[:-1]) | (of[1:] != of[:-1])
        return slot[first], of[first]

    def most(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        slot, place, pages = (np.concatenate(x) for x in zip(*held, strict=True))
        known, pages = np.unique(pages, return_counts=True)
        order = np.argsort(slot, kind="stable")
        slot, place = slot[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(slot)))
        return pd.DataFrame({"slot": slot[first[2 * n > pages[np.searchsorted(known, place[first])]]]})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            place = b["place"].to_numpy(np.int64)
            slot, of = suffixes(b)
            held.append((slot, place[of], place))
            n += len(slot)
            if n > SUFFIXES:
                yield most(held)
                held, n = [], 0
        if held:
            yield most(held)

    maybe = scratch(judged.mapInPandas(local, "slot long").distinct(), "maybe")
    if not (many := maybe.count()):
        return None
    wanted = parsed.sparkSession.sparkContext.broadcast(np.sort(maybe.toPandas()["slot"].to_numpy(np.int64)) if many <= WANTED else None)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slot, of = suffixes(b)
            if wanted.value is not None:
                some = np.isin(slot, wanted.value)
                slot, of = slot[some], of[some]
            yield pd.DataFrame({"slot": slot, "place": b["place"].to_numpy(np.int64)[of], "article": b["article"].to_numpy(np.int64)[of]})

    rows = judged.mapInPandas(held, "slot long, place long, article long")
    counts = rows.groupBy("slot", "place", "article").agg(F.count("*").alias("n")).groupBy("slot", "place").agg(F.sum("n").alias("on"), F.count("*").alias("in"))
    over = counts.join(hosts, "place").where((F.col("on") * 2 > F.col("pages")) & (F.col("in") * 2 > F.col("articles")) & (F.col("in") >= LEAST))
    found = scratch(over.groupBy("place").agg(F.collect_set("slot").alias("common")), "common")
    many = found.agg(F.sum(F.size("common"))).first()[0] or 0
    return (F.broadcast(found) if many <= WANTED else found) if many else None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tokens: int = TOKENS) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    d = one_name(pages, {"page_id": id_col, "url": url_col, "html": html_col})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, page in zip(b["host"], b["html"], strict=True):
                found = blocks(page)
                stream = "\n".join([t for t, said in found if said != OWN])
                open_ = any(said in (LOOSE, EITHER) for _, said in found)
                sure = None if open_ else "\n\n".join([t for t, said in found if said == OWN])
                texts, marks = zip(*found, strict=True) if open_ else ((), ())
                own = "\n\n".join([t for t, said in found if said == OWN])
                article = (xxhash.xxh64_intdigest(own) or 1) - 2**63 if own else 0
                out.append((sure, list(texts), list(marks), stream, xxhash.xxh64_intdigest(f"{host}\n{stream}") - 2**63, xxhash.xxh64_intdigest(host) - 2**63, article))
            yield b[["page_id", "url", "host"]].assign(**dict(zip(("sure", "blocks", "marks", "stream", "content", "place", "article"), (list(c) for c in zip(*out, strict=True)), strict=True))) if out else pd.DataFrame()

    host = host_and_path(F.col("url"))[0]
    parsed = with_id(d.select("page_id", "url", host.alias("host"), "html"), parse, "page_id long, url string, host string, sure string, blocks array<string>, marks array<int>, stream string, content long, place long, article long", "page_id")
    parsed = scratch(parsed, "parsed")
    of_hosts = common(parsed, tokens)
    parsed = parsed.withColumn("common", F.lit(None).cast("array<long>")) if of_hosts is None else parsed.join(of_hosts, "place", "left")
    alone = parsed.where("sure is null")
    hosts = scratch(alone.select("host").distinct(), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            memo: dict[str, int] = {}
            for host, stream, content in zip(b["host"], b["stream"], b["content"], strict=True):
                slot, key = windows(host, stream.split(), tokens, memo)
                of = np.full(len(slot), content)
                yield slot, of, np.zeros(len(of), np.int64), key

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return alike(parts(batches))

    streams = parsed.select("host", "stream", "content").join(F.broadcast(hosts) if few else hosts, "host", "left_semi")
    rows = streams.mapInPandas(suffixes, "slot long, key long, a long, b long, known boolean")
    covered = held_twice(rows).join(alone.select(F.col("content").alias("a")).distinct(), "a", "left_semi")
    covered = covered.groupBy(F.col("a").alias("of")).agg(F.collect_set("key").alias("keys"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            memo: dict[str, int] = {}
            texts = []
            for host, place, found, marks, stream, keys, often in zip(*(b[c] for c in ("host", "place", "blocks", "marks", "stream", "keys", "common")), strict=True):
                article = own_blocks(None, found, marks)
                stays = iter([True] * len(article) if often is None else trimmed(place, article, often, tokens))
                words = stream.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if keys is not None and len(keys):
                    start = np.flatnonzero(np.isin(windows(host, words, tokens, memo)[1].view(np.int64), np.asarray(keys, np.int64)))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + tokens, -1)
                gone = np.cumsum(gone)[: len(words)] > 0
                kept, at = [], 0
                for block, said in zip(found, marks, strict=True):
                    if said == OWN:
                        kept += [block] if next(stays) else []
                        continue
                    n = len(block.split(" "))
                    own_words, mask = words[at : at + n], gone[at : at + n]
                    at += n
                    if said != OTHER:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                        for i, j in zip(edges[::2], edges[1::2], strict=True):
                            if j - i < min(tokens, n):
                                mask[i:j] = False
                        edges = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(np.int8), [1]])))
                        kept += [" ".join(own_words[i:j]) for i, j in zip(edges[::2], edges[1::2], strict=True)]
                texts.append("\n\n".join(kept))
            yield b[["page_id", "url"]].assign(text=texts)

    rest = alone.join(covered, F.col("content") == F.col("of"), "left").select("page_id", "url", "host", "place", "blocks", "marks", "stream", "keys", "common")
    rest = with_id(rest, own, "page_id long, url string, text string", "page_id")
    out = parsed.where("sure is not null and common is null").select("page_id", "url", F.col("sure").alias("text")).union(rest)
    if of_hosts is not None:

        def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = []
                for place, sure, often in zip(b["place"], b["sure"], b["common"], strict=True):
                    article = own_blocks(sure, None, None)
                    texts.append("\n\n".join(t for t, stays in zip(article, trimmed(place, article, often, tokens), strict=True) if stays))
                yield b[["page_id", "url"]].assign(text=texts)

        told = parsed.where("sure is not null and common is not null").select("page_id", "url", "place", "sure", "common")
        out = out.union(with_id(told, trim, "page_id long, url string, text string", "page_id"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
