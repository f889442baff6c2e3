"""The main content of web pages: wrappers per host, inferred by aligning the token streams of its pages.

A line's tokens are its masked forms (numbers; names; the prefix of a path), counted per host over all its pages. Lines
that stand on a large enough share of a host's pages may be the constant tokens of its wrapper; so may, on hosts too
small to tell, forms that are constant on most of the hosts that have them. Groups of a host's pages are aligned one after the other with the wrapper
found so far: tokens that one side lacks become optional, what comes again becomes repeated, what differs becomes a text
slot, and a constant that heads a run of short slots becomes the head of a list. Partial wrappers of a host are added up.
Every page is aligned with the wrapper again, its title being a token too: what is found at its place on enough pages is
a token of the wrapper, and a slot between two tokens that holds only
short lines on nearly all pages, and not what follows the title, is a slot of noise. What a page's lines match of the
wrapper, the lists under its heads and its slots of noise aren't the article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvath.session import cut_lineage

#: A form is constant on a host with so many pages and such a share of its pages; the second pair is for small hosts.
CONSTANT = ((5, 0.08), (4, 0.4))
#: Pages of one group, on average: a host's pages are spread over groups of bounded size.
GROUP_PAGES = 1_000
LIST_SHARE = 0.5
#: A form is a token of the wrapper where the alignment finds it at its place on such a share of the pages that have it.
PLACED_SHARE = 0.25
#: A form is constant wherever it is seen if it is so on such a share of the hosts that have it and can tell: the one, or two at least.
GENERAL_SHARE = 0.5
#: The share of its pages on which a slot of noise may hold a sentence.
SENTENCE_SHARE = 0.05
#: Tokens of a text slot, of the page's title, and of the page's start and end; what stands for any token.
SLOT, TITLE, EDGE, ANY = 1, 2, 3, 0
_SENTENCE = re.compile(r"[.!?…。][\"'”’»)“]*$")
_BULLET = re.compile(r"^(?:[-*•·]|\d+[.)])\s+")
_NAME = re.compile(r"(?<![^\W\d_’'-])[^\W\d_a-zß-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def forms(line: str) -> list[str]:
    """The masked forms of a line; none for a blank one."""
    s = " ".join(line.split())
    if not s:
        return []
    s = re.sub(r"\d+", "0", s)
    out = [_plain(s.lower())]
    if " > " in s and len(s) <= 160:
        out.append("p:" + s.rpartition(" > ")[0].lower())
    return out


def name_form(line: str) -> str | None:
    """A byline's form: its names masked."""
    s = re.sub(r"\d+", "0", " ".join(line.split()))
    if not is_short(line) or _BULLET.match(s) or s.isupper():
        return None
    named = re.sub(r"¤(?: ¤)+", "¤", _NAME.sub("¤", s))
    return "n:" + _plain(named.lower()) if "¤" in named and sum(c.isalpha() for c in named) >= 2 else None


def items(line: str) -> list[str]:
    """The entries of a line of navigation: what separators part, or the words of a short line."""
    s = " ".join(line.split())
    if len(s) > 120 or _SENTENCE.search(s):
        return []
    parts = [x for x in (re.sub(r"\(/[^)]*\)", "", y).strip(" -*•[]") for y in re.split(r"[|·>/\[\]]|\s{2,}", line.strip())) if x]
    if len(parts) < 2:
        words = s.strip("-*• ").split()
        parts = words if 3 <= len(words) <= 10 else [" ".join(words)] if words else []
    return ["i:" + _plain(x.lower()) for x in parts]


def _plain(s: str) -> str:
    """What isn't ASCII as one mark, where most letters are ASCII: wrongly decoded lines keep their form."""
    ascii_letters = sum(c.isalpha() for c in s if c.isascii())
    return _FOREIGN.sub("¿", s) if ascii_letters >= 6 and ascii_letters >= 0.6 * sum(c.isalpha() for c in s) else s


def is_short(line: str) -> bool:
    s = line.strip()
    return len(s) <= 110 and not _SENTENCE.search(s)


def _same(line: str | None) -> str:
    return " ".join((line or "").split()).lower()


def blocks_of(lines: list[str]) -> list[list[int]]:
    out, now = [], []
    for i, line in enumerate(lines):
        if line.strip():
            now.append(i)
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def pages_of(documents: DataFrame, sites: DataFrame) -> DataFrame:
    """host, document_id, title, text and group of the web documents with text; a page without a site has host ''.

    sites: document_id, domain; where a document has several domains, the least is its host.
    """
    one = sites.groupBy("document_id").agg(F.min("domain").alias("host"))
    web = documents.where("source_type = 'web' and raw_content is not null and id is not null").select(F.col("id").alias("document_id"), "title", F.col("raw_content").alias("text")).dropDuplicates(["document_id"])
    pages = web.join(one, "document_id", "left").withColumn("host", F.coalesce("host", F.lit("")))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return pages.join(hosts, "host").select("host", "document_id", "title", "text", "host_pages", F.pmod(F.xxhash64("document_id"), F.ceil(F.col("host_pages") / F.lit(GROUP_PAGES))).cast("int").alias("part"))


def _tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, n, title, text in zip(pdf["host"], pdf["host_pages"], pdf["title"], pdf["text"]):
            lines = text.split("\n")
            found = {f for line in lines for f in forms(line)} | {x for line in lines for x in items(line)}
            own = _same(title)
            for a, b in zip(lines, lines[1:]):
                if own and _same(a) == own and (f := name_form(b)):
                    found.add(f)
            rows += [(host, n, _hash(f)) for f in found]
        yield pd.DataFrame(rows, columns=["host", "host_pages", "token"])


def constants(pages: DataFrame) -> DataFrame:
    """host, token of the forms that are constant: on this host, or on most hosts and seen here."""
    counted = pages.select("host", "host_pages", "title", "text").mapInPandas(_tokens, "host string, host_pages bigint, token bigint").groupBy("host", "host_pages", "token").agg(F.count(F.lit(1)).alias("n"))
    (least, share), (least_small, share_small) = CONSTANT
    frequent = ((F.col("n") >= least) & (F.col("n") >= share * F.col("host_pages"))) | ((F.col("n") >= least_small) & (F.col("n") >= share_small * F.col("host_pages")))
    counted = cut_lineage(counted.withColumn("frequent", frequent))
    can_tell = F.col("host_pages") >= least_small
    general = counted.groupBy("token").agg(F.count_if("frequent").alias("constant_on"), F.count_if(can_tell).alias("seen_on")).where("constant_on >= 2 or constant_on = 1 and seen_on = 1").where(F.col("constant_on") >= GENERAL_SHARE * F.col("seen_on"))
    elsewhere = counted.where("not frequent").select("host", "token").join(general.select("token"), "token", "left_semi").select("host", "token")
    return counted.where("frequent").select("host", "token").unionByName(elsewhere)


class Page:
    """A page's lines, their constant tokens (0 where none), and its token stream: constants, and 1 for a text slot."""

    def __init__(self, text: str, known: set[int]):
        self.lines = text.split("\n")
        self.token = [next((h for f in forms(line) if (h := _hash(f)) in known), 0) for line in self.lines]
        self.blocks = blocks_of(self.lines)
        for i, line in enumerate(self.lines):
            if not self.token[i] and len(entries := items(line)) >= 3 and all(_hash(x) in known for x in entries):
                self.token[i] = _hash(entries[0])
        for b in self.blocks:
            if len(b) >= 2 and not self.token[b[0]] and not self.token[b[1]] and is_short(self.lines[b[0]]) and (f := name_form(self.lines[b[1]])) and _hash(f) in known:
                self.token[b[1]] = _hash(f)
        self.stream: list[int] = []
        for b in self.blocks:
            for i in b:
                t = self.token[i] or 1
                if t != 1 or not self.stream or self.stream[-1] != 1:
                    self.stream.append(t)

    def heads(self) -> Iterator[tuple[int, bool]]:
        """Of each constant, whether short slots follow it in its block."""
        for b in self.blocks:
            for k, i in enumerate(b):
                if self.token[i]:
                    yield self.token[i], k + 1 < len(b) and not self.token[b[k + 1]] and is_short(self.lines[b[k + 1]])


def align(wrapper: list[int], stream: list[int]) -> list[int]:
    """The wrapper with the stream's further tokens at their places, each token once: a union-free sequence of optionals."""
    out, have = [], set(wrapper) - {1}
    for tag, a, b, c, d in SequenceMatcher(None, wrapper, stream, autojunk=False).get_opcodes():
        out += wrapper[a:b]
        if tag in ("insert", "replace"):
            for t in stream[c:d]:
                if t == 1 and (not out or out[-1] != 1):
                    out.append(1)
                elif t != 1 and t not in have:
                    have.add(t)
                    out.append(t)
    return [t for k, t in enumerate(out) if t != 1 or k == 0 or out[k - 1] != 1]


def parsed(page: Page, title: str | None, wrapper: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """The page's tokens and lines in their order, and which of them the alignment finds at their place in the wrapper."""
    own = _same(title)
    stream = [(TITLE if own and _same(page.lines[i]) == own else page.token[i], i) for b in page.blocks for i in b]
    fixed = [k for k, (t, _) in enumerate(stream) if t and t != TITLE]
    at: set[int] = set()
    for a, b, n in SequenceMatcher(None, [t for t in wrapper if t != SLOT], [stream[k][0] for k in fixed], autojunk=False).get_matching_blocks():
        at.update(fixed[b : b + n])
    return stream, at


def slots_of(stream: list[tuple[int, int]], at: set[int]) -> Iterator[tuple[int, int, list[int]]]:
    """The text slots of a parsed page as left token, right token and lines.

    A constant that the alignment leaves over, as it stands against the wrapper's order, parts no slots unless it comes
    again at its place.
    """
    left, lines = EDGE, []
    for k, (t, i) in enumerate(stream):
        if t == TITLE or k in at:
            if lines:
                yield left, t, lines
            left, lines = t, []
        elif not t:
            lines.append(i)
    if lines:
        yield left, EDGE, lines


def _infer(pages: pd.DataFrame, tokens: pd.DataFrame, aligned: Callable[[list[int], list[int]], list[int]]) -> pd.DataFrame:
    columns = ["host", "token", "place", "pages", "present", "placed", "again", "followed", "seen", "right"]
    if not len(pages):
        return pd.DataFrame([], columns=columns)
    known = set(tokens["token"].tolist())
    streams: Counter = Counter()
    present, again, followed, seen = Counter(), Counter(), Counter(), Counter()
    kept = []
    for text in pages["text"]:
        page = Page(text, known)
        kept.append(page)
        streams[tuple(page.stream)] += 1
        own = Counter(t for t in page.stream if t != 1)
        present.update(own.keys())
        again.update(t for t, n in own.items() if n > 1)
        for t, follows in page.heads():
            seen[t] += 1
            followed[t] += follows
    wrapper: list[int] = []
    for stream, _ in sorted(streams.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        if not set(stream) <= set(wrapper):
            wrapper = aligned(wrapper, list(stream))
    host = pages["host"].iloc[0]
    slots, sentences, several, placed = Counter(), Counter(), Counter(), Counter()
    for page, title in zip(kept, pages["title"]):
        own: dict[tuple[int, int], list[int]] = {}
        stream, at = parsed(page, title, wrapper)
        placed.update({stream[k][0] for k in at})
        for left, right, lines in slots_of(stream, at):
            own.setdefault((left, right), []).extend(lines)
        slots.update(own.keys())
        sentences.update(k for k, lines in own.items() if any(not is_short(page.lines[i]) for i in lines))
        several.update(k for k, lines in own.items() if len(lines) > 1 or k[1] == TITLE)
    rows = [(host, t, k / max(1, len(wrapper) - 1), len(pages), present[t], placed[t], again[t], followed[t], seen[t], ANY) for k, t in enumerate(wrapper) if t != 1]
    rows += [(host, left, 0.0, len(pages), n, n, sentences[left, right], several[left, right], n, right) for (left, right), n in slots.items() if left != TITLE]
    return pd.DataFrame(rows, columns=columns)


_WRAPPER = "host string, token bigint, place double, pages bigint, present bigint, placed bigint, again bigint, followed bigint, seen bigint, right bigint"


def _spread(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """A host's rows, once for every group of its pages; host and group as of_host and of_part."""
    parts = pages.select(F.col("host").alias("of_host"), F.col("part").alias("of_part")).distinct()
    return rows.withColumnRenamed("host", "of_host").join(parts, "of_host")


def partial_wrappers(pages: DataFrame, aligned: Callable[[list[int], list[int]], list[int]] = align) -> DataFrame:
    """The wrapper of every group of a host's pages: a row per token, and one per text slot, which has a right token.

    Of a slot, again counts the pages on which it holds a sentence, followed those on which it holds several lines.
    """
    tokens = _spread(constants(pages), pages)
    own = pages.select("host", "part", "title", "text")
    return own.groupBy("host", "part").cogroup(tokens.groupBy("of_host", "of_part")).applyInPandas(lambda a, b: _infer(a, b, aligned), _WRAPPER)


def noise_slots(partial: DataFrame, pages: DataFrame) -> DataFrame:
    """host, token, right of the slots of noise: frequent between two tokens, or, with right ANY, after the left one.

    A single short line may be a heading of the article, so most of a slot's pages must hold several, unless the title follows.
    """
    (least, share), (least_small, share_small) = CONSTANT
    hosts = pages.groupBy("host").agg(F.first("host_pages").alias("host_pages"))
    slots = partial.where(F.col("right") != ANY).groupBy("host", "token", "right").agg(F.sum("present").alias("n"), F.sum("again").alias("sentences"), F.sum("followed").alias("several")).join(hosts, "host")
    frequent = ((F.col("n") >= least) & (F.col("n") >= share * F.col("host_pages"))) | ((F.col("n") >= least_small) & (F.col("n") >= share_small * F.col("host_pages")))
    listed = frequent & (F.col("sentences") <= SENTENCE_SHARE * F.col("n")) & (F.col("several") >= LIST_SHARE * F.col("n"))
    after = slots.where(F.col("token") != EDGE).groupBy("host", "host_pages", "token").agg(F.sum("n").alias("n"), F.sum("sentences").alias("sentences"), F.sum("several").alias("several")).where(listed)
    return slots.where(listed).select("host", "token", "right").unionByName(after.select("host", "token", F.lit(ANY).cast("bigint").alias("right")))


def wrappers(pages: DataFrame, partial: DataFrame | None = None) -> DataFrame:
    """host, token, place, pages, present, optional, repeated, list_head: the wrapper of every host, by place.

    A form may be frequent and still be no token: what the alignment seldom finds at its place is text that comes again.
    """
    partial = partial_wrappers(pages) if partial is None else partial
    whole = partial.where(F.col("right") == ANY).groupBy("host", "token").agg(F.avg("place").alias("place"), *[F.sum(c).alias(c) for c in ("pages", "present", "placed", "again", "followed", "seen")])
    return whole.where(F.col("placed") >= PLACED_SHARE * F.col("present")).select(
        "host", "token", F.round("place", 4).alias("place"), "pages", "present", (F.col("present") < F.col("pages")).alias("optional"), (F.col("again") > 0).alias("repeated"),
        (F.col("followed") >= LIST_SHARE * F.col("seen")).alias("list_head"),
    )


def noise_lines(text: str, title: str | None, known: set[int], heads: set[int], wrapper: list[int] | None = None, slots: set[tuple[int, int]] = frozenset()) -> list[int]:
    """Numbers, from 1, of the non-blank lines that aren't the article's.

    wrapper: the host's tokens by place; slots: left and right token of the slots of noise, right ANY after any page's left one.
    """
    page = Page(text, known)
    lines, token = page.lines, page.token
    own = _same(title)
    noise = set()
    for b in page.blocks:
        hit = [i for i in b if token[i]]
        is_title = [_same(lines[i]) == own for i in b]
        if not hit:
            if is_title[0] and len(b) == 2 and is_short(lines[b[1]]):  # a title's second line is its byline
                noise.add(b[1])
            continue
        under = False
        for k, i in enumerate(b):
            if token[i] and not is_title[k]:
                noise.add(i)
                under = token[i] in heads
            elif is_title[k]:
                under = False
            elif under and is_short(lines[i]):
                noise.add(i)
            elif k and 2 * len(hit) >= len(b):  # among a block of constants
                noise.add(i)
            elif not k and len(b) > 2 and len(hit) == len(b) - 1:
                noise.add(i)
    begun = any(own and _same(line) == own for line in lines)  # else the title may stand in any slot before the text
    for left, right, slot in slots_of(*parsed(page, title, wrapper)) if slots else ():
        begun = begun or any(not is_short(lines[i]) for i in slot)
        if begun and (len(slot) > 1 or right == TITLE) and ((left, right) in slots or (left, ANY) in slots) and all(is_short(lines[i]) for i in slot):
            noise.update(slot)
    return sorted(i + 1 for i in noise)


def _classify(pages: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    tokens = wrapper[wrapper["list_head"].notna()].sort_values(["place", "token"])
    order = tokens["token"].tolist()
    known = set(order)
    heads = set(tokens.loc[tokens["list_head"].astype(bool), "token"].tolist()) if len(tokens) else set()
    listed = wrapper[wrapper["list_head"].isna()]
    slots = set(zip(listed["token"].tolist(), listed["right"].tolist()))
    found = [(d, noise_lines(text, title, known, heads, order, slots), text) for d, title, text in zip(pages["document_id"], pages["title"], pages["text"])]
    article = []
    for _, noise, text in found:
        drop = set(noise)
        article.append(re.sub(r"\n{3,}", "\n\n", "\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in drop)).strip("\n"))
    return pd.DataFrame({"document_id": [d for d, _, _ in found], "noise": [n for _, n, _ in found], "article": article})


def extract(documents: DataFrame, sites: DataFrame, aligned: Callable[[list[int], list[int]], list[int]] = align) -> tuple[DataFrame, DataFrame]:
    """(document_id, noise, article) of every web document with text, and the wrappers of their hosts.

    noise: the numbers, from 1, of the non-blank lines that don't belong to the article. Empty texts have an empty
    article; null texts and null ids are left out, a repeated id counts once; empty tables give empty results. A host
    that holds a third of all pages is spread over groups of bounded size in every step.
    """
    pages = cut_lineage(pages_of(documents, sites))
    partial = cut_lineage(partial_wrappers(pages, aligned))
    found = cut_lineage(wrappers(pages, partial))
    none = F.lit(None)
    known = found.select("host", "token", "place", "list_head", F.lit(ANY).cast("bigint").alias("right")).unionByName(
        noise_slots(partial, pages).select("host", "token", none.cast("double").alias("place"), none.cast("boolean").alias("list_head"), "right")
    )
    spread = _spread(known, pages)
    out = pages.select("host", "part", "document_id", "title", "text").groupBy("host", "part").cogroup(spread.groupBy("of_host", "of_part")).applyInPandas(_classify, "document_id string, noise array<int>, article string")
    return out, found
