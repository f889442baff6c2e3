"""Page noise in the text of scanned PDFs: broken words, misread characters, running headers and page numbers.

Words are judged by a vocabulary with counts, taken from all records that aren't PDF uploads. A word of a PDF that the
vocabulary lacks, or has next to never, gets its candidates by running a Levenshtein automaton (bit-parallel, two errors,
where two characters read as one, or one as two, are one error) over tries of the vocabulary. Tries and words are cut into
parts of bounded size by length, so that no task holds either whole. How characters are confused is learned from the
words whose best candidate is clear; candidates are ranked at each occurrence by these confusions, by frequency and by
how often they follow the word before. Page furniture goes, broken words are joined and lines are put together to
paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvath.session import cut_lineage

MAX_ERRORS = 2
#: Words of one trie, about; a length with more words is cut into several tries.
SHARD_WORDS = 20_000
#: Unknown words that meet one trie in one task, about.
PART_WORDS = 1_000
#: Up to so many misread forms with the word before (some 100 bytes each) are broadcast; more of them are joined.
BROADCAST_FIXES = 200_000
#: The least share of all confusions that a confusion must have.
OP_SHARE = 0.003
#: Bigrams of words are counted in so many buckets by hash: a table of fixed size.
CONTEXT_BUCKETS = 1 << 18
#: A confusion counts as seen where so many different words show it.
MIN_WORDS = 3
#: A word of this share of the vocabulary's words, or less, may be a misread one; then a candidate must be RATIO times as
#: frequent, and follow the word before somewhere.
RARE_SHARE, RATIO = 1e-6, 100
#: A masked line is a form of header where so many documents of one producer, and such a share of them, have it.
FORM_DOCUMENTS, FORM_SHARE = 3, 0.01
_NAME = "¤"
MARKS = "-­‐¬"
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_NUMBER = re.compile(r"(?:[Pp]age|[Ss]eite|[Pp]ágina|[Ss]tr(?:ona)?\.?|[Pp]\.|[Ss]\.|[Сс]тр\.?)?\s*(?:[-–—\[(]\s*)?(\d{1,5})(?:\s*[-–—\])])?(?:\s*(?:\||/|of|von|de|sur|z|из)\s*(\d{1,5}))?")
_ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_BROKEN = re.compile(rf"([^\W\d_]+)([{MARKS}])$")
_BEGINS = re.compile(r"[^\W\d_]+")


def canonical(token: str) -> str:
    """A token as the vocabulary has it: small letters, unless capitals stand inside the word."""
    return token.lower() if token[1:].islower() or token.isupper() or len(token) == 1 else token[0].lower() + token[1:]


class Trie:
    __slots__ = ("root",)

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def near(self, word: str) -> list[tuple[str, int]]:
        """All words of the trie within MAX_ERRORS: the automaton's states go down the trie together with the path.

        Bit i of a state tells that i characters of the word are read: without error (a), with one (b), with two (c). An
        error is an edit, or two characters of one side for one of the other, which looks back at the states before.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << i
        full, accept, mask = (1 << (n + 1)) - 1, 1 << n, at.get
        found = []
        stack = [(self.root, "", 1, 3 & full, 7 & full, 0, 0)]
        while stack:
            node, path, a, b, c, a0, b0 = stack.pop()
            any_b, any_c = a | a << 1 | a << 2 | a0 << 1, b | b << 1 | b << 2 | b0 << 1
            for ch, child in node.items():
                if ch == "":
                    if c & accept:
                        found.append((path, child))
                    continue
                m = mask(ch, 0)
                x = (a & m) << 1
                y = ((b & m) << 1 | any_b | x << 1) & full
                z = ((c & m) << 1 | any_c | y << 1) & full
                if z:
                    stack.append((child, path + ch, x, y, z, a, b))
        return found


def confusions(right: str, read: str) -> list[str] | None:
    """The confusions that turn right into read, as right>misread; None where two words aren't aligned by few of them."""
    ops = []
    for tag, a, b, c, d in SequenceMatcher(None, right, read, autojunk=False).get_opcodes():
        if tag == "replace" and b - a == d - c:
            ops += [f"{x}>{y}" for x, y in zip(right[a:b], read[c:d])]
        elif tag != "equal":
            if tag == "delete" or tag == "insert":  # a confusion needs something on both sides
                return None
            ops.append(f"{right[a:b]}>{read[c:d]}")
    return ops if ops and len(ops) <= MAX_ERRORS else None


def marker(line: str, pages: list[int] | None) -> bool:
    """Whether a line, or what is left of a header line, is the number of one of the chunk's pages.

    Small Roman numbers on a line of their own count pages of a preface, which location_meta doesn't number.
    """
    if _ROMAN.fullmatch(line.strip(" -–—[]()")):
        return True
    m = _NUMBER.fullmatch(line.strip())
    if not m:
        return False
    if not pages:
        return not line.strip().isdigit()
    return int(m[1]) in pages


_ENDS = (re.compile(r"^(\S{1,8}(?: \d{1,5})?(?: (?:of|\|) \d{1,5})?)\s{2,}(.*\S)\s*$"), re.compile(r"^\s*(\S.*?)\s{2,}(\S{1,8}(?: \d{1,5})?(?: (?:of|\|) \d{1,5})?)$"))


def split_marker(line: str, pages: list[int] | None) -> tuple[str, bool]:
    """A line without a page number at its start or end, and whether there was one."""
    for k, p in enumerate(_ENDS):
        if m := p.match(line.strip()):
            number, rest = (m[1], m[2]) if k == 0 else (m[2], m[1])
            if marker(number, pages):
                return rest, True
    return line, False


def letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


class Headers:
    """The running headers that a document may have: its title, its own repeated lines, forms that many documents share."""

    def __init__(self, title: str | None, repeated, forms):
        name = re.sub(r"\.pdf$", "", (title or "").strip(), flags=re.I)
        self.keys = [k for k in [letters(name)] if len(k) >= 8]
        self.name = " ".join(name.lower().split())
        self.repeated = frozenset(repeated if repeated is not None else [])
        # a title made from a file name lacks what isn't ASCII, and may be cut short
        self.slug = letters(re.sub(r"-\d+$", "", name)) if re.fullmatch(r"[a-z0-9-]+", name) else ""
        self.forms = [_form_pattern(f) for f in (forms if forms is not None else [])]

    def match(self, line: str) -> bool:
        own = letters(line)
        if own and (line.strip() in self.repeated or " ".join(line.lower().split()) == self.name):
            return True
        if len(own) < 8:  # too short to be compared by likeness
            return False
        plain = "".join(c for c in own if c.isascii())
        if len(self.slug) >= 8 and (plain == self.slug or len(self.slug) >= 20 and plain.startswith(self.slug) and len(plain) < len(self.slug) + 25):
            return True
        if any(f.fullmatch(line.strip().lower()) for f in self.forms):
            return True
        for key in self.keys:
            if own == key or len(own) >= 16 and len(key) > len(own) and key.startswith(own) and line.strip()[-1] not in ".,;":
                return True
            if 0.75 * len(key) <= len(own) <= 1.25 * len(key) + 2:
                m = SequenceMatcher(None, own, key, autojunk=False)
                if m.quick_ratio() >= 0.84 and m.ratio() >= 0.84:
                    return True
        return False


@cache
def _form_pattern(form: str) -> re.Pattern:
    return re.compile(r"\S+".join(map(re.escape, form.lower().split(_NAME))))


def furniture(lines: list[str], pages: list[int] | None, headers: Headers) -> list[tuple[bool, bool]]:
    """Of every line, whether it holds a running header and whether it holds a page number."""
    out = []
    for i, line in enumerate(lines):
        if not line.strip():
            out.append((False, False))
            continue
        if marker(line, pages):
            near = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            column = line.strip().isdigit() and any(x.isdigit() and not marker(x, pages) for x in near)
            out.append((False, not column))
            continue
        rest, number = split_marker(line, pages)
        header = headers.match(rest)
        if number and not header:  # in text, only a page's number at the edge of a page counts
            number = bool(pages) and any(not 0 <= j < len(lines) or not lines[j].strip() for j in (i - 1, i + 1)) and not any(split_marker(lines[j], pages)[1] for j in (i - 1, i + 1) if 0 <= j < len(lines))
        out.append((header, number))
    return out


def _title_like(line: str) -> bool:
    return 12 <= len(line) <= 100 and len(line.split()) >= 3 and line[0].isupper() and line[-1] not in ".?!…;:,-­¬‐"


def repeats_of(contents: list[str]) -> list[str]:
    """Lines that a document repeats between different neighbours: running headers that needn't be the title.

    A line that looks like a title needs two such places; any other one needs three, all at page edges and on at least
    half of the document's chunks.
    """
    places: dict[str, list[tuple[str, str, bool, int]]] = {}
    for at, text in enumerate(contents):
        lines = [split_marker(line, None)[0].strip() for line in text.split("\n")]
        off = [not x or bool(_NUMBER.fullmatch(x)) for x in lines]
        last = len(lines) - 1
        before, after = [""] * len(lines), [""] * len(lines)
        for i in range(1, len(lines)):
            before[i] = before[i - 1] if off[i - 1] else lines[i - 1]
            after[last - i] = after[last - i + 1] if off[last - i + 1] else lines[last - i + 1]
        for i, line in enumerate(lines):
            if not off[i] and any(c.isalpha() for c in line) and line[-1] not in MARKS:
                edge = i == 0 or i == last or off[i - 1] or off[i + 1]
                places.setdefault(line, []).append((before[i], after[i], edge, at))
    found = []
    for line, v in places.items():
        befores, afters = {a for a, _, _, _ in v}, {b for _, b, _, _ in v}
        if _title_like(line) and len(v) > 1 and len(befores) > 1 and len(afters) > 1 and 2 * sum(e for _, _, e, _ in v) > len(v):
            found.append(line)
        # chunks overlap: what one line has before it, or after it, at two places may be the start or end of a chunk
        elif len(v) > 2 and all(e for _, _, e, _ in v) and max(len(befores - {""}), len(afters - {""})) > 2 and 2 * len({at for _, _, _, at in v}) >= len(contents):
            found.append(line)
    return found


def forms_of(contents: list[str]) -> list[str]:
    """The lines that look like headers, with their names masked."""
    found = set()
    for text in contents:
        for line in text.split("\n"):
            s = split_marker(line, None)[0].strip()
            if _title_like(s) and len(s) <= 60 and not re.search(r"[\d.,;:€“”„«»]", s):
                form = re.sub(r"(?<=\S )[^\W\d_a-zà-ÿ][^\W\d_]*", _NAME, s)
                if _NAME in form and len(form.replace(_NAME, "").split()) >= 3:
                    found.add(form)
    return sorted(found)


class Parsed:
    """A chunk's lines, what is furniture in them, and the words that line ends break."""

    def __init__(self, content: str, pages, headers: Headers, before: str | None, after: str | None):
        self.lines = content.split("\n")
        self.marks = furniture(self.lines, pages, headers)
        for i, (header, number) in enumerate(self.marks):
            if number and not header and not marker(self.lines[i], pages):  # the number goes, the line stays
                self.lines[i] = split_marker(self.lines[i], pages)[0]
        self.body = [i for i, l in enumerate(self.lines) if l.strip() and not self.marks[i][0] and not (self.marks[i][1] and marker(l, pages))]
        self.breaks: list[tuple[int, str, str, str]] = []  # line, first part, mark, second part
        for k, i in enumerate(self.body):
            if m := _BROKEN.search(self.lines[i].rstrip()):
                follows = self.lines[self.body[k + 1]].lstrip() if k + 1 < len(self.body) else (after or "").lstrip()
                second = _BEGINS.match(follows)
                if m[2] != "-" or second and second[0][0].islower() or not follows:
                    self.breaks.append((i, m[1], m[2], second[0] if second else ""))
        self.starts_broken = bool(before and _BROKEN.search(before.rstrip()))

    def words(self) -> Iterator[tuple[str, str]]:
        """Word before and word, of the body with its broken words joined."""
        broken = {i: (first, second) for i, first, _, second in self.breaks}
        last, skip = "", self.starts_broken
        for k, i in enumerate(self.body):
            line = self.lines[i].rstrip()
            tokens = _TOKEN.findall(line)
            if skip and tokens:
                tokens = tokens[1:]
            skip = False
            if i in broken:
                first, second = broken[i]
                tokens = tokens[:-1] if tokens and tokens[-1].endswith(first) else tokens
                if k + 1 < len(self.body):
                    if second:
                        tokens.append(first + second)
                        skip = True
            for t in tokens:
                yield last, t
                last = canonical(t)


def _context(before: str, word: str) -> int:
    return xxhash.xxh32_intdigest(f"{before} {word}".encode("utf-8", "surrogatepass")) % CONTEXT_BUCKETS


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    pairs: Counter = Counter()

    def out() -> pa.RecordBatch:
        hashed: Counter = Counter()
        for (a, b), n in pairs.items():
            hashed[_context(a, b)] += n
        words, n = list(counts), list(counts.values())
        batch = pa.RecordBatch.from_arrays([pa.array(words + [None] * len(hashed), pa.string()), pa.array([None] * len(words) + list(hashed), pa.int32()), pa.array(n + list(hashed.values()), pa.int64())], names=["word", "bucket", "n"])
        counts.clear()
        pairs.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words = [canonical(w) for w in _WORD.findall(text)]
                counts.update(words)
                counts.update(p for w in words if "-" in w for p in w.split("-"))
                pairs.update(zip(words, words[1:]))
            if len(counts) + len(pairs) > 200_000:
                yield out()
    yield out()


_FORMS = "chunk_id string, kind string, form string, other string, before string, n int"


def _forms(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            p = Parsed(r.content, list(r.pages) if r.pages is not None else None, Headers(r.title, r.repeated, r.forms), r.before, r.after)
            if any(h for h, _ in p.marks):
                rows.append((r.chunk_id, "running_header", "", "", "", 1))
            if any(n for _, n in p.marks):
                rows.append((r.chunk_id, "page_number", "", "", "", 1))
            for _, first, mark, second in p.breaks:
                kind = "break" if mark == "-" else "hyphenation"
                rows.append((r.chunk_id, kind, canonical(first + second), canonical(first) + "-" + second.lower(), "", 1))
            for (before, form), n in Counter((b, canonical(t)) for b, t in p.words()).items():
                if not form.isdigit():
                    rows.append((r.chunk_id, "word", form, "", before, n))
        yield pd.DataFrame(rows, columns=["chunk_id", "kind", "form", "other", "before", "n"])


def scanned_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, content, pages, title, repeated, forms, before, after: the chunks of PDF uploads, each id once.

    A document's chunks meet in one group, whose size the length of one document bounds.
    """
    producer = F.coalesce(F.col("doc_metadata")["producer"], F.lit("")) if "doc_metadata" in documents.columns else F.lit("")
    pdf = documents.where("lower(mime_type) like '%pdf%'").select(F.col("id").alias("document_id"), "title", producer.alias("producer")).dropDuplicates(["document_id"])
    own = chunks.where("content is not null and id is not null").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content", F.col("location_meta.pages").alias("pages")).dropDuplicates(["chunk_id"]).join(pdf, "document_id")

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lists = [pa.array([f(x) for x in texts], pa.list_(pa.string())) for f in (repeats_of, forms_of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["document_id", "producer", "repeated", "forms"])

    by_document = own.groupBy("document_id").agg(F.first("producer").alias("producer"), F.array_sort(F.collect_set("content")).alias("texts"))
    heads = cut_lineage(by_document.mapInArrow(repeated, "document_id string, producer string, repeated array<string>, forms array<string>"))
    # A producer's forms: of at least a share of its documents, so at most (lines of a document / FORM_SHARE) of them.
    every = heads.groupBy("producer").agg(F.count(F.lit(1)).alias("documents"))
    frequent = heads.select("producer", F.explode("forms").alias("form")).groupBy("producer", "form").agg(F.count(F.lit(1)).alias("n")).join(every, "producer").where((F.col("n") >= FORM_DOCUMENTS) & (F.col("n") >= FORM_SHARE * F.col("documents")))
    forms = frequent.groupBy("producer").agg(F.array_sort(F.collect_list("form")).alias("forms"))
    heads = heads.drop("forms").join(forms, "producer", "left").select("document_id", "repeated", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"))
    in_order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    tail, head = F.expr("right(content, 60)"), F.expr("left(content, 200)")
    return own.withColumn("before", F.lag(tail).over(in_order)).withColumn("after", F.lead(head).over(in_order)).join(heads, "document_id", "left").select("chunk_id", "content", "pages", "title", "repeated", "forms", "before", "after")


def _retrieve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    trie = Trie(zip(right["word"], right["n"]))
    rows = [(form, own, c, count, ops) for form, own in zip(left["form"], left["own"]) for c, count in trie.near(form) if (not own or count >= RATIO * own) and not _new_letters(c, form) and (ops := confusions(c, form))]
    return pd.DataFrame(rows, columns=["form", "own", "candidate", "count", "ops"])


def _new_letters(right: str, read: str) -> bool:
    """Misread text gets no letters beyond ASCII that the right word lacks; wrongly decoded text does."""
    return any(not c.isascii() and c not in right for c in read)


def corrections(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """form, before, candidate: the misread words with what they were after each word before them.

    forms: form, before, n of the words of the pages; counts: word, bucket, n of the vocabulary and its bigrams.
    """
    words = counts.where("word is not null").select("word", "n")
    vocabulary = words.where("n > 1")
    rare = RARE_SHARE * float(words.agg(F.sum("n").alias("n")).first()["n"] or 0)  # a number
    asked = forms.where(F.length("form") >= 2).groupBy("form", "before").agg(F.sum("n").alias("n"))
    known = words.select(F.col("word").alias("form"), F.col("n").alias("own"))
    unknown = asked.select("form").distinct().join(known, "form", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") <= rare)
    # Words and tries meet in parts of bounded size; every unknown word goes to all tries of its length and up to
    # MAX_ERRORS more or less: a query set against all words, in blocks.
    length = F.length("word").alias("length")
    lengths = vocabulary.groupBy(length).agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_WORDS)).cast("int").alias("shards"))
    near = unknown.withColumn("length", F.explode(F.sequence(F.greatest(F.lit(1), F.length("form") - MAX_ERRORS), F.length("form") + MAX_ERRORS)))
    parts = near.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_WORDS)).cast("int").alias("parts")).join(lengths, "length")  # a row for each length of a word
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = near.join(F.broadcast(parts), "length").select("form", "own", "length", F.pmod(F.hash("form"), "parts").alias("part"), numbers("shards").alias("shard"))
    right = vocabulary.withColumn("length", F.length("word")).join(F.broadcast(parts), "length").select("word", "n", "length", F.pmod(F.hash("word"), "shards").alias("shard"), numbers("parts").alias("part"))
    keys = ["length", "shard", "part"]
    tasks = 8 * forms.sparkSession.sparkContext.defaultParallelism  # little data, much work: not to be merged by size
    found = cut_lineage(left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_retrieve, "form string, own bigint, candidate string, count bigint, ops array<string>"))
    best = found.where("own = 0").groupBy("form").agg(F.max_by("ops", "count").alias("ops"))
    # Confusions are pairs of short strings; those that several words show are kept, and at most a few thousand can be.
    seen = best.select(F.explode(F.array_distinct("ops")).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("words"))
    rate = cut_lineage(seen.where(F.col("words") >= MIN_WORDS))
    total = float(rate.agg(F.sum("words").alias("total")).first()["total"] or 1)
    weighed = (
        found.select("form", "own", "candidate", "count", F.size("ops").alias("needed"), F.explode("ops").alias("op"))
        .join(rate, "op").where(F.col("words") >= OP_SHARE * total)
        .groupBy("form", "own", "candidate", "count", "needed").agg(F.count(F.lit(1)).alias("had"), F.sum(F.log(F.col("words") / F.lit(total))).alias("likely"))
        .where("had = needed")
    )
    # every occurrence's word before decides anew
    placed = weighed.join(asked, "form").withColumn("bucket", _context_column("before", "candidate"))
    with_context = placed.join(counts.where("bucket is not null").select("bucket", F.col("n").alias("together")), "bucket", "left").where("own = 0 or together is not null")
    score = F.log("count") + F.col("likely") + F.log1p(F.coalesce("together", F.lit(0)))
    return with_context.groupBy("form", "before").agg(F.max_by("candidate", F.struct(score, "candidate")).alias("candidate"))


def _context_column(before: str, word: str):
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_context(x or "", y) for x, y in zip(a, b)], dtype="int32")

    return of(before, word)


def page_noise(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """noise (chunk_id, noise, form, before, right), the chunks it was found in (see scanned_chunks) and the vocabulary's counts.

    Null contents and ids are left out, exact duplicate rows count once, null pages take no bare number for a page's;
    empty tables give empty results.
    """
    pages = cut_lineage(scanned_chunks(documents, chunks))
    forms = cut_lineage(pages.mapInPandas(_forms, _FORMS))
    texts = documents.where("raw_content is not null and (mime_type is null or lower(mime_type) not like '%pdf%')").select("raw_content")
    counts = cut_lineage(texts.mapInArrow(_vocabulary, "word string, bucket int, n bigint").groupBy("word", "bucket").agg(F.sum("n").alias("n")))
    words = counts.where("word is not null").select("word", "n")

    plain = forms.where("kind in ('running_header', 'page_number')").select("chunk_id", F.col("kind").alias("noise"), F.lit("").alias("form"), F.lit("").alias("before"), F.lit("").alias("right"))
    sure = forms.where("kind = 'hyphenation'").select("chunk_id", F.col("kind").alias("noise"), F.col("other").alias("form"), F.lit("").alias("before"), F.col("form").alias("right"))
    breaks = (
        forms.where("kind = 'break'").select("chunk_id", "form", "other")
        .join(words.select(F.col("word").alias("form"), F.col("n").alias("joined")), "form", "left")
        .join(words.select(F.col("word").alias("other"), F.col("n").alias("apart")), "other", "left")
        .where(F.coalesce("joined", F.lit(0)) >= F.coalesce("apart", F.lit(0)))
        .select("chunk_id", F.lit("hyphenation").alias("noise"), F.col("other").alias("form"), F.lit("").alias("before"), F.col("form").alias("right"))
    )
    fixes = cut_lineage(corrections(forms.where("kind = 'word'").select("form", "before", "n"), counts))
    misread = forms.where("kind = 'word'").select("chunk_id", "form", "before").join(F.broadcast(fixes) if fixes.count() <= BROADCAST_FIXES else fixes, ["form", "before"]).select("chunk_id", F.lit("misread").alias("noise"), "form", "before", F.col("candidate").alias("right"))
    return plain.unionByName(sure).unionByName(breaks).unionByName(misread).distinct(), pages, counts


def _shaped(token: str, right: str) -> str:
    return right.upper() if token.isupper() and len(token) > 1 else right[0].upper() + right[1:] if token[0].isupper() else right


def reflow(content: str, pages, headers: Headers, before, after, joins: set[str], fixes: dict[tuple[str, str], str]) -> str:
    """Paragraphs of one line each: without furniture, with broken words joined and misread words put right.

    fixes: by the word before and the misread word.
    """
    p = Parsed(content, pages, headers, before, after)
    broken = {i: (mark, canonical(first) + "-" + second.lower()) for i, first, mark, second in p.breaks}
    body = set(p.body)
    out, paragraph, glue, blank, last = [], "", "", False, ""
    alone = {form: right for (_, form), right in fixes.items()}

    def put(m: re.Match) -> str:
        nonlocal last
        before, last = last, canonical(m.group())
        right = fixes.get((before, last)) or alone.get(last)
        return _shaped(m.group(), right) if right else m.group()

    def close() -> None:
        nonlocal paragraph
        if paragraph.strip():
            out.append(_TOKEN.sub(put, paragraph.strip()))
        paragraph = ""

    for i, line in enumerate(p.lines):
        if i not in body:
            blank = blank or not line.strip() and not glue and not paragraph.rstrip().endswith(tuple(MARKS)) and _ended(paragraph)
            continue
        s = line.strip()
        if blank or s.startswith(("- ", "* ", "• ")):
            if not glue:
                close()
        blank = False
        paragraph = paragraph + (glue or (" " if paragraph else "")) + s if glue != "join" else paragraph + s
        glue = ""
        if i in broken:
            mark, key = broken[i]
            if mark != "-" or key in joins:
                paragraph = paragraph.rstrip()[:-1]
            glue = "join"
    close()
    return "\n\n".join(out)


def _ended(paragraph: str) -> bool:
    return not paragraph.strip() or paragraph.rstrip()[-1] in ".?!…:;”\"»’)"


def cleaned(noise: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, content, noises: every chunk of a PDF as continuous paragraphs; a chunk without noise is reflowed alike."""
    pair = F.struct("before", "form", "right")
    own = noise.groupBy("chunk_id").agg(
        F.array_sort(F.collect_set("noise")).alias("noises"),
        F.collect_list(F.when(F.col("noise") == "hyphenation", F.col("form"))).alias("joins"), F.collect_list(F.when(F.col("noise") == "misread", pair)).alias("fixes"),
    )

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [
                reflow(r.content, None if r.pages is None else list(r.pages), Headers(r.title, r.repeated, r.forms), r.before, r.after, set(r.joins if r.joins is not None else ()), {(x["before"], x["form"]): x["right"] for x in (r.fixes if r.fixes is not None else ())})
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "content": text, "noises": [list(x) if x is not None else [] for x in pdf["noises"]]})

    return pages.join(own, "chunk_id", "left").mapInPandas(rows, "chunk_id string, content string, noises array<string>")
