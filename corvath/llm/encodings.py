"""Text decoded with a wrong code page: found and restored.

A swap is a pair of code pages: the bytes of one were read with the other. It acts on text as a substitution cipher whose
symbols are characters (or, where the true encoding has several bytes, short character sequences). Which swap a line
went through, if any, is the hidden variable of an expectation-maximisation: the expectation step weighs every swap by
the bigrams of the text it would give against those of the text as it stands, the maximisation step counts bigrams anew
from the texts so weighed, and how often each swap occurs. The first bigrams come from the whole corpus, in which right
text prevails. In a record the swaps' shares are learned from the record's own lines, starting from the corpus's. The
learned swap of a line is applied with translate(), or by sequence where letters have several bytes.

Known code pages are only the start. A source much of whose text is written in runs that no other source has, and that
are improbable, is taken for a cipher of its own: which letter each of its symbols stands for is learned by
expectation-maximisation of a hidden Markov chain over the corpus's bigrams, starting with no letter preferred, and kept
where the text so read is about as probable as right text. It is applied with translate(), too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvath.session import cut_lineage

# Code pages by the names of Python's codecs. READ are those that text may have been read with, TRUE those
# of one byte per letter that it may have been written in; wide ones are tried on whole lines.
READ = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859_2", "koi8_r", "cp866", "cp1254", "iso8859_15")
TRUE = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "iso8859_2", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic", "cp1253", "cp1254")
WIDE = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Bigrams are counted in so many buckets by hash: the model's size doesn't grow with the corpus.
BUCKETS = 1 << 18
ROUNDS = 2
#: A swap is accepted where its odds against the text as it stands exceed this, in nats.
MARGIN = 1.0
MEMO_RUNS = 60_000
#: A run is a riddle where a bigram of it is so many nats less probable than usual, and no other source has it.
RIDDLE = 1.5
#: A source may be a cipher where so many symbols stand so often in riddles, and in such a share of its runs.
SYMBOLS, OCCURRENCES, RIDDLE_SHARE = 4, 50, 0.3
#: The letters that a symbol may stand for: the most frequent ones beyond ASCII.
LETTERS = 300
CIPHER_ROUNDS = 6
#: Ciphers of up to so many sources (a few kilobytes each) are broadcast; more of them are joined.
BROADCAST_SOURCES = 1_000
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = "�"


@cache
def table_of(page: str) -> dict[str, int]:
    """Character to byte of the upper half of a code page; bytes it leaves open stand for control characters."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    if page == "cp1252":  # also what was read as ISO 8859-1
        out.update({chr(b): b for b in range(128, 160)})
    return out


@cache
def single_swap(read: str, true: str) -> dict[int, str]:
    """For translate(): the characters of `read` to those of `true` at the same byte."""
    out = {}
    for c, b in table_of(read).items():
        try:
            to = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        if to != c:
            out[ord(c)] = to
    return out


def _class(bytes_: Iterable[int], read: str) -> str:
    wanted = set(bytes_)
    return "[" + "".join(re.escape(c) for c, b in table_of(read).items() if b in wanted) + "]"


@cache
def utf8_pattern(read: str) -> re.Pattern:
    """The sequences of `read`'s characters that are letters of UTF-8."""
    more = _class(range(0x80, 0xC0), read)
    return re.compile(f"{_class(range(0xC2, 0xE0), read)}{more}|{_class(range(0xE0, 0xF0), read)}{more}{{2}}|{_class(range(0xF0, 0xF5), read)}{more}{{3}}")


def undo_utf8(text: str, read: str) -> str:
    table = table_of(read)

    def letter(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return utf8_pattern(read).sub(letter, text)


def undo_wide(text: str, read: str, true: str) -> str:
    table = table_of(read)
    try:
        data = b"".join(bytes([table[c]]) if c in table else c.encode("ascii") for c in text)
        return data.decode(true)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def _swaps() -> list[tuple[str, ...]]:
    found: list[tuple[str, ...]] = [("utf8", r) for r in READ] + [("utf8 twice", r) for r in READ[:3]]
    seen = set()
    for r in READ:
        for t in TRUE:
            if t != r and (key := frozenset(single_swap(r, t).items())) not in seen and key:
                seen.add(key)
                found.append(("single", r, t))
    return found


SWAPS = _swaps()
_WIDE_SWAPS = [("wide", "cp1252", t) for t in WIDE]
ALL_SWAPS = SWAPS + _WIDE_SWAPS
_OWN = len(ALL_SWAPS)


def undo(text: str, swap: tuple[str, ...]) -> str:
    kind, read = swap[:2]
    if kind == "utf8":
        return undo_utf8(text, read)
    if kind == "utf8 twice":
        return undo_utf8(undo_utf8(text, read), read)
    if kind == "single":
        return text.translate(single_swap(read, swap[2]))
    return undo_wide(text, read, swap[2])


@lru_cache(4096)
def readings(c: str) -> list[str]:
    """What a single character is when each swap is undone."""
    return [undo(c, s) for s in SWAPS]


def plain(c: str) -> str:
    """A neighbour as the bigrams have it: letters in lower case, any digit as 0, white space as a blank."""
    return "0" if c.isdigit() else " " if c.isspace() or c in "\x00" else c.lower() if c.isascii() else c


@lru_cache(MEMO_RUNS)
def bucket(pair: str) -> int:
    return xxhash.xxh32_intdigest(pair.encode("utf-8", "surrogatepass")) % BUCKETS


def bigrams(before: str, run: str, after: str) -> list[int]:
    s = before + run + after
    return [bucket(s[i : i + 2]) for i in range(len(s) - 1)]


def runs_of(line: str) -> Iterator[tuple[str, str, str]]:
    """Every run of characters beyond ASCII, with its neighbours."""
    n = len(line)
    for m in _RUN.finditer(line):
        s, e = m.span()
        yield plain(line[s - 1]) if s else " ", m.group(), plain(line[e]) if e < n else " "


class Model:
    """Bigram counts by bucket, and the share of every swap."""

    def __init__(self, counts: dict[int, float], shares: list[float], active: list[int]):
        self.active = active
        self.total = sum(counts.values()) or 1.0
        self.counts = counts
        self.pairs: dict[str, float] = {}
        self.rest = float(np.log(self.total))
        self.top = float(np.log(max(counts.values(), default=0.0) + 0.05)) - self.rest
        self.usual = sum(n * (float(np.log(n + 0.05)) - self.rest) for n in counts.values()) / self.total
        self.prior = np.log(np.append(shares, 0.0) + 1e-9)  # and of a source's own cipher
        self.none = float(np.log(max(1e-3, 1 - sum(shares))))
        self.memo: dict[tuple[str, str, str], dict[int, float]] = {}

    def pair(self, pair: str) -> float:
        """The log frequency of a bigram; capitals are also backed by their small letters."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= MEMO_RUNS:
                self.pairs.clear()
            n, low = self.counts.get(bucket(pair), 0.0), pair.lower()
            if low != pair:
                n += 0.02 * self.counts.get(bucket(low), 0.0)
            self.pairs[pair] = found = float(np.log(n + 0.05)) - self.rest
        return found

    def value(self, before: str, text: str, after: str) -> float:
        s, pair = before + text + after, self.pair
        # a shorter text has fewer factors, each of them below 1
        return sum(pair(s[i : i + 2]) for i in range(len(s) - 1))

    def gains(self, run: tuple[str, str, str]) -> dict[int, float]:
        """By swap: how much likelier the run is when it is undone. Swaps that change nothing are left out."""
        known = self.memo.get(run)
        if known is None:
            if len(self.memo) >= MEMO_RUNS:
                self.memo.clear()
            before, text, after = run
            known, now, by_text = {}, self.value(*run), {}
            one = readings(text) if len(text) == 1 else None
            for k in self.active:
                to = undo(text, SWAPS[k]) if one is None else one[k]
                if to != text:
                    if to not in by_text:
                        by_text[to] = self.value(before, to, after) - now
                    known[k] = by_text[to]
            if len(text) <= 40:
                self.memo[run] = known
        return known

    def odds(self, run: tuple[str, str, str]) -> dict[int, float]:
        """By swap: its log odds against none; nothing where the run is so probable that no text could be much more so."""
        most = ((len(run[1]) + 3) // 4 + 1) * self.top - self.value(*run)  # the shortest and likeliest text it could stand for
        if most + self.prior.max() - self.none < -7:
            return {}
        return {k: g + self.prior[k] - self.none for k, g in self.gains(run).items()}

    def line(self, line: str) -> dict[int, float]:
        if len(line) > 8 and line[1::2].count(" ") > 0.4 * len(line):
            line = line[::2]  # letters set apart
        total: dict[int, float] = {}
        runs, high = 0, 0
        for run in runs_of(line):
            runs += 1
            high += len(run[1])
            for k, g in self.gains(run).items():
                total[k] = total.get(k, 0.0) + g
        if high >= 4 and 4 * high >= len(line) and any(c in _WIDE_MARKS for c in line):
            now = sum(self.value(*r) for r in runs_of(line))
            for k, swap in enumerate(_WIDE_SWAPS, len(SWAPS)):
                to = undo(line, swap)
                if to != line:
                    total[k] = sum(self.value(*r) for r in runs_of(to)) - now
        return total

    def best(self, gains: dict[int, float], bonus: np.ndarray) -> tuple[int, float]:
        """The likeliest swap and its log odds against none."""
        k = max(gains, key=lambda j: gains[j] + bonus[j])
        return k, gains[k] + bonus[k] - self.none


_WIDE_MARKS = frozenset(chr(b) for b in range(0x80, 0xA0)) | frozenset("‚ƒ„…†‡ˆ‰Š‹ŒŽ¤¥¡£¢°ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö")


def restore(text: str, model: Model, cipher: dict[int, str] | None = None) -> tuple[str, int, int, list[int]]:
    """Restored text, wrongly decoded lines, lines with characters lost for good, and the swaps that were undone.

    cipher: what the symbols of the text's source stand for, if it has a cipher of its own; number len(ALL_SWAPS) of the swaps.
    """
    if text.isascii():
        return text, 0, 0, []
    lines = text.split("\n")
    gains = {i: model.line(line) for i, line in enumerate(lines) if not line.isascii()}
    for i, g in gains.items() if cipher else ():
        if lines[i].translate(cipher) != lines[i]:
            g[_OWN] = sum(model.value(b, r.translate(cipher), a) - model.value(b, r, a) for b, r, a in runs_of(lines[i])) - model.prior[_OWN] + model.none
    gains = {i: g for i, g in gains.items() if g}
    # a record's own shares: swaps that its lines show beyond doubt are likelier in its other lines
    weight = np.zeros(len(ALL_SWAPS) + 1)
    for g in gains.values():
        k, odds = model.best(g, model.prior)
        if odds > MARGIN:
            weight[k] += 1 / (1 + np.exp(-min(odds, 50)))
    bonus = np.logaddexp(model.prior, np.log(weight / (len(gains) + 1) + 1e-12))
    wrong, lost, used = 0, 0, set()
    for i, g in gains.items():
        k, odds = model.best(g, bonus)
        if odds > MARGIN:
            lines[i] = lines[i].translate(cipher) if k == _OWN else undo(lines[i], ALL_SWAPS[k])
            wrong += 1
            used.add(k)
    lost = sum(_LOST in line for line in lines)
    return "\n".join(lines), wrong, lost, sorted(used)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.string()) for j in range(4)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["source", "before", "run", "after", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for source, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text and not text.isascii():
                counts.update((source, *r) for r in runs_of(text))
            if len(counts) > 100_000:
                yield out()
    yield out()


def _expect(sent):
    """Bigram counts (kind 0), swap counts (kind 1) and runs that a swap explains best (kind 2) from runs, weighed by the broadcast model, if there is one."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        shares: Counter = Counter()
        clear: Counter = Counter()
        own = sent.value
        for batch in batches:
            for before, run, after, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None:
                    for b in bigrams(before, run, after):
                        counts[b] += n
                    continue
                odds = own.odds((before, run, after))
                high = max(0.0, *odds.values()) if odds else 0.0
                weights = {k: float(np.exp(x - high)) for k, x in odds.items() if x > high - 12}
                every = float(np.exp(-high)) + sum(weights.values())
                stays = float(np.exp(-high)) / every
                for b in bigrams(before, run, after):
                    counts[b] += n * stays
                if high > 0:
                    clear[max(odds, key=odds.get)] += n
                for k, w in weights.items():
                    if w > 1e-3 * every:
                        shares[k] += n * w / every
                        for b in bigrams(before, undo(run, SWAPS[k]), after):
                            counts[b] += n * w / every
                shares[-1] += n
        items = [(0, k, float(v)) for k, v in counts.items()] + [(1, k, float(v)) for k, v in shares.items()] + [(2, k, float(v)) for k, v in clear.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in items], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["kind", "at", "n"])

    return rows


def runs_by_source(records: DataFrame) -> DataFrame:
    """source, before, run, after, n: every distinct run of characters beyond ASCII with its neighbours, counted by source.

    records: text and, where there is one, source; without it all records are of one source.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in records.columns else F.lit("")
    found = records.select(source.alias("source"), "text").mapInArrow(_runs, "source string, before string, run string, after string, n bigint")
    return cut_lineage(found.groupBy("source", "before", "run", "after").agg(F.sum("n").alias("n")))


def learn(runs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of a corpus from runs_by_source: rounds over its distinct runs.

    What reaches the driver are at most BUCKETS bigram counts and one share per swap.
    """
    spark = runs.sparkSession
    # much work on little data: not to be merged by size
    runs = cut_lineage(runs.groupBy("before", "run", "after").agg(F.sum("n").alias("n")).repartition(4 * spark.sparkContext.defaultParallelism))
    start = [1e-3 / len(ALL_SWAPS)] * len(ALL_SWAPS)
    model = None
    shares, active = start, list(range(len(SWAPS)))
    for _ in range(rounds + 1):
        sent = spark.sparkContext.broadcast(model)
        got = runs.mapInArrow(_expect(sent), "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
        counts = {r["at"]: r["n"] for r in got if r["kind"] == 0}
        seen = {r["at"]: r["n"] for r in got if r["kind"] == 1}
        if seen:
            every = seen.pop(-1, 0) or 1.0
            shares = [(seen.get(k, 0.0) + 0.5) / (every + len(ALL_SWAPS)) for k in range(len(ALL_SWAPS))]
            best = {r["at"] for r in got if r["kind"] == 2}
            active = [k for k in active if k in best]  # a swap that explains no run best is out
        model = Model(counts, shares, active)
    return model


def _riddles(sent):
    """Runs that are improbable, with their symbols."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = sent.value
            keep = [i for i, (b, r, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("before", "run", "after")))) if _LOST not in r and model.value(b, r, a) < (len(r) + 1) * (model.usual - RIDDLE)]
            yield batch.take(pa.array(keep, pa.int64()))

    return rows


class Chain:
    """A hidden Markov chain: letters follow each other as the bigrams tell, and each shows as a symbol."""

    def __init__(self, model: Model, letters: list[str]):
        self.model, self.letters, self.index = model, letters, {x: i for i, x in enumerate(letters)}
        self.follow = np.exp([[model.pair(a + b) for b in letters] for a in letters])
        self.edges: dict[tuple[str, bool], np.ndarray] = {}

    def edge(self, c: str, first: bool) -> np.ndarray:
        if (c, first) not in self.edges:
            self.edges[c, first] = np.exp([self.model.pair(c + x if first else x + c) for x in self.letters])
        return self.edges[c, first]

    def posteriors(self, before: str, run: str, after: str, shows: dict[str, np.ndarray]) -> np.ndarray:
        """Of every symbol of a run, how probably it stands for each letter; shows: by symbol, how probably each letter shows as it."""
        e = [shows.get(c) for c in run]
        e = [np.full(len(self.letters), 1e-9) if x is None else x + 1e-12 for x in e]
        forward = [self.edge(before, True) * e[0]]
        for x in e[1:]:
            forward.append((forward[-1] / forward[-1].sum()) @ self.follow * x)
        back = self.edge(after, False)
        out = []
        for k in range(len(run) - 1, -1, -1):
            p = forward[k] * back
            out.append(p / p.sum())
            back = self.follow @ (e[k] * back)
            back /= back.sum()
        return np.array(out[::-1])


def _decipher(sent, letters: list[str]):
    """source, symbol, letter, n: expected counts of what symbols stand for."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, tables = Chain(sent.value, letters), {}
        counts: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["source"] not in tables:
                    tables.clear()
                    tables[r["source"]] = table = {}
                    for x in r["shows"] or ():
                        table.setdefault(x["symbol"], np.zeros(len(letters)))[chain.index[x["letter"]]] = x["p"]
                shows = tables[r["source"]] or {c: np.ones(len(letters)) for c in r["run"]}
                for c, p in zip(r["run"], chain.posteriors(r["before"], r["run"], r["after"], shows)):
                    counts.setdefault((r["source"], c), np.zeros(len(letters)))
                    counts[r["source"], c] += r["n"] * p
        out = [(s, c, letters[k], float(v[k])) for (s, c), v in counts.items() for k in np.flatnonzero(v > 1e-3)]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["source", "symbol", "letter", "n"])

    return rows


def _judge(sent):
    """source, gain, after, bigrams of its riddles when they are read by its cipher."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, out = sent.value, []
            for r in batch.to_pylist():
                now = model.value(r["before"], r["run"], r["after"])
                to = model.value(r["before"], r["run"].translate({ord(x["symbol"]): x["letter"] for x in r["cipher"]}), r["after"])
                out.append((r["source"], r["n"] * (to - now), r["n"] * to, float(r["n"] * (len(r["run"]) + 1))))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64()))], names=["source", "gain", "after", "bigrams"])

    return rows


def ciphers(runs: DataFrame, model: Model) -> DataFrame:
    """source, cipher (array of symbol and letter): the sources that are ciphers of their own, by runs_by_source.

    Rounds of expectation (over the sources' riddles) and maximisation (by source, symbol and letter); a source's riddles
    are spread over all tasks, and what is learned of it is joined to them.
    """
    spark = runs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    none = "source string, cipher array<struct<symbol: string, letter: string>>"
    alone = runs.groupBy("before", "run", "after").agg(F.min("source").alias("source"), F.max("source").alias("other"), F.sum("n").alias("n")).where("source = other").select("source", "before", "run", "after", "n")
    riddles = alone.mapInArrow(_riddles(sent), "source string, before string, run string, after string, n bigint")
    of_source = riddles.groupBy("source").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set(F.split("run", ""))))).alias("symbols")).where((F.col("n") >= OCCURRENCES) & (F.col("symbols") >= SYMBOLS))
    every = runs.groupBy("source").agg(F.sum("n").alias("all_n"))
    odd = of_source.join(every, "source").where(F.col("n") >= RIDDLE_SHARE * F.col("all_n")).select("source")
    rows = cut_lineage(riddles.join(odd, "source", "left_semi"))
    if rows.isEmpty():
        return spark.createDataFrame([], none)
    # at most LETTERS characters reach the driver
    letters = [r["c"] for r in runs.select(F.explode(F.split("run", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c").limit(LETTERS).collect()]
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df
    shows = None
    for _ in range(CIPHER_ROUNDS):
        told = rows.join(few(shows), "source", "left") if shows is not None else rows.withColumn("shows", F.lit(None).cast("array<struct<symbol: string, letter: string, p: double>>"))
        counted = told.sortWithinPartitions("source").mapInArrow(_decipher(sent, letters), "source string, symbol string, letter string, n double").groupBy("source", "symbol", "letter").agg(F.sum("n").alias("n"))
        counted = cut_lineage(counted)
        p = F.col("n") / F.sum("n").over(Window.partitionBy("source", "letter"))
        shows = cut_lineage(counted.withColumn("p", p).where("p > 1e-4").groupBy("source").agg(F.collect_list(F.struct("symbol", "letter", "p")).alias("shows")))
    best = counted.groupBy("source", "symbol").agg(F.max_by("letter", F.struct("n", "letter")).alias("letter"))
    cipher = cut_lineage(best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("symbol", "letter"))).alias("cipher")))
    judged = rows.join(few(cipher), "source").mapInArrow(_judge(sent), "source string, gain double, after double, bigrams double").groupBy("source").agg(*[F.sum(c).alias(c) for c in ("gain", "after", "bigrams")])
    good = judged.where((F.col("gain") >= RIDDLE / 2 * F.col("bigrams")) & (F.col("after") >= (model.usual - RIDDLE) * F.col("bigrams"))).select("source")
    return cut_lineage(cipher.join(good, "source", "left_semi"))


def _restored(sent):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, out = sent.value, []
            own = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(batch)
            for text, cipher in zip(batch.column(2).to_pylist(), own):
                fixed, wrong, lost, used = restore(text, model, {ord(x["symbol"]): x["letter"] for x in cipher} if cipher else None)
                out.append((fixed, wrong, lost, ["own cipher" if k == _OWN else " ".join(ALL_SWAPS[k]) for k in used]) if wrong or lost else None)
            hit = [i for i, x in enumerate(out) if x]
            some = batch.take(pa.array(hit, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), *(pa.array([out[i][j] for i in hit], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))))],
                names=["record_kind", "record_id", "restored", "wrong_lines", "lost_lines", "swaps"],
            )

    return rows


def wrongly_decoded(records: DataFrame, model: Model, own: DataFrame | None = None) -> DataFrame:
    """record_kind, record_id, restored, wrong_lines, lost_lines, swaps of the records with wrongly decoded characters.

    records: record_kind, record_id, text and, where there is one, source; own: the ciphers of sources. Lines whose
    characters were lost (U+FFFD) are found, and stay as they are. Null, empty and ASCII texts are never found; repeated
    rows are found as often as they come; null ids stay null.
    """
    sent = records.sparkSession.sparkContext.broadcast(model)
    some = records.where(F.col("text").isNotNull() & F.col("text").rlike("[^\\x00-\\x7F]"))
    if own is not None and "source" in records.columns and (sources := own.count()):
        keyed = some.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
        some = keyed.join(F.broadcast(own) if sources <= BROADCAST_SOURCES else own, "source", "left").select("record_kind", "record_id", "text", "cipher")
    else:
        some = some.select("record_kind", "record_id", "text")
    return some.mapInArrow(_restored(sent), "record_kind string, record_id string, restored string, wrong_lines int, lost_lines int, swaps array<string>")
