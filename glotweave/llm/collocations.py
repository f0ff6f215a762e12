"""Phrase collocation mining: candidates from sketch bounds, exact counts from automata.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``; a phrase is 2 to 4 consecutive
words of a piece, and f(phrase) all its occurrences, overlaps included.  All is per language.  Cutting a phrase in
two compares it with its parts l and r; its score is the least floor(2000000 a / (l + r)) of its cuts.  Phrases that stand
mostly inside a longer one are dropped.

Method, in four passes over the documents.

1. Words are counted.
2. A count-min sketch of pairs: a cell is the first bits of a phrase's hash, and its number is at least that of any phrase in it.
   Only pairs of two frequent words are entered, as f of a part is at least f of the whole.
3. A sketch of phrases of three and four words whose pairs all have frequent cells.
4. Every shard of documents compiles the phrases that it holds and whose cells are frequent into an Aho-Corasick automaton,
   guarded by a delimiter at both ends, and streams its texts through it; all overlapping matches are counted.  Counts of
   shards are summed and compared with ``least``.

The sketch only says what need not be counted: its bounds are never too small, so no phrase is lost, and every number that is
returned comes from the automata.  A shard compiles one phrase for each distinct hash; where the matches of a phrase are
not as many as the places with its hash, two phrases share the hash, and those places are counted by their words.

Scale: a sketch row is a cell with its number in a task, so a frequent phrase leaves a task once.  The cells grow with the
corpus, as many as it has words (``phrase_counts``).  Tasks know frequent cells from a bitmap of 2^``filter_bits`` bits at most, which
bounds what is broadcast; with more cells than bits, or one bit in eight set, pass 4 goes in rounds of a share of the
cells each, so that the bitmap stays sharp.  An automaton holds phrases of one shard.  The first 2000 of a language are taken within salts
first, so no task sorts a whole language.

Defined cases: a null text is empty, a null lang is ``und``.  Repeated rows count each time.  No rows, or no frequent phrase, give
no rows.  doc_id and other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotweave.llm.batches import PIECE_BYTES, pieces
from glotweave.llm.storage import Scratch, materialise
from glotweave.llm.terms import byte_table, count_tokens, translated
from glotweave.llm.wordhash import Words, gram_hashes, mix

LEAST, FIRST, LONGEST = 30, 2000, 4
FILTER_BITS = 28
SHARD_BYTES = 2 * PIECE_BYTES
#: Cells that a task holds before it passes their numbers on.
HELD = 2_000_000
_CUTS = b".,;:!?\n\x0b\x0c\r"
#: Lower case; a tab is a space, whatever cuts a piece is a line end.
PIECES = byte_table(lambda b: b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 9 else 0x0A if b in _CUTS else b)
_SPACES = re.compile(" {2,}")


class Shard:
    """The words of some texts: hashes that depend on word and language, and the text and piece in which each stands."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data = translated(texts, PIECES)
        self.words = Words(data)
        salt = {x: np.uint64(xxhash.xxh3_64_intdigest(x.encode())) for x in set(langs)}
        doc = np.repeat(np.arange(len(langs)), self.words.counts())
        salts = np.array([salt[x] for x in langs], np.uint64)
        self.doc = doc
        self.hash = mix(self.words.hash + salts[doc]) if len(doc) else self.words.hash
        lines = np.concatenate([[0], np.cumsum(self.words.data == 0x0A)])
        self.piece = lines[self.words.begin] + doc

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are words of one piece (positions without k words are left out)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        return gram_hashes(self.hash, k, salt=20 + k), self.piece[:n] == self.piece[k - 1 :]


class Frequent:
    """The bitmap of frequent cells: a bit for each cell, or for neighbouring cells if there are more cells than bits."""

    def __init__(self, cell_bits: int, filter_bits: int, words: np.ndarray):
        self.cell_bits, self.shift, self.words = cell_bits, max(0, cell_bits - filter_bits), words

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        at = cells >> np.uint64(self.shift)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _frequent_cells(spark, cells: DataFrame, cell_bits: int, filter_bits: int):
    """Broadcast bitmap of the ``cell`` column: at most 2^filter_bits bits reach the driver."""
    at = F.shiftright("cell", max(0, cell_bits - filter_bits))
    words = np.zeros(max(1, 1 << (min(cell_bits, filter_bits) - 6)), np.uint64)
    set_bits = cells.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(63).cast("int").alias("bit"))
    rows = set_bits.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("m")).toArrow()
    words[np.asarray(rows.column("w"))] = np.asarray(rows.column("m")).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def _sketch(sizes: list[int], parts: int, known, filter_bits: int, cell_bits: int):
    """(cell, n) of the phrases of ``sizes`` words all of whose phrases of ``parts`` words have frequent cells."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(cell_bits, filter_bits, known.value)
        held: list[np.ndarray] = []
        for batch in batches:
            for part in pieces(batch, max_bytes=4 * PIECE_BYTES):
                shard = Shard(part.column("text"), part.column("lang").to_pylist())
                low, whole = (shard.hash, np.ones(len(shard.hash), bool)) if parts == 1 else shard.grams(parts)
                low = whole & frequent(_cells(low, cell_bits))
                for size in sizes:
                    grams, whole = shard.grams(size)
                    for i in range(size - parts + 1):
                        whole = whole & low[i : i + len(whole)]
                    held.append(_cells(grams[whole], cell_bits))
                if sum(map(len, held)) > HELD:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return run


def _hashes_of_words(cell_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = Shard(batch.column("phrase"), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_cells(shard.hash, cell_bits).view(np.int64))], ["cell"])

    return run


def guarded(text: bytes) -> str:
    """Words between single spaces; pieces are apart by a line end, which no phrase has."""
    return _SPACES.sub(" ", " " + text.decode().replace("\n", " \n ") + " ")


def count_matches(phrases: list[str], texts: list[str]) -> list[int]:
    """How often each phrase stands in guarded texts, overlaps included."""
    if not phrases:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    found = np.zeros(len(phrases), np.int64)
    for text in texts:
        np.add.at(found, np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), 1)
    return found.tolist()


def _places(shard: Shard, cell_bits: int, frequent: Frequent, rounds: int, turn: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places ordered by hash, where each hash begins) of the phrases to count.

    Parts of a frequent phrase are frequent too; where all cells are in this turn, so must those of the parts be.
    """
    shorter = None
    for size in range(2, LONGEST + 1):
        grams, wanted = shard.grams(size)
        cells = _cells(grams, cell_bits)
        if rounds > 1:
            wanted = wanted & frequent(cells) & (cells % np.uint64(rounds) == np.uint64(turn))
        elif shorter is None:
            wanted = wanted & frequent(cells)
        else:
            wanted = wanted & shorter[: len(wanted)] & shorter[1 : len(wanted) + 1]
            near = np.flatnonzero(wanted)
            wanted[near] = frequent(cells[near])
        shorter = wanted
        at = np.flatnonzero(wanted)
        at = at[np.argsort(grams[at], kind="stable")]
        yield size, at, np.flatnonzero(np.concatenate([[True], np.diff(grams[at]) != 0])) if len(at) else np.empty(0, np.int64)


def _stretches(words: Words, raw: bytes, at: np.ndarray, size: int) -> list[str]:
    """The ``size`` words from each place on, joined by one space: a slice of the text where they stand so already."""
    begin, end = words.begin[at], words.end[at + size - 1]
    lengths = sum(words.end[at + i] - words.begin[at + i] for i in range(size))
    out = [raw[x:y].decode() for x, y in zip(begin.tolist(), end.tolist())]
    for i in np.flatnonzero(end - begin != lengths + size - 1).tolist():
        out[i] = words.words(int(at[i]), int(at[i]) + size).decode()
    return out


def count_phrases(part: pa.RecordBatch, cell_bits: int, frequent: Frequent, rounds: int = 1, turn: int = 0) -> Iterator[tuple[str, str, int]]:
    """(lang, phrase, n) of the phrases of a shard whose cells are frequent and of this turn."""
    for lang, counts in shard_counts(part, cell_bits, frequent, rounds, turn):
        for phrase, n in counts:
            yield lang, phrase, n


def shard_counts(part: pa.RecordBatch, cell_bits: int, frequent: Frequent, rounds: int = 1, turn: int = 0) -> Iterator[tuple[str, Iterator[tuple[str, int]]]]:
    """The phrases of a shard and their numbers, language by language; a phrase whose hash another has may come twice."""
    langs = part.column("lang").to_pylist()
    shard = Shard(part.column("text"), langs)
    raw = shard.words.data.tobytes()
    names = sorted(set(langs))
    number = np.array([names.index(x) for x in langs], np.int64)
    own: dict[str, list[tuple[list[str], int, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
    for size, at, first in _places(shard, cell_bits, frequent, rounds, turn):
        many = np.diff(np.append(first, len(at)))
        of = number[shard.doc[at[first]]]
        for i, lang in enumerate(names):
            some = of == i
            own[lang].append((_stretches(shard.words, raw, at[first[some]], size), size, at, first[some], many[some]))
    texts: dict[str, list[str]] = defaultdict(list)
    for lang, text in zip(langs, translated(part.column("text"), PIECES).to_pylist()):
        texts[lang].append(guarded(text))
    for lang, sizes in own.items():
        phrases = [p for some, *_ in sizes for p in some]
        found = count_matches(phrases, texts[lang])
        yield lang, zip(phrases, found) if found == [n for *_, many in sizes for n in many.tolist()] else _apart(shard.words, sizes, found)


def _apart(words: Words, sizes: list, found: list[int]) -> Iterator[tuple[str, int]]:
    """Where a phrase has not as many matches as its hash has places, another phrase has its hash: those places are counted by their words."""
    numbers = iter(found)
    for phrases, size, at, first, many in sizes:
        for phrase, x, n in zip(phrases, first.tolist(), many.tolist()):
            if next(numbers) == n:
                yield phrase, n
                continue
            for p, m in Counter(words.words(i, i + size) for i in at[x : x + n].tolist()).items():
                yield p.decode(), m


def _count(known, cell_bits: int, filter_bits: int, rounds: int, turn: int, shard_bytes: int):
    def out(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            columns = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(cell_bits, filter_bits, known.value)
        held: dict[str, dict[str, int]] = defaultdict(dict)
        for batch in batches:
            for part in pieces(batch, max_bytes=shard_bytes):
                for lang, found in shard_counts(part, cell_bits, frequent, rounds, turn):
                    counts = held[lang]
                    before = counts.get
                    for phrase, n in found:
                        counts[phrase] = before(phrase, 0) + n
                if sum(map(len, held.values())) > HELD // 8:
                    yield from out(held)
                    held.clear()
        yield from out(held)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to 4 words with n >= ``least``; (lang, total) occurrences of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        words = texts.mapInArrow(count_tokens(PIECES, ["lang"], "text", with_docs=False, token="phrase"), "lang string, phrase string, n long")
        words = scratch.table(words.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")
        totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
        bits = max(16, math.ceil(math.log2(max(2, words.agg(F.sum("n")).first()[0] or 0))))
        often = words.filter(F.col("n") >= least)
        known = _frequent_cells(spark, often.select("lang", "phrase").mapInArrow(_hashes_of_words(bits), "cell long"), bits, filter_bits)

        def sketch(sizes: list[int], parts: int, known) -> DataFrame:
            rows = texts.mapInArrow(_sketch(sizes, parts, known, filter_bits, bits), "cell long, n long")
            return scratch.table(rows.groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("cell"), "phrase-cells")

        pairs = sketch([2], 1, known)
        known = _frequent_cells(spark, pairs, bits, filter_bits)
        cells = pairs.union(sketch([3, 4], 2, known))
        rounds = max(1, -(-cells.count() // (1 << (min(bits, filter_bits) - 3))))
        counted = []
        for turn in range(rounds):
            own = cells.filter(F.pmod(F.col("cell"), F.lit(rounds)) == turn)
            known = _frequent_cells(spark, own, bits, filter_bits)
            rows = texts.mapInArrow(_count(known, bits, filter_bits, rounds, turn, shard_bytes), "lang string, phrase string, n long")
            rows = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            counted.append(scratch.table(rows, "phrase-counted"))
        out = often
        for table in counted:
            out = out.unionByName(table)
        return materialise(out.withColumn("size", F.size(F.split("phrase", " "))), "phrase-counts"), totals


def _wide(c: str) -> str:
    return f"cast({c} as decimal(20,0))"


def mine(docs: DataFrame, least: int = LEAST, first: int = FIRST, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language."""
    counts, totals = phrase_counts(docs, least, filter_bits, shard_bytes)
    with Scratch(docs.sparkSession) as scratch:
        scratch.adopt(counts)
        scratch.adopt(totals)
        candidates = counts.filter("size > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), "size", F.col("n").alias("a"))

        def stretch(start: Column, length: Column) -> Column:
            return F.array_join(F.slice("w", start, length), " ")

        one = F.lit(1)
        cuts = F.transform(
            F.sequence(one, F.col("size") - 1),
            lambda k: F.struct(k.alias("k"), stretch(one, k).alias("left"), stretch(k + 1, F.col("size") - k).alias("right")),
        )
        part = [counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(c)) for side, c in (("left", "l"), ("right", "r"))]
        cut = candidates.select("lang", "phrase", "a", F.inline(cuts)).join(part[0], ["lang", "left"]).join(part[1], ["lang", "right"])
        cut = cut.withColumn("score", F.expr(f"(cast(2000000 as decimal(7,0)) * {_wide('a')}) div ({_wide('l')} + {_wide('r')})"))
        scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
        # the phrases of two words and more inside a longer one
        inner = F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda k: F.transform(F.sequence(one, F.col("size") - k + 1), lambda i: stretch(i, k)),
        ))
        inside = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
        inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        mostly = F.expr(f"100 * {_wide('longer')} >= 80 * {_wide('a')}")
        kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~mostly)
        kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
        return materialise(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")
