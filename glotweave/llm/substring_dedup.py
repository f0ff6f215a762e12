"""Substring dedup by repeated-phrase automata.

Method, in two moves.

*Confirm recurring passages.*  A window is ``window`` consecutive words.  Every window names one seed, the smallest hash
among its ``seed_words``-word grams (a minimiser: equal windows name equal seeds, and only about a quarter of all
positions are seeds).  Seeds of one document only rule their windows out, so windows themselves are hashed and counted
only where a seed recurs; what two texts hold is confirmed.  Its holder is the
smallest of them, and the holder's confirmed windows, as stretches of text in blocks of ``BLOCK`` windows, are the passages.

*Locate every occurrence.*  A document visits the blocks of which it shares a window; the visit says which block, not
where.  Documents are dealt into shards of about ``shard_bytes`` of text.  For each shard the passages of the visited blocks
are cut into consecutive chunks of (window + 1) / 2 words, so that every window holds a whole chunk, and the chunks are
compiled into an Aho-Corasick automaton by pyahocorasick.  All documents of the shard stream through it; around every hit
the words of document and passage are compared, and where ``window`` of them agree and the holder is smaller than the
document, they are marked.  All positions that are removed come from the automaton.

Scale: seeds and windows meet in hash aggregations with map-side combining, so a phrase held by a third of all documents
is pre-aggregated; aggregates are written before they are joined, so that the joins are plain equi-joins on narrow rows,
which adaptive execution splits when a key is hot.  A passage of many words is delivered to a document in the blocks that it
shares, so what a document receives follows what it loses.  An automaton holds the passages that one shard visits, so its
size does not depend on the corpus.  Texts are shuffled by document id three times: for documents with recurring seeds,
for holders, and for the last pass.  Scratch tables are deleted when the next one is written.

Of documents with one and the same text the two smallest are searched for windows: the first may be their holder, and what the second visits is
what all others do.  Passages go to texts by a wide hash of the text, so equal texts receive the same passages, of which a
shard keeps one.

Words are compared by 64-bit hashes, windows meet by 64-bit hashes; a collision of two windows can only leave a passage
standing, as its words are compared again.

Defined cases: a null or empty text has no words and loses none (its kept text is empty).  Texts of fewer than ``window``
words lose none.  A row with a null doc_id has no smaller document and is no smaller document: it loses none.  Rows that
share a doc_id are one document: a window in both recurs only if another document holds it.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotweave.llm.batches import PIECE_BYTES, pieces, signed
from glotweave.llm.columns import wide_hash
from glotweave.llm.storage import Scratch, materialise
from glotweave.llm.wordhash import Words, gram_hashes, mix, window_starts

#: Windows in a block: a document receives a passage in blocks of which it shares a window.
BLOCK = 64
#: Hits whose surroundings are compared at once.
_HITS = 1 << 15


def _minimisers(hashes: np.ndarray, window: int, seed_words: int) -> np.ndarray:
    """The smallest gram hash of the window at each flat position (positions without a whole window are left out)."""
    low = gram_hashes(hashes, seed_words, salt=3)
    span, width = window - seed_words + 1, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        width += step
    return low


def _seeds_of(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, max_bytes=4 * PIECE_BYTES):
                found = Words(part.column("text"))
                at, doc = window_starts(found.first, window)
                if not len(at):
                    continue
                seed = _minimisers(found.hash, window, seed_words)[at]
                new = np.ones(len(seed), dtype=bool)
                new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                seed, doc = seed[new], doc[new]
                order = np.lexsort((seed, doc))
                seed, doc = seed[order], doc[order]
                new = np.ones(len(seed), dtype=bool)
                new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                ids = part.column("doc_id").take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([ids, signed(seed[new])], ["doc_id", "seed"])

    return run


def _windows_of(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, max_bytes=4 * PIECE_BYTES):
                found = Words(part.column("text"))
                at, doc = window_starts(found.first, window)
                if not len(at):
                    continue
                seed = _minimisers(found.hash, window, seed_words)[at]
                lists = part.column("seeds")
                known = np.asarray(lists.flatten()).view(np.uint64)
                owner = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
                # seeds are matched together with the row that holds them
                hit = np.isin(seed ^ mix(doc.astype(np.uint64), 9), known ^ mix(owner.astype(np.uint64), 9))
                at, doc = at[hit], doc[hit]
                value = gram_hashes(found.hash, window, salt=1)[at] if len(at) else np.empty(0, np.uint64)
                at = at - found.first[doc]
                order = np.lexsort((at, value, doc))
                value, at, doc = value[order], at[order], doc[order]
                new = np.ones(len(value), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                ids = part.column("doc_id").take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([ids, signed(value[new]), pa.array(at[new], pa.int32())], ["doc_id", "w", "at"])

    return run


def _passages_of(window: int):
    """(low, block, passage): the stretches of a holder's text that its confirmed windows cover, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = Words(part.column("text"))
                grams = gram_hashes(found.hash, window, salt=1)
                lows, blocks, passages = [], [], []
                for i, (low, known) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("confirmed"))):
                    first, stop = int(found.first[i]), int(found.first[i + 1]) - window + 1
                    if stop <= first:
                        continue
                    w, block = (np.asarray(known.values.field(c)) for c in ("w", "block"))
                    order = np.argsort(w.view(np.uint64), kind="stable")
                    w, block = w.view(np.uint64)[order], block[order]
                    mine, at = np.unique(grams[first:stop], return_index=True)  # where each window stands first
                    spot = np.minimum(np.searchsorted(w, mine), len(w) - 1)
                    hit = w[spot] == mine
                    at, of = at[hit], block[spot[hit]]
                    order = np.argsort(at)
                    at, of = at[order], of[order]
                    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                        if b > a:
                            lows.append(low)
                            blocks.append(int(of[a]))
                            passages.append(found.words(first + int(at[a]), first + int(at[b - 1]) + window))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lows, pa.int64()), pa.array(blocks, pa.int32()), pa.array(passages, pa.binary()).cast(pa.string())],
                    ["low", "block", "passage"],
                )

    return run


class Phrases:
    """An automaton of the chunks of passages, as sequences of word numbers, and what surrounds each chunk."""

    #: Word numbers as characters, beyond which they are matched as sequences of numbers.
    _LETTERS = 0x110000 - 0x800

    def __init__(self, number: np.ndarray, first: np.ndarray, holder: np.ndarray, window: int, n_words: int):
        self.number, self.window, self.chunk = number, window, (window + 1) // 2
        self.begin, self.stop, self.holder = first[:-1], first[1:], holder
        self.as_text = n_words < self._LETTERS
        key = ahocorasick.KEY_STRING if self.as_text else ahocorasick.KEY_SEQUENCE
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, key)
        of, at = [], []
        known: dict = {}
        letters = self.letters(number)
        for i, (a, b) in enumerate(zip(self.begin.tolist(), self.stop.tolist())):
            for x in range(a, b - self.chunk + 1, self.chunk):
                at.append(x)
                of.append(i)
                k = letters[x : x + self.chunk]
                known.setdefault(k, []).append(len(at) - 1)
        self.at, self.of = np.array(at, dtype=np.int64), np.array(of, dtype=np.int64)
        for k, (word, spots) in enumerate(known.items()):
            self.automaton.add_word(word, k)
        self.many = np.array([len(x) for x in known.values()], dtype=np.int64)
        self.spots = np.array([x for xs in known.values() for x in xs], dtype=np.int64)
        self.ahead = np.cumsum(self.many) - self.many
        if known:
            self.automaton.make_automaton()

    def letters(self, number: np.ndarray):
        if not self.as_text:
            return tuple(number.tolist())
        return (number + (number >= 0xD800) * 0x800).astype("<u4").tobytes().decode("utf-32-le")

    def mark(self, number: np.ndarray, doc_id: int) -> np.ndarray:
        """How many more marks begin than end at each word of a document, for the windows that smaller holders have too."""
        marks = np.zeros(len(number) + 1, dtype=np.int64)
        if not len(self.many) or len(number) < self.window:
            return marks
        found = np.array([x for hit in self.automaton.iter(self.letters(number)) for x in hit], dtype=np.int64).reshape(-1, 2)
        reach, width = self.window - self.chunk, 2 * self.window - self.chunk
        many = self.many[found[:, 1]]
        ends = np.cumsum(many)
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS, "right")))
            n = many[a:b]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            chunk = self.spots[np.repeat(self.ahead[found[a:b, 1]], n) + within]
            chunk_at = np.repeat(found[a:b, 0] - self.chunk + 1, n)
            a = b
            smaller = self.holder[self.of[chunk]] < doc_id
            chunk, chunk_at = chunk[smaller], chunk_at[smaller]
            steps = np.arange(-reach, width - reach)
            mine, theirs = chunk_at[:, None] + steps, self.at[chunk][:, None] + steps
            of = self.of[chunk][:, None]
            inside = (mine >= 0) & (mine < len(number)) & (theirs >= self.begin[of]) & (theirs < self.stop[of])
            same = inside & (number[np.clip(mine, 0, len(number) - 1)] == self.number[np.clip(theirs, 0, len(self.number) - 1)])
            sums = np.concatenate([np.zeros((len(same), 1), dtype=np.int64), np.cumsum(same, axis=1)], axis=1)
            hit, o = np.nonzero(sums[:, self.window :] - sums[:, : -self.window] == self.window)
            starts = chunk_at[hit] - reach + o
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + self.window, -1)
        return marks


def _locate(names: list[str], window: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, max_bytes=shard_bytes):
                yield shard(part)

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        found = Words(part.column("text"))
        counts, first = found.counts(), found.first
        ids = part.column("doc_id").to_pylist()
        visited = part.column("__sd_passages").flatten()
        # copies of one text have the same passages, which are wanted once
        _, once = np.unique(np.stack([np.asarray(visited.field("low")), np.asarray(visited.field("passage").dictionary_encode().indices, dtype=np.int64)]), axis=1, return_index=True)
        visited = visited.take(pa.array(np.sort(once)))
        passages = Words(visited.field("passage"))
        _, number = np.unique(np.concatenate([found.hash, passages.hash]), return_inverse=True)
        own, theirs = number[: len(found.hash)], number[len(found.hash) :]
        phrases = Phrases(theirs, passages.first, np.asarray(visited.field("low")), window, len(number))
        covered = np.zeros(len(own) + 1, dtype=np.int64)
        for i, doc_id in enumerate(ids):
            a, b = int(first[i]), int(first[i + 1])
            if b - a < window or doc_id is None:
                continue
            if part.column("__sd_passages")[i].is_valid:
                covered[a : b + 1] += phrases.mark(own[a:b], doc_id)
        gone = np.cumsum(covered[:-1]) > 0
        kept = [found.text_of(i, ~gone[first[i] : first[i + 1]]) for i in range(len(ids))]
        removed = np.add.reduceat(np.concatenate([gone, [0]]).astype(np.int64), first[:-1]) * (counts > 0) if len(ids) else counts
        out = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*out, pa.array(counts.astype(np.int64)), pa.array(removed)], [*names, "n_words", "n_removed"])

    return run


def _find_passages(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """key, __sd_passages: holder and text of the passages that texts of that key may hold."""
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    keyed = texts.select("doc_id", wide_hash(F.col("text")).alias("key"))
    with Scratch(docs.sparkSession) as scratch:
        holders = scratch.table(
            keyed.groupBy("key").agg(F.min("doc_id").alias("unit"), F.max("doc_id").alias("last")).filter("unit < last").select("key", "unit"), "phrase-units"
        )
        copies = scratch.table(keyed.join(holders, "key").filter(F.col("unit") < F.col("doc_id")), "phrase-copies")
        seconds = scratch.table(copies.groupBy("key").agg(F.min("doc_id").alias("second")), "phrase-seconds")
        more = copies.join(seconds, "key").filter(F.col("second") < F.col("doc_id"))
        more = scratch.table(more.groupBy("doc_id").agg(F.collect_set("key").alias("__sd_copies")), "phrase-more")
        seeds = scratch.table(texts.mapInArrow(_seeds_of(window, seed_words), "doc_id long, seed long"), "phrase-seeds")
        recurring = scratch.table(
            seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "phrase-recurring"
        )
        by_doc = scratch.table(seeds.join(recurring, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), "phrase-seeds-of")
        scratch.drop(holders, copies, seeds, recurring)
        # narrow tables meet first, so that texts are shuffled by doc_id alone
        whole = F.array_contains(F.col("__sd_copies"), wide_hash(F.col("text")))
        seeded = (
            texts.join(by_doc.join(more, "doc_id", "left"), "doc_id").filter(~F.coalesce(whole, F.lit(False))).select("doc_id", "text", "seeds")
        )
        windows = scratch.table(seeded.mapInArrow(_windows_of(window, seed_words), "doc_id long, w long, at int"), "phrase-windows")
        scratch.drop(by_doc)
        confirmed = scratch.table(
            windows.groupBy("w")
            .agg(F.min("doc_id").alias("low"), F.min_by("at", "doc_id").alias("at"), F.count("*").alias("n"))
            .filter("n > 1")
            .select("w", "low", F.floor(F.col("at") / BLOCK).cast("int").alias("block")),
            "phrase-confirmed",
        )
        visits = scratch.table(
            windows.select("w", "doc_id").join(confirmed, "w").filter("low < doc_id").select("doc_id", "low", "block").distinct(), "phrase-visits"
        )
        scratch.drop(windows)
        held = confirmed.groupBy("low").agg(F.collect_list(F.struct("w", "block")).alias("confirmed")).withColumnRenamed("low", "doc_id")
        passages = scratch.table(
            texts.join(held, "doc_id").mapInArrow(_passages_of(window), "low long, block int, passage string"), "phrase-passages"
        )
        scratch.drop(confirmed)
        # the visits of a text are those of its documents but for the smallest of several, whose visits the second one's contain
        of = keyed.join(seconds, "key", "left").filter(F.col("second").isNull() | (F.col("doc_id") == F.col("second"))).select("doc_id", "key")
        asked = visits.join(of, "doc_id").select("key", "low", "block").distinct()
        received = asked.join(passages, ["low", "block"]).groupBy("key").agg(F.collect_list(F.struct("low", "passage")).alias("__sd_passages"))
        return materialise(received, "phrase-known")


def dedup_substrings(docs: DataFrame, window: int = 13, seed_words: int = 7, shard_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs`` with its text cut to the kept words, joined by one space, plus n_words and n_removed."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    known = _find_passages(docs, window, seed_words).withColumnRenamed("key", "__sd_key")
    ready = docs.select(*names).join(known, wide_hash(F.col("text")) == F.col("__sd_key"), "left").select(*names, "__sd_passages")
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return ready.mapInArrow(_locate(names, window, shard_bytes), schema)
