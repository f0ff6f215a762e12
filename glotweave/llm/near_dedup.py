"""Near-duplicate classes by ProbMinHash, banding and verification.

Method.  Identical texts are one vertex, named by the smallest doc_id.  A vertex's distinct 5-word shingles, all of weight
1, give a ProbMinHash signature (probminhash.py), so that registers agree with the probability that is judged, the Jaccard
similarity of the sets; its registers are cut into bands, and vertices that agree in a band are candidates.  With 24 bands
of 4 registers a pair at similarity 0.8 shares no band with probability 3e-6.  Candidates whose signatures agree in fewer
than ``sketch_floor`` of the registers (5 standard deviations below 0.8) are dropped, the others are verified exactly: Jaccard
similarity of the sets of distinct shingles, 0.8 or more.  Classes are the connected components of the verified links.

Big buckets never emit all their pairs.  Every bucket is first linked to one hub, the member that shares the most bucket
places over all bands (for copies of one text that is the text they stem from); that is one pair per member.  Only where
the links found so far leave a bucket in several components are members compared among themselves: the strays, which are
those outside the bucket's largest component, with all others, in tiles of bounded size that are dealt over tasks.  A bucket
of n members and s strays gives about n rows for every ``TILE`` strays and s for every ``TILE`` members.  A tile compares
signatures as matrices, takes each pair in the first band that it shares, and drops pairs by the sketch and by an exact
bound: shingles that no other such member holds cannot be shared, so two members with s and t other shingles share at most
min(s, t).  What is left is verified there and then, and only links that join two components are emitted.  So no link that
matters for the classes is lost, nothing is emitted in proportion to pairs, and a group of copies gives rows in proportion
to its size.  (Links within a class are not all verified, so they are not counted.)

Scale: rows between stages are band hashes, signatures of 384 bytes, or pairs of ids.  Texts are shuffled for the exact
check of pairs that passed the sketch.  What is counted per text or band is written before it is joined, so that the joins on
hot texts and bands are plain equi-joins that adaptive execution can split.  Scratch tables are deleted at the end, but for
the classes.

Defined cases: a text of fewer than five words is one shingle.  A text without words is linked only to identical texts.
Rows with a null doc_id or text are alone (class_id = doc_id).  Rows that repeat a doc_id and its text are one document
and stay or go together; a doc_id with two texts is judged by each text.  Extra columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotweave.llm.batches import PIECE_BYTES, pieces, signed
from glotweave.llm.columns import wide_hash
from glotweave.llm.components import connected_components
from glotweave.llm.probminhash import signatures
from glotweave.llm.storage import Scratch, materialise
from glotweave.llm.wordhash import Words, gram_hashes, mix, window_starts

SHINGLE = 5
BANDS = 24
ROWS = 4
TILE = 512


def shingles(found: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) of the distinct shingles of each text, sorted by text and shingle."""
    at, text = window_starts(found.first, k)
    value = gram_hashes(found.hash, k, salt=11)[at]
    counts = found.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array(
            [mix(gram_hashes(found.hash[found.first[i] : found.first[i + 1]], int(counts[i]), salt=11), int(counts[i]))[0] for i in short],
            dtype=np.uint64,
        )
        value, text = np.concatenate([value, whole]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    spots = np.flatnonzero(new)
    return text[spots], value[spots], np.diff(np.append(spots, len(value)))


def _sign(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = Words(part.column("text"))
                text, value, _ = shingles(found)
                some = np.flatnonzero(found.counts() > 0)
                if not len(some):
                    continue
                rows = signatures(value, np.ones(len(value)), text, part.num_rows, m)[some]
                low = (mix(rows) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                flat = pa.array(low.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, m, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), lists], ["id", "sig"])

    return run


def _verify(similarity_num: int, similarity_den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "v_text"):
                sides = []
                for c in ("u_text", "v_text"):
                    coded = part.column(c).dictionary_encode()
                    text, value, _ = shingles(Words(coded.dictionary))
                    cuts = np.searchsorted(text, np.arange(len(coded.dictionary) + 1))
                    sides.append((np.asarray(coded.indices), value, cuts))
                (ui, uv, uc), (vi, vv, vc) = sides
                keep = np.zeros(part.num_rows, dtype=bool)
                for r, (i, j) in enumerate(zip(ui.tolist(), vi.tolist())):
                    a, b = uv[uc[i] : uc[i + 1]], vv[vc[j] : vc[j + 1]]
                    small, large = sorted((len(a), len(b)))
                    if small * similarity_den < similarity_num * large:
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[r] = both * similarity_den >= similarity_num * (len(a) + len(b) - both)
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column("u").take(at), part.column("v").take(at)], ["u", "v"])

    return run


def _list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, max_bytes=4 * PIECE_BYTES):
            text, value, _ = shingles(Words(part.column("text")))
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), signed(value))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "held"])


def _tiles(floor: int, num: int, den: int):
    """Over rows sorted by tile: verified links that connect strays of a bucket to members of other components."""

    def compare(group: pa.RecordBatch) -> pa.RecordBatch:
        ids, stray = np.asarray(group.column("id")), np.asarray(group.column("stray"))
        size, most = np.asarray(group.column("size")), np.asarray(group.column("most"))
        sig = np.asarray(group.column("sig").flatten()).reshape(len(ids), -1)
        lists = group.column("held")
        held, cuts = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))])
        parts, part = np.unique(np.asarray(group.column("part")), return_inverse=True)
        place = int(group.column("place")[0].as_py())
        left, right = (np.flatnonzero(np.asarray(group.column(c))) for c in ("left", "right"))
        root = list(range(len(parts)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        us, vs = [], []
        for start in range(0, len(left), 64):
            rows = left[start : start + 64]
            same = np.zeros((len(rows), len(right)), dtype=np.int16)
            seen = np.zeros(same.shape, dtype=bool)  # agree in an earlier band, whose tiles have this pair
            whole = seen
            for k in range(sig.shape[1]):
                equal = sig[rows, k][:, None] == sig[right, k][None, :]
                same += equal
                if k < place * ROWS:
                    whole = equal if k % ROWS == 0 else whole & equal
                    if k % ROWS == ROWS - 1:
                        seen |= whole
            good = (same >= floor) & ~seen & (part[rows][:, None] != part[right][None, :])
            good &= ~stray[right][None, :] | (ids[rows][:, None] < ids[right][None, :])  # two strays meet twice
            good &= np.minimum(most[rows][:, None], most[right][None, :]) * (num + den) >= num * (size[rows][:, None] + size[right][None, :])
            i, j = np.nonzero(good)
            order = np.argsort(-same[i, j], kind="stable")
            for x, y in zip(rows[i[order]].tolist(), right[j[order]].tolist()):
                p, q = find(part[x]), find(part[y])
                if p == q:
                    continue
                m, n = cuts[x + 1] - cuts[x], cuts[y + 1] - cuts[y]
                both = len(np.intersect1d(held[cuts[x] : cuts[x + 1]], held[cuts[y] : cuts[y + 1]], assume_unique=True))
                if both * den >= num * (m + n - both):
                    root[p] = q
                    us.append(ids[x])
                    vs.append(ids[y])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([np.asarray(table.column(c)) for c in ("band", "ti", "tj")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            for a, b in zip([0, *cuts.tolist()[:-1]], cuts.tolist()):
                yield table.slice(a, b - a)
            held = [table.slice(last)]
        yield from held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            if group.num_rows > 1:
                yield compare(group)

    return run


def _apart(split: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``split`` (band, place, id, part) the rows of bands with several parts, plus ``stray`` (not of the band's largest part)
    and the band's numbers of members and of strays."""
    counts = split.groupBy("band", "part").agg(F.count("*").alias("n"))
    mixed = scratch.table(
        counts.groupBy("band")
        .agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("band", F.col("main.part").alias("main"), "members", (F.col("members") - F.col("main.n")).alias("strays")),
        "near-mixed",
    )
    return split.join(mixed, "band").select("band", "place", "id", "part", (F.col("part") != F.col("main")).alias("stray"), "members", "strays")


def _dealt(apart: DataFrame) -> DataFrame:
    """Tiles (band, ti, tj) of ``apart``: every stray of block ti (``left``) meets every member of block tj (``right``)."""

    def block(n: str, salt: str):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(n) / TILE))

    def blocks(n: str):
        return F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / TILE) - 1)

    own = apart.withColumn("si", F.when(F.col("stray"), block("strays", "stray")).otherwise(-1)).withColumn("mj", block("members", "member"))
    as_member = F.transform(blocks("strays"), lambda i: F.struct(i.alias("ti"), F.col("mj").alias("tj"), (i == F.col("si")).alias("left"), F.lit(True).alias("right")))
    as_stray = F.transform(
        F.filter(blocks("members"), lambda j: F.col("stray") & (j != F.col("mj"))),
        lambda j: F.struct(F.col("si").alias("ti"), j.alias("tj"), F.lit(True).alias("left"), F.lit(False).alias("right")),
    )
    return own.select("band", "place", "id", "part", "stray", F.inline(F.concat(as_member, as_stray)))


def near_classes(docs: DataFrame, num: int = 4, den: int = 5, sketch_floor: float = 0.58) -> DataFrame:
    """doc_id, key (128-bit hash of the text), rep_id (smallest id with this text), class_id: one row per row of ``docs``.

    The similarity threshold is num / den.  The result is a table in the shared scratch folder.
    """
    m = BANDS * ROWS
    floor = int(np.ceil(sketch_floor * m))
    rows = docs.select("doc_id", "text", wide_hash(F.col("text")).alias("key"))
    whole = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = whole.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        reps = scratch.table(whole.groupBy("key").agg(F.min("doc_id").alias("rep_id")), "near-reps")
        only_reps = reps.select(F.col("rep_id").alias("id")).distinct()
        signed_docs = texts.mapInArrow(_sign(m), "id long, sig array<int>")
        sigs = scratch.table(signed_docs.join(only_reps, "id", "left_semi"), "near-signatures")

        bands = F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[F.get(F.col("sig"), b * ROWS + k) for k in range(ROWS)])
        )
        placed = sigs.select("id", F.posexplode(bands).alias("place", "band"))
        shared = scratch.table(placed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
        places = scratch.table(placed.join(shared, "band").select("band", "place", "id", "n"), "near-places")
        fame = places.groupBy("id").agg(F.sum("n").alias("fame"))
        hubs = scratch.table(
            places.join(fame, "id").groupBy("band").agg(F.max(F.struct("fame", (-F.col("id")).alias("less"))).alias("top"))
            .select("band", (-F.col("top.less")).alias("hub")),
            "near-hubs",
        )
        others = places.join(hubs, "band").filter("id <> hub")
        pairs = others.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
        left, right = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"{x}_sig")) for x in "uv")
        agree = F.size(F.filter(F.zip_with("u_sig", "v_sig", lambda a, b: a == b), lambda x: x))
        likely = scratch.table(pairs.join(left, "u").join(right, "v").filter(agree >= floor).select("u", "v"), "near-likely")
        u, v = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text")) for x in "uv")
        both = likely.join(u, "u").join(v, "v").select("u", "v", "u_text", "v_text")
        links = scratch.table(both.mapInArrow(_verify(num, den), "u long, v long").distinct(), "near-links")
        parts = scratch.adopt(connected_components(links))

        # what the hubs left apart
        split = scratch.table(
            others.filter("n > 2").select("band", "place", "id")
            .join(parts.withColumnRenamed("node", "id"), "id", "left")
            .select("band", "place", "id", F.coalesce("component", "id").alias("part")),
            "near-split",
        )
        apart = scratch.table(_apart(split, scratch), "near-apart")
        held = scratch.table(
            texts.withColumnRenamed("doc_id", "id").join(apart.select("id").distinct(), "id", "left_semi")
            .mapInArrow(_list_shingles, "id long, held array<long>"),
            "near-shingles",
        )
        owned = held.select("id", F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        # members with their shingles, and how many of those another of these members holds too
        members = (
            held.join(owned.filter("n = 1").groupBy("id").agg(F.count("*").alias("own")), "id", "left")
            .select("id", "held", F.size("held").alias("size"), (F.size("held") - F.coalesce("own", F.lit(0))).alias("most"))
            .filter(F.col("most") * den >= F.col("size") * num)
        )
        tiled = _dealt(apart).join(members.join(sigs, "id"), "id").repartition("band", "ti", "tj").sortWithinPartitions("band", "ti", "tj")
        columns = ["band", "ti", "tj", "left", "right", "stray", "place", "id", "part", "size", "most", "held", "sig"]
        rest = scratch.table(tiled.select(*columns).mapInArrow(_tiles(floor, num, den), "u long, v long"), "near-rest")
        if rest.take(1):
            parts = scratch.adopt(connected_components(links.union(rest)))
        named = (
            rows.select("doc_id", "key", F.col("text").isNull().alias("none"))
            .join(reps, "key", "left")
            .withColumn("rep_id", F.when(F.col("none") | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")))
            .join(parts.select(F.col("node").alias("rep_id"), "component"), "rep_id", "left")
        )
        return materialise(named.select("doc_id", "key", "rep_id", F.coalesce("component", "rep_id").alias("class_id")), "near-classes")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest doc_id of its class."""
    first = (
        near_classes(docs, **options).filter("doc_id = class_id").select(F.col("doc_id").alias("__nd_id"), F.col("key").alias("__nd_key")).distinct()
    )
    mine = (F.col("doc_id") == F.col("__nd_id")) & (wide_hash(F.col("text")) == F.col("__nd_key"))
    return docs.join(first, mine, "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
