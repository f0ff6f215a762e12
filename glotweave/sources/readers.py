"""Sources: text lines, dictionaries, word lists and word vectors as DataFrames with explicit positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotweave.functions.text import WS, modern_thaana, strip

DICTIONARY = T.StructType([T.StructField(c, T.StringType()) for c in ("english", "transliteration", "dhivehi")])
_EXTENSIONS = {".parquet": "parquet", ".vec": "vec", ".bin": "binary"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(path)


def _text_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of a file or folder: by file name, then by place; Spark may read the pieces in any order.

    A row's place within its split comes from its monotonic id, the split's from the row counts of the splits before it,
    so the only window is over one row per split.
    """
    place = [F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")]
    raw = spark.read.text(path).select("value", *place)
    before = Window.orderBy("p", "b").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("p", "b").agg(F.min("m").alias("low"), F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(splits, ["p", "b"]).select(F.col("value").alias("line"), (F.col("base") + F.col("m") - F.col("low")).alias("line_no"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, file_no, line_no, line): every physical line, blank ones too, files in the order given.

    Lines of one file are numbered by their place in it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for no, path in enumerate(paths):
        require(spark, path)
        one = _text_in_order(spark, path).select(F.lit(path).alias("source"), F.lit(no).alias("file_no"), "line_no", "line")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no input files")
    return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(pair_no, english, transliteration, dhivehi): a CSV without header; a first record whose english cell is
    ``english`` is one after all.  English is stripped and lower-cased, dhivehi stripped; blank lines are skipped."""
    require(spark, path)
    fields = F.from_csv("line", ", ".join(f"{f.name} string" for f in DICTIONARY), {"mode": "PERMISSIVE"})
    lines = _text_in_order(spark, path).filter(strip(F.col("line")) != "")
    # a dictionary is small: its rows are numbered by one window
    rows = lines.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("long").alias("pair_no"), fields.alias("f")).select("pair_no", "f.*")
    return rows.filter(~((F.col("pair_no") == 0) & (F.lower(strip(F.col("english"))) == "english"))).select(
        "pair_no", F.lower(strip(F.col("english"))).alias("english"), "transliteration", strip(F.col("dhivehi")).alias("dhivehi")
    )


def seed_pairs(dictionary: DataFrame, use_transliteration: bool = False, dedup: bool = False, normalise: bool = False) -> DataFrame:
    """(pair_no, src, tgt) of a dictionary.

    ``normalise`` spells classical Thaana letters as the corpus does; ``dedup`` keeps the first of equal pairs, so that none is
    in both parts of a split.
    """
    src = F.col("transliteration" if use_transliteration else "dhivehi")
    pairs = dictionary.select("pair_no", (modern_thaana(src) if normalise else src).alias("src"), F.col("english").alias("tgt"))
    return pairs.groupBy("src", "tgt").agg(F.min("pair_no").alias("pair_no")).select("pair_no", "src", "tgt") if dedup else pairs


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): stripped non-blank lines in order; a missing file is an error."""
    lines = read_lines(spark, path).select("line_no", strip(F.col("line")).alias("value"))
    return lines.filter(F.col("value") != "")


def read_entity_lists(spark: SparkSession, directory: str) -> DataFrame:
    """(value): the distinct lower-cased entries of all *.txt files; a missing directory gives no rows."""
    if not _exists(spark, directory):
        return spark.createDataFrame([], "value string")
    raw = spark.read.option("pathGlobFilter", "*.txt").text(directory)
    return raw.select(F.lower(strip(F.col("value"))).alias("value")).filter("value <> ''").distinct()


def read_seed_words(spark: SparkSession, space_path: str) -> DataFrame:
    """(value): words listed beside an aligned space as ``<name>_seed_words``; no rows if the list is missing."""
    stem = space_path.rsplit(".", 1)[0] if space_path.rsplit("/", 1)[-1].count(".") else space_path
    for path in (f"{stem}_seed_words.txt", f"{stem}_seed_words"):
        if _exists(spark, path):
            return spark.read.text(path).select(strip(F.col("value")).alias("value")).filter("value <> ''")
    return spark.createDataFrame([], "value string")


def read_vec(spark: SparkSession, path: str) -> DataFrame:
    """(idx, word, vec) of a word2vec text file: a header ``n d``, then a word and d numbers per line."""
    require(spark, path)
    lines = _text_in_order(spark, path).withColumnRenamed("line_no", "no").filter("no > 0 and line <> ''")
    parts = F.split(F.regexp_replace("line", "\\s+\\z", ""), " ")
    return lines.select(
        (F.col("no") - 1).cast("int").alias("idx"), parts[0].alias("word"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("vec")
    )


#: Longest word of a binary vector file, in bytes.
_WORD_BYTES = 1024
_CHUNK = "chunk long, length long, head binary, tail binary, starts array<int>, stops array<long>, records array<long>"


def _chunks(batches) -> Iterator[tuple[int, bytes]]:
    """The bytes of each split of a file that is read as lines (chunk, line)."""
    now, lines = None, []
    for batch in batches:
        for chunk, line in zip(batch.column("chunk").to_pylist(), batch.column("line").to_pylist()):
            if chunk != now and lines:
                yield now, b"\n".join(lines) + b"\n"
                lines = []
            now = chunk
            lines.append(line)
    if lines:
        yield now, b"\n".join(lines) + b"\n"


def _record(data: bytes, at: int, dims: int) -> tuple[int, int, int] | None:
    """(word's begin, word's end, record's end) of the record at ``at``; None if no word is there, (begin, -1, -1) if it is cut off."""
    while data[at : at + 1] == b"\n":
        at += 1
    end = data.find(b" ", at, at + _WORD_BYTES)
    if end < 0:
        return (at, -1, -1) if len(data) - at < _WORD_BYTES else None
    try:
        data[at:end].decode()
    except UnicodeDecodeError:
        return None
    return None if end == at else (at, end, end + 1 + 4 * dims)


def _paths_through(dims: int, header: int):
    """For every place in the first bytes of a chunk at which records could begin: where the path of records leaves the chunk, and
    how many there are."""
    reach = 4 * dims + _WORD_BYTES + 2

    def run(batches):
        for chunk, data in _chunks(batches):
            known: dict[int, tuple[int, int] | None] = {}  # place -> where its path leaves the chunk, records on it
            places = [header] if chunk == 0 else range(min(reach, len(data)))
            for start in places:
                at, trail = start, []
                while at < len(data) and at not in known:
                    found = _record(data, at, dims)
                    if found is None or found[1] < 0:
                        known[at] = None if found is None else (at, 0)
                        break
                    trail.append(at)
                    at = found[2]
                end = known.get(at, (at, 0))
                for n, place in enumerate(reversed(trail), 1):
                    known[place] = end and (end[0], end[1] + n)
            through = {s: known[s] for s in places if known.get(s)}
            starts, stops, records = list(through), [v[0] for v in through.values()], [v[1] for v in through.values()]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            values = (chunk, len(data), data[: 2 * reach], data[-reach:], starts, stops, records)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _CHUNK.split(", ")])

    return run


def _chain(rows: list, header: int, dims: int) -> dict[int, tuple[int, int, int, bytes]] | None:
    """chunk -> (first record's place, records that begin in it, number of the first, bytes that follow the chunk), from the beginning of the
    file on; None if the paths of two chunks do not meet."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    out, place, number = {}, header, 0
    for i, r in enumerate(rows):
        after = b"".join(x["head"] for x in rows[i + 1 : i + 1 + max(2, 1 + 8192 // max(1, r["length"]))])
        if place >= r["length"]:  # a record that begins earlier fills the chunk
            out[r["chunk"]] = (r["length"], 0, number, b"")
            place -= r["length"]
            continue
        paths = {s: (stop, n) for s, stop, n in zip(r["starts"], r["stops"], r["records"])}
        if place not in paths:
            return None
        stop, n = paths[place]
        if stop < r["length"]:  # a word that is cut off by the chunk's end
            cut = bytes(r["tail"])[stop - r["length"] :] + after
            found = _record(cut, 0, dims)
            if cut.strip(b"\n"):
                if found is None or found[1] < 0:
                    return None
                stop, n = stop + found[2], n + 1
            else:
                stop = r["length"]
        out[r["chunk"]] = (place, n, number, after)
        place, number = stop - r["length"], number + n
    return out


def _decoded(dims: int, plan: dict[int, tuple[int, int, int, bytes]]):
    def run(batches):
        for chunk, data in _chunks(batches):
            at, n, number, after = plan[chunk]
            data += after
            for first in range(0, n, 1000):
                words, flat = [], np.empty((min(1000, n - first), dims), np.float64)
                for i in range(len(flat)):
                    begin, end, stop = _record(data, at, dims)
                    words.append(data[begin:end].decode())
                    flat[i] = np.frombuffer(data, dtype="<f4", count=dims, offset=end + 1)
                    at = stop
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dims, dtype=np.int32)), pa.array(flat.ravel()))
                idx = np.arange(number + first, number + first + len(flat), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(words), lists], ["idx", "word", "vec"])

    return run


def _decode_whole(batches):
    """A file whose words are not all UTF-8, from its beginning to its end; such bytes are left out."""
    for batch in batches:
        for content in batch.column("content").to_pylist():
            head, _, rest = content.partition(b"\n")
            n, d = map(int, head.split())
            at = 0
            for first in range(0, n, 1000):
                words, flat = [], np.empty((min(1000, n - first), d), np.float64)
                for i in range(len(flat)):
                    end = rest.index(b" ", at)
                    words.append(rest[at:end].lstrip(b"\n").decode("utf-8", "ignore"))
                    flat[i] = np.frombuffer(rest, dtype="<f4", count=d, offset=end + 1)
                    at = end + 1 + 4 * d
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, d, dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(flat), dtype=np.int32)), pa.array(words), lists], ["idx", "word", "vec"])


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, word, vec) of a word2vec binary file, decoded by executors, a split of the file each.

    Records have no marks, so one pass finds, for every place at the beginning of a split at which a record could begin, where its path of
    records leaves the split; chained from the file's header on, these say where records do begin.  The driver holds some
    kilobytes of each split.  A file with words that are not UTF-8 is decoded as a whole by one task.
    """
    require(spark, path)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("chunk"), F.col("value").cast("binary").alias("line"))
    first = lines.filter("chunk = 0").select("line").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    n, dims = map(int, bytes(first["line"]).split())
    header = len(first["line"]) + 1
    found = lines.mapInArrow(_paths_through(dims, header), _CHUNK).collect()  # a row for each split
    plan = _chain(found, header, dims)
    if plan is None or sum(p[1] for p in plan.values()) != n:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode_whole, "idx int, word string, vec array<double>")
    return lines.mapInArrow(_decoded(dims, plan), "idx int, word string, vec array<double>")


def read_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(idx, word, vec) by declared kind (parquet, vec, binary; word2vec and fasttext for saved models) or else by extension."""
    require(spark, path)
    kind = kind or next((k for ext, k in _EXTENSIONS.items() if path.rstrip("/").endswith(ext)), None)
    if kind in ("word2vec", "fasttext"):
        return spark.read.parquet(f"{path}/words")
    if kind is None and _exists(spark, f"{path}/words"):
        return spark.read.parquet(f"{path}/words")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "vec":
        return read_vec(spark, path)
    if kind == "binary":
        return read_word2vec_binary(spark, path)
    raise ValueError(f"cannot read {path!r}: give kind 'parquet', 'vec', 'binary', 'word2vec' or 'fasttext', or use one of {sorted(_EXTENSIONS)} (pickled models are not read)")


def cached_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A ``.vec`` file through a Parquet copy beside it, made on first use and sorted by idx; an unfinished copy is made anew."""
    side = path.removesuffix(".vec") + ".parquet"
    if not _exists(spark, f"{side}/_SUCCESS"):
        read_vec(spark, path).sort("idx").write.mode("overwrite").parquet(side)
    return spark.read.parquet(side)


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """(word1, word2, score) of a tab-separated benchmark; lines that start with # or have no number are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(parts[0].alias("word1"), parts[1].alias("word2"), F.expr("try_cast(split(value, '\t')[2] as double)").alias("score"))
    return rows.filter(F.col("score").isNotNull())


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """(section, a, b, c, d) of a question file: ``: section`` lines, then four words per line."""
    lines = read_lines(spark, path)
    named = F.when(F.col("line").startswith(":"), F.struct("line_no", F.trim(F.substring("line", 2, 1000)).alias("name")))
    ranges = lines.select(named.alias("s")).filter("s is not null").select("s.*")
    ends = ranges.select("name", F.col("line_no").alias("start"), F.lead("line_no", 1, 1 << 60).over(Window.orderBy("line_no")).alias("stop"))
    ws = F.filter(F.split("line", f"{WS}+"), lambda t: t != "")
    rows = lines.filter(~F.col("line").startswith(":")).select("line_no", ws.alias("w")).filter(F.size("w") == 4)
    # sections are few beside the questions; the join is by ranges of line numbers
    return rows.join(ends, (F.col("line_no") > F.col("start")) & (F.col("line_no") < F.col("stop"))).select(
        F.col("name").alias("section"), *[F.col("w")[i].alias(c) for i, c in enumerate("abcd")]
    )
