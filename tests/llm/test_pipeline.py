"""The pipeline against plain Python, stage by stage, on planted cases."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glotweave.llm import language_id
from glotweave.llm.oracle import OP5
from tests.llm.test_operators import DOCS, classes_by_brute_force, language_rows, line_key, toks

COMMON = "bana mala kana lana bana mala kana"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Four invented languages; a common line, near copies, benchmark passages, odd rows."""
    rng = random.Random(21)
    rows = []
    for i, (_, text, lang, _, _) in enumerate(language_rows(160)):
        long = "\n".join([text + f" x{rng.randrange(10**6)}x", *(" ".join(text.split() + [text.split()[rng.randrange(len(text.split()))]]) for _ in range(3))])
        rows.append([i, long + ("\n" + COMMON if i % 20 == 0 else ""), lang, ["a", "b", None][i % 3], 0])
    words = rows[3][1].split()
    base = " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(120))
    for k in range(12):
        edited = base.split()
        edited[rng.randrange(120)] = f"zer{k}"
        rows.append([200 + k, " ".join(edited), "bb", "a", 0])
    item = " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(30))
    for k in range(4):
        rows.append([300 + k, f"{rows[k + 5][1]} {item}", rows[k + 5][2], "b", 0])
    rows += [[400, None, "aa", "a", 0], [401, "", "aa", "a", 0], [402, "123 !", "bb", None, 0], [None, "bana mala kana bana lana ka", "aa", "a", 0]]
    rows += [list(rows[7])]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(r):
    return repr((r["doc_id"], r["text"], r["lang"], r["source"]))


def test_stages_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.fit_documents(docs)
    judged = language_id.identify(docs, model).collect()
    one = [r for r in judged if r["lang_pred"] != "und" and not r["ambiguous"]]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], tables)
        assert out.columns == docs.columns
        steps.append(spark.createDataFrame(out.collect(), docs.schema))
    assert sorted(map(key, steps[1].collect())) == sorted(map(key, one)) and len(one) > 150

    holders = {}
    for r in one:
        if r["doc_id"] is not None:
            for line in r["text"].split("\n"):
                holders.setdefault(line_key(line), set()).add(r["doc_id"])
    two = []
    for r in one:
        gone = lambda x: r["doc_id"] is not None and len(line_key(x)) >= 20 and len(holders[line_key(x)]) >= 3 and max(holders[line_key(x)]) != r["doc_id"]
        text = "\n".join(x for x in r["text"].split("\n") if not gone(x))
        two.append({**r.asDict(), "text": text, "n_chars": len(text)})
    assert sorted(map(key, steps[2].collect())) == sorted(map(key, two)) and any(a["text"] != b["text"] for a, b in zip(one, two))

    classes = classes_by_brute_force(sorted({(r["doc_id"], r["text"]) for r in two if r["doc_id"] is not None}))
    three = [r for r in two if r["doc_id"] is None or classes[r["doc_id"]] == r["doc_id"]]
    assert sorted(map(key, steps[3].collect())) == sorted(map(key, three)) and len(three) < len(two) - 8

    item = toks(spark.read.parquet(f"{tables}/benchmark.parquet").filter("item_id = 1").first()["text"])

    def leaks(text):
        d = toks(text)
        return any(sum(a == b for a, b in zip(d[s : s + 13], item[o : o + 13])) >= 11 for s in range(len(d) - 12) for o in range(len(item) - 12))

    four = [r for r in three if r["doc_id"] is None or not leaks(r["text"])]
    assert sorted(map(key, steps[4].collect())) == sorted(map(key, four)) and len(four) < len(three)

    duck = duckdb.connect()
    duck.register("documents", pa.table({c: [r[c] for r in four] for c in ("doc_id", "source", "text")}, pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("text", pa.string())])))
    want = duck.sql(f"select doc_id, sum(taken // size) n from ({OP5}) where taken > 0 group by all").fetchall()
    got = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, got.groupBy("doc_id").agg(F.count("*")).collect()), key=repr) == sorted(((i, int(n)) for i, n in want), key=repr)
    assert {key(r) for r in got.collect()} <= {key(r) for r in four}


def test_extra_columns_pass_whatever_their_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = ["score", "lang_pred", "ambiguous", "n_lines", "n_dropped", "key", "size"]
    wide = docs
    for c in names:
        wide = wide.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, tables)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        same = [F.col(c) == F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in names]
        assert out.filter(~same[0] | ~same[1] | ~same[2] | ~same[3] | ~same[4] | ~same[5] | ~same[6]).count() == 0, name
        assert out.count() > 0
