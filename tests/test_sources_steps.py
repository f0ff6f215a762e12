import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glotweave.operators.train import Settings, train
from glotweave.plans.config import Config
from glotweave.plans.steps import resolve, run_pipeline
from glotweave.sources import readers, sinks
from glotweave.streaming.cleaning import stream_clean, stream_lines


def test_lines_keep_order_and_blanks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\r\nthree", encoding="utf-8")
    got = [tuple(r) for r in readers.read_lines(spark, str(tmp_path / "a.txt")).select("line_no", "line").orderBy("line_no").collect()]
    assert got == [(0, "one"), (1, ""), (2, "two"), (3, "three")]
    with pytest.raises(FileNotFoundError):
        readers.read_lines(spark, str(tmp_path / "none.txt"))


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("\r\n Album ,nan,އަ \r\ncar,kaar,ކާ\r\n", encoding="utf-8")
    rows = readers.read_dictionary(spark, str(tmp_path / "d.csv")).orderBy("pair_no").collect()
    assert [(r["english"], r["transliteration"].strip(), r["dhivehi"]) for r in rows] == [("album", "nan", "އަ"), ("car", "kaar", "ކާ")]
    (tmp_path / "h.csv").write_text("english,t,d\nenglish,a,b\n", encoding="utf-8")
    assert readers.read_dictionary(spark, str(tmp_path / "h.csv")).count() == 1


def test_vec_round_trip_binary_and_cache(spark, tmp_path):
    v = spark.createDataFrame([(0, "a", [0.5, -1.25]), (1, "ބ", [1.0, 2.0])], "idx int, word string, vec array<double>")
    path = str(tmp_path / "x.vec")
    sinks.write_vec(v, path)
    assert open(path, encoding="utf-8").read() == "2 2\na 0.500000 -1.250000\nބ 1.000000 2.000000"
    for df in (readers.read_vectors(spark, path), readers.cached_vectors(spark, path), readers.cached_vectors(spark, path)):
        assert [tuple(r) for r in df.orderBy("idx").collect()] == [tuple(r) for r in v.collect()]
    (tmp_path / "x.bin").write_bytes(b"2 2\na " + struct.pack("<2f", 0.5, -1.25) + b"\n" + "ބ ".encode() + struct.pack("<2f", 1, 2) + b"\n")
    assert [tuple(r) for r in readers.read_vectors(spark, str(tmp_path / "x.bin")).orderBy("idx").collect()] == [tuple(r) for r in v.collect()]
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path))


def test_word_lists(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Male\n \nAddu\n"), (tmp_path / "two.txt").write_text("male \n")
    assert sorted(r[0] for r in readers.read_entity_lists(spark, str(tmp_path)).collect()) == ["addu", "male"]
    assert readers.read_entity_lists(spark, str(tmp_path / "none")).count() == 0
    assert [r["value"] for r in readers.read_word_list(spark, str(tmp_path / "one.txt")).orderBy("line_no").collect()] == ["Male", "Addu"]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.txt").write_text(": first\na b c d\n: second\ne f g h\nbad line\n")
    assert [tuple(r) for r in readers.read_analogies(spark, str(tmp_path / "q" / "q.txt")).orderBy("section").collect()] == [("first", "a", "b", "c", "d"), ("second", "e", "f", "g", "h")]


def _corpus():
    rng = np.random.default_rng(0)
    groups = [["red", "green", "blue"], ["cat", "dog", "cow"]]
    return [" ".join(rng.choice(groups[i % 2], 6)) for i in range(200)]


@pytest.mark.parametrize("skip_gram", [False, True])
def test_trained_neighbours_make_sense(spark, skip_gram):
    blocks = spark.createDataFrame([(x.split(),) for x in _corpus()], "tokens array<string>")
    s = Settings(dims=8, window=3, min_count=3, epochs=6, skip_gram=skip_gram, partitions=1, sample=0, min_n=2 if skip_gram else 0, max_n=3)
    a, b = train(blocks, s), train(blocks, s)
    rows = a.words.orderBy("idx").collect()
    assert rows == b.words.orderBy("idx").collect() and a.losses == b.losses and a.losses[-1] < a.losses[0]
    v = {r["word"]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in rows}
    assert v["red"] @ v["green"] > v["red"] @ v["cat"]
    unknown = a.vectors_of(spark.createDataFrame([("reddish",)], "word string")).first()
    assert (unknown["vec"] is not None) == skip_gram and not unknown["known"]


def _grid(n=4, m=5, repeat=60):
    """Sentences in which every word stands for a pair (row, column) and has words of that row and column beside it."""
    rng = np.random.default_rng(3)
    out = [[f"w{i}{j}" if k % 3 == 1 else rng.choice([f"r{i}a", f"r{i}b", f"c{j}a", f"c{j}b"]) for k in range(9)] for i in range(n) for j in range(m) for _ in range(repeat)]
    order = rng.permutation(len(out))
    return [out[i] for i in order]


def _analogies(spark, table, n=4, m=5):
    from glotweave.operators import intrinsic

    items = [(f"{i}{j}{k}{l}", f"w{i}{j}", f"w{i}{l}", f"w{k}{j}", f"w{k}{l}") for i in range(n) for k in range(n) for j in range(m) for l in range(m) if i != k and j != l]
    items = spark.createDataFrame([("grid", *x[1:]) for x in items], "category string, a string, b string, c string, d string")
    return intrinsic.analogy_accuracy(items, table).first()["accuracy"]


@pytest.mark.parametrize("skip_gram, partitions", [(True, 1), (True, 4), (False, 4)])
def test_training_solves_analogies(spark, skip_gram, partitions):
    """Words of a grid, told apart by the words beside them; random vectors don't solve them, trained ones do, by one task or several."""
    blocks = spark.createDataFrame([(i, [str(w) for w in x]) for i, x in enumerate(_grid())], "no int, tokens array<string>")
    s = Settings(dims=12, window=4, min_count=3, epochs=12, skip_gram=skip_gram, partitions=partitions, sample=0, rate=0.1)
    model = train(blocks, s)
    assert _analogies(spark, model.words) > 0.7
    assert all(x > y for x, y in zip(model.losses[:4], model.losses[1:5])) and model.losses[0] < 6 * np.log(2) + 0.01
    rng = np.random.default_rng(1)
    untrained = spark.createDataFrame([(r["idx"], r["word"], [float(x) for x in rng.normal(size=12)]) for r in model.words.select("idx", "word").collect()], "idx int, word string, vec array<double>")
    assert _analogies(spark, untrained) < 0.2


def test_rows_are_merged_by_weight():
    from glotweave.operators import train as T

    s = Settings(dims=2)
    v = lambda *x: np.array(x, np.float32).tobytes()
    table = pa.table({"range": [0, 0, 0], "row": [5, 3, 5], "weight": [3, 2, 1], "vin": [v(4, 0), v(1, 1), v(0, 8)], "vout": [v(1, 1), v(2, 2), v(5, 5)]})
    got = T._merged(s)(table)
    assert got.column("row").to_pylist() == [3, 5]
    assert T._table(got.column("vin"), 2).tolist() == [[1, 1], [3, 2]] and T._table(got.column("vout"), 2).tolist() == [[2, 2], [2, 2]]
    grams = pa.table({"range": [0, 0], "row": [-1, -1], "weight": [1, 1], "vin": [v(1, 0), v(0, 1)], "vout": [b"", b""]})
    assert T._merged(s)(grams).column("vout").to_pylist() == [b""]


def test_thinning_and_falling_rate(spark):
    """Frequent words are thinned, and the same settings give the same model."""
    blocks = spark.createDataFrame([(i, ["the"] * 8 + [f"w{i % 7}", f"v{i % 5}"]) for i in range(300)], "no int, tokens array<string>")
    models = [train(blocks, Settings(dims=4, epochs=1, partitions=2, sample=x)) for x in (0, 1e-3, 1e-3)]
    rows = [m.words.orderBy("idx").collect() for m in models]
    assert rows[1] == rows[2] and rows[0] != rows[1] and len(rows[0]) == 13


@pytest.mark.parametrize("skip_gram", [False, True])
def test_batches_take_the_gradient_of_negative_sampling(skip_gram, monkeypatch):
    """One batch against one example at a time, in double precision and without updates in between."""
    from glotweave.operators import train as T

    rng = np.random.default_rng(5)
    monkeypatch.setattr(T, "ROW_STEPS", 10**6)
    s = Settings(dims=4, window=2, skip_gram=skip_gram, negative=3)
    parts = [np.array([i, 10 + i, 10 + (i + 3) % 10]) for i in range(10)]
    flat, ahead = np.concatenate(parts), np.arange(0, 31, 3)
    inputs, outputs = (rng.normal(0, 0.5, (n, 4)).astype(np.float32) for n in (20, 10))
    ids, block, noise = rng.integers(0, 10, 30), np.repeat([0, 1, 2], 10), np.arange(10)
    got_in, got_out = inputs.copy(), outputs.copy()
    T._pass(ids, block, got_in, got_out, flat, ahead, noise, s, 0.1, np.random.default_rng(1), 100)
    draw = np.random.default_rng(1)
    reach = draw.integers(1, 3, 30)
    examples = []
    for t in range(30):
        around = [k for k in range(t - reach[t], t + reach[t] + 1) if k != t and 0 <= k < 30 and block[k] == block[t]]
        examples += [([ids[k]], ids[t]) for k in around] if skip_gram else [([ids[k] for k in around], ids[t])]
    drawn = draw.integers(0, 10, (len(examples), 3))
    want_in, want_out = inputs.astype(float), outputs.astype(float)
    for (context, target), negative in zip(examples, drawn):
        rows = np.concatenate([parts[w] for w in context])
        h = inputs[rows].astype(float).mean(axis=0)
        step = np.zeros(4)
        for w, label in [(target, 1), *[(w, int(w == target)) for w in negative]]:
            g = (label - 1 / (1 + np.exp(-outputs[w].astype(float) @ h))) * 0.1
            step += g * outputs[w]
            want_out[w] += g * h
        for r in rows:
            want_in[r] += step / (1 if skip_gram else len(rows))
    assert np.allclose(got_in, want_in, atol=1e-4) and np.allclose(got_out, want_out, atol=1e-4)


@pytest.mark.parametrize("skip_gram, grams", [(False, False), (False, True), (True, False), (True, True)])
def test_shared_negatives_take_the_same_gradient(skip_gram, grams, monkeypatch):
    """Groups of tokens with common negative words, against one pair at a time."""
    from glotweave.operators import train as T

    rng = np.random.default_rng(5)
    monkeypatch.setattr(T, "ROW_STEPS", 10**6)
    s, g = Settings(dims=4, window=2, skip_gram=skip_gram, negative=3), T.GROUP_TOKENS
    parts = [np.array([i, 10 + i, 10 + (i + 3) % 10]) if grams else np.array([i]) for i in range(10)]
    flat, ahead = np.concatenate(parts), np.arange(11) * len(parts[0])
    inputs, outputs = (rng.normal(0, 0.5, (n, 4)).astype(np.float32) for n in (20 if grams else 10, 10))
    ids, block, noise = rng.integers(0, 10, 30), np.repeat([0, 1, 2], 10), np.arange(10)
    got_in, got_out = inputs.copy(), outputs.copy()
    loss, examples = T._pass(ids, block, got_in, got_out, flat, ahead, noise, s, 0.1, np.random.default_rng(1), T.BATCH_TOKENS)
    draw = np.random.default_rng(1)
    reach, drawn = draw.integers(1, 3, (2, g)).ravel(), draw.integers(0, 10, (2, 2 * g if skip_gram else g))
    want_in, want_out, want, n = inputs.astype(float), outputs.astype(float), 0.0, 0
    for t in range(30):
        around = [k for k in range(t - reach[t], t + reach[t] + 1) if k != t and 0 <= k < 30 and block[k] == block[t]]
        for context in [[ids[k]] for k in around] if skip_gram else [[ids[k] for k in around]]:
            rows, n, step, noises = np.concatenate([parts[w] for w in context]), n + 1, np.zeros(4), drawn[t // g]
            h = inputs[rows].astype(float).mean(axis=0)
            for w, label, weight in [(ids[t], 1, 1), *[(w, int(w == ids[t]), 3 / len(noises)) for w in noises]]:
                x = outputs[w].astype(float) @ h
                e = weight * (label - 1 / (1 + np.exp(-x))) * 0.1
                step, want = step + e * outputs[w], want + weight * np.logaddexp(0, -x if label else x)
                want_out[w] += e * h
            for r in rows:
                want_in[r] += step / (1 if skip_gram else len(rows))
    assert examples == n and loss == pytest.approx(want, rel=1e-5)
    assert np.allclose(got_in, want_in, atol=1e-4) and np.allclose(got_out, want_out, atol=1e-4)


def test_rounds_exchange_rows_of_some_tasks_at_once(spark, monkeypatch):
    """Five tasks in rounds of two: each round begins where the last one ended, words of other rounds stay, and the model is as good."""
    from glotweave.operators import train as T

    monkeypatch.setattr(T, "ROUND_TASKS", 2)
    seen, made = [], T._trained_task
    monkeypatch.setattr(T, "_trained_task", lambda *a: seen.append((a[1], *a[4:])) or made(*a))
    blocks = spark.createDataFrame([(i, [str(w) for w in x]) for i, x in enumerate([*_grid(), *[["alone"] * 4] * 1])], "no int, tokens array<string>")
    s = Settings(dims=12, window=4, min_count=3, epochs=6, skip_gram=True, partitions=5, sample=0, rate=0.1)
    model = train(blocks, s)
    assert seen == [(e, r / 3, 1 / 3) for e in range(6) for r in range(3)]
    assert _analogies(spark, model.words) > 0.7 and all(x > y for x, y in zip(model.losses[:4], model.losses[1:5]))
    assert model.words.count() == len({w for x in _grid() for w in x}) + 1 and model.words.filter("size(vec) = 12").count() == model.words.count()


def test_saved_models_know_unknown_words(spark, tmp_path):
    from glotweave.operators.train import fetch_vectors, load_settings

    blocks = spark.createDataFrame([(x.split(),) for x in _corpus()], "tokens array<string>")
    asked = spark.createDataFrame([("red",), ("reddish",), ("zzz",), ("red",), (None,)], "word string")
    for grams in (3, 0):
        model = train(blocks, Settings(dims=8, window=3, epochs=2, partitions=2, min_n=grams and 2, max_n=grams))
        path = str(tmp_path / f"m{grams}")
        model.save(spark, path)
        assert load_settings(spark, path) == model.settings
        got = {r["word"]: r for r in fetch_vectors(asked, spark, path).collect()}
        assert set(got) == {"red", "reddish", "zzz"} and [got[w]["known"] for w in ("red", "reddish", "zzz")] == [True, False, False]
        for w, r in got.items():
            want = model.vectors_of(asked).filter(F.col("word") == w).first()["vec"]
            assert (r["vec"] is None) == (want is None) and (want is None or np.allclose(r["vec"], want, atol=1e-6))
        assert readers.read_vectors(spark, path).count() == readers.read_vectors(spark, path, "word2vec").count() == model.words.count()


def test_seed_pair_options(spark):
    d = spark.createDataFrame([(0, "one", "x", "\u07a4a"), (1, "one", "x", "\u07a4a"), (2, "two", "y", "b")], "pair_no long, english string, transliteration string, dhivehi string")
    assert readers.seed_pairs(d).count() == 3
    got = readers.seed_pairs(d, dedup=True, normalise=True).orderBy("pair_no").collect()
    assert [tuple(r) for r in got] == [(0, "\u078ea", "one"), (2, "b", "two")]


def test_half_written_cache_is_made_anew(spark, tmp_path):
    v = spark.createDataFrame([(0, "a", [0.5])], "idx int, word string, vec array<double>")
    sinks.write_vec(v, str(tmp_path / "x.vec"))
    (tmp_path / "x.parquet").mkdir()
    (tmp_path / "x.parquet" / "part-0.parquet").write_text("half")
    assert readers.cached_vectors(spark, str(tmp_path / "x.vec")).count() == 1


def test_vector_lines_round_half_to_even(spark):
    """Values midway between two of six decimals, as C and SQL print them."""
    values = [0.5**7, 3 * 0.5**7, -(0.5**7), 0.0000005, 1.0000005, 2.5e-7, -0.0, 1e22, float("nan")]
    v = spark.createDataFrame([(0, "a", values)], "idx int, word string, vec array<double>")
    assert sinks.vec_lines(v).filter("idx = 0").first()["line"] == "a " + " ".join("%.6f" % x for x in values)
    assert sinks.vec_lines(v).filter("idx = 0").first()["line"].startswith("a 0.007812 0.023438 -0.007812 ")


def test_probe_words(spark, tmp_path):
    sinks.write_probe_words(spark, str(tmp_path / "deep" / "probes.txt"))
    assert [r["value"] for r in readers.read_word_list(spark, str(tmp_path / "deep" / "probes.txt")).orderBy("line_no").collect()] == list(sinks.PROBE_WORDS)


def test_resolve_reports_all_mistakes():
    assert resolve("e.all,align")[0] == ("e", "preprocess")
    with pytest.raises(ValueError, match="x.y.*embed.*foo"):
        resolve(["x.y", "embed", "foo"])
    with pytest.raises(ValueError, match="nonsense"):
        Config.of({"nonsense": 1})


def test_pipeline_end_to_end(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "en.txt").write_text("\n".join(_corpus()), encoding="utf-8")
    table = str.maketrans("abcdefghijklmnopqrstuvwxyz", "".join(chr(0x780 + i) for i in range(26)))
    (tmp_path / "dv.txt").write_text("\n".join(x.translate(table) for x in _corpus()), encoding="utf-8")
    words = "red green blue cat dog cow".split()
    (tmp_path / "d.csv").write_text("\n".join(f"{w},{w},{w.translate(table)}" for w in words), encoding="utf-8")
    (tmp_path / "sim.tsv").write_text("# pairs\nred\tgreen\t9\nred\tcat\t1\ncat\tdog\t8\nred\tnope\t3\n")
    (tmp_path / "ana.txt").write_text(": s\nred green cat dog\n")
    (tmp_path / "forms.csv").write_text("one,many\n" + "\n".join(f"{a},{b}".translate(table) for a, b in (("red", "green"), ("cat", "dog"))))
    cfg = {
        "steps": "d.preprocess,e.preprocess,d.embed,e.embed,align,detect_loans,find_gaps,e.probes,e.test_embed,d.test_embed",
        "model_output_dhiv": p("dvm"), "trained_output_eng": p("enm"), "probe_words": ["red", "nope"], "dhiv_test_embedding": p("dvm"),
        "inflection_table": p("forms.csv"), "inflection_base": "one", "inflection_forms": {"plural": "many"}, "max_words": 4,
        "raw_dhiv": p("dv.txt"), "clean_dhiv": p("dvc"), "embedding_input": p("dvc"), "embedding_output_dhiv": p("dv.parquet"),
        "raw_eng": [p("en.txt")], "clean_eng": p("enc"), "embedding_input_eng": p("enc"), "eng_model_output": p("en.parquet"), "eng_vec_output": p("en.vec"),
        "vector_size": 6, "vector_size_eng": 6, "epochs": 2, "epochs_eng": 2, "workers": 1, "workers_eng": 1, "embedding_type_eng": "word2vec",
        "source_embedding": p("dv.parquet"), "target_embedding": p("en.parquet"), "seed_dictionary": p("d.csv"), "alignment_method": "procrustes",
        "alignment_output_prefix": p("al"), "aligned_space_output": p("aligned.parquet"), "ne_lists_dir": p("none"), "loan_output": p("loans"), "gap_output": p("gaps"),
        "test_input_file_eng": p("en.parquet"), "similarity_file": p("sim.tsv"), "analogy_file": p("ana.txt"), "eval_coherence_file": p("probes.txt"), "eval_output_trained_e": p("eval"),
    }
    out = run_pipeline(spark, cfg)
    assert out["e.preprocess"].first()["clean_lines"] == 200
    assert spark.read.option("header", True).csv(p("loans")).columns == ["word", "romanised", "category", "best_english_match", "phonetic_score", "embed_score"]
    assert spark.read.option("header", True).csv(p("gaps")).columns == ["english_word", "nearest_dhivehi", "cosine_sim", "is_gap", "domain"]
    # all six words are seeds, so nothing is left to scan
    assert out["find_gaps"].count() == 0 and out["detect_loans"].count() == 4
    row = spark.read.parquet(p("eval")).first()
    assert row["vocab_size"] == 6 and row["coherence_skipped"] == 1 and row["oov_ratio"] == 25.0
    assert open(p("probes.txt")).read() == "red\nnope"
    sections = spark.read.option("header", True).csv(p("eval_sections")).collect()
    assert [(r["section"], r["n_evaluated"]) for r in sections] == [("s", "1")]
    report = dict(line.split(": ") for line in open(p("al_procrustes_eval.txt"), encoding="utf-8").read().split("\n"))
    assert -1 <= float(report["mean_cosine_train"]) <= 1 and report["rsa_n_pairs" if "rsa_n_pairs" in report else "eigval_k"]
    assert spark.read.option("sep", "\t").csv(p("al_train_pairs")).count() == 6
    assert [(r["task"], r["category"]) for r in out["d.test_embed"].orderBy("category").collect()] == [("analogy", None), ("analogy", "plural")]


def test_streaming_clean(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello — World\n123\n", encoding="utf-8")
    q = stream_clean(stream_lines(spark, str(tmp_path / "in")), "english").writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["line"] for r in spark.sql("select line from cleaned").collect()] == ["hello   world"]


def test_streaming_counts(spark, tmp_path):
    from glotweave.streaming.cleaning import stream_foreign_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("héllo Héllo you\nñ\n", encoding="utf-8")
    q = stream_foreign_counts(stream_lines(spark, str(tmp_path / "in")), "english").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select token, n from counted").collect()) == [("héllo", 2), ("ñ", 1)]


@pytest.mark.parametrize("newline, dims, split", [(True, 7, 300), (False, 7, 97), (True, 300, 5000), (False, 1, 40), (True, 3, 1 << 20)])
def test_binary_vectors_in_splits(spark, tmp_path, newline, dims, split):
    """A file of many splits against its records in order: line ends and spaces inside vectors, long and short words, with and without line ends behind them."""
    rng = np.random.default_rng(dims)
    words = [rng.choice(["a", "Ünï", "漢字", "word", "x" * 200]) + str(i) for i in range(200)]
    m = rng.normal(size=(200, dims)).astype("<f4")
    m[::3] = np.frombuffer(b"\n \n\x20" * dims, "<f4")
    m[-1] = np.frombuffer(b"abc\n" * dims, "<f4")
    path = tmp_path / "v.bin"
    path.write_bytes(f"200 {dims}\n".encode() + b"".join(w.encode() + b" " + v.tobytes() + b"\n" * newline for w, v in zip(words, m)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = readers.read_word2vec_binary(spark, str(path))
        assert split > 10**5 or out.rdd.getNumPartitions() > 3
        got = sorted(out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["idx"], r["word"]) for r in got] == list(enumerate(words))
    assert np.array_equal(np.array([r["vec"] for r in got], dtype="<f4").view("<i4"), m.view("<i4"))


def test_binary_vectors_with_odd_words(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    path = tmp_path / "v.bin"
    path.write_bytes(b"2 3\n" + b"a\xff " + m[0].tobytes() + b"\n" + b"b " + m[1].tobytes() + b"\n")
    assert [tuple(r) for r in readers.read_word2vec_binary(spark, str(path)).orderBy("idx").collect()] == [(0, "a", [0.0, 1.0, 2.0]), (1, "b", [3.0, 4.0, 5.0])]
