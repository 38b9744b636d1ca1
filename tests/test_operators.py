"""Operators beyond the catalogue: small cases with known results."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

import weftline.streaming as streaming
from weftline.functions import arithmetic, languages, numbers, text
from weftline.operators import batches, checks, measure, prompts, records, scoring
from weftline.plans import catalog
from weftline.sources import config, conversion, manifests


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def shard(path, name, lines, packed=False):
    import gzip

    data = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    with (gzip.open if packed else open)(f"{path}/{name}", "wt") as f:
        f.write(data)


def test_manifests(spark, tmp_path):
    a = {"id": "a", "duration": 2.0, "supervisions": [{"id": "a", "text": "hi", "language": "en"}], "custom": {"pnc_text": "Hi."}}
    shard(tmp_path, "cuts.000000.jsonl", [a, "", "{broken", {"id": "b", "duration": 3.0}])
    shard(tmp_path, "cuts.000000.jsonl.gz", [a], packed=True)
    shard(tmp_path, "cuts.000001.jsonl.gz", [{"id": "c", "duration": 4.0, "custom": None}], packed=True)
    assert [f.rsplit("/", 1)[1] for f in manifests.manifest_files(spark, str(tmp_path))] == ["cuts.000000.jsonl", "cuts.000001.jsonl.gz"]
    df = manifests.read_manifests(spark, [str(tmp_path)])
    assert sorted((r["id"], r["shard"]) for r in df.collect()) == [("a", "000000"), ("b", "000000"), ("c", "000001")]
    assert df.agg(F.sum("duration")).first()[0] == 9.0
    assert manifests.first_record(spark, str(tmp_path))["id"] == "a"
    (tmp_path / "none").mkdir()
    assert manifests.read_manifests(spark, [str(tmp_path / "none")]).count() == 0
    with pytest.raises(ValueError):
        manifests.read_cuts_file(spark, str(tmp_path / "cuts.000000.jsonl"), "train")


def test_logs_and_results(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "rank0_ws2_worker1_pid7.jsonl").write_text(json.dumps({"batch_idx": 0, "num_cuts": 2, "cut_ids": ["a", "b"]}))
    (logs / "other.jsonl").write_text(json.dumps({"batch_idx": 0, "num_cuts": 1, "cut_ids": ["z"]}))
    got = manifests.read_emissions(spark, str(logs)).collect()
    assert [(r["rank"], r["world_size"], r["worker"], r["pid"], r["cut_ids"]) for r in got] == [(0, 2, 1, 7, ["a", "b"])]
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 1, "loss": 1.5, "grad_norm": 3.0}]}))
    assert sorted(map(tuple, manifests.read_history(spark, str(tmp_path / "state.json")).collect())) == [(1, "grad_norm", 3.0), (1, "loss", 1.5)]
    (tmp_path / "results.jsonl").write_text('{"id": "a"}\n{"file_id": "b"}\nbroken\n')
    assert {r["id"] for r in manifests.completed_ids(spark, str(tmp_path / "results.jsonl")).collect()} == {"a", "b"}


def test_markers_and_shards(spark, tmp_path):
    out = str(tmp_path / "out")
    assert not manifests.is_complete(spark, out) and not manifests.mark_complete(spark, out, errors=1)
    manifests.write_shards(spark.range(25).coalesce(1), out, 10)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]) == 3
    assert manifests.mark_complete(spark, out, errors=0) and manifests.is_complete(spark, out)


def test_tar_pairs(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as f:
        for name, data in (("a.wav", b"123"), ("a.json", b'{"transcript": "hello"}'), ("b.wav", b"1")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            f.addfile(info, io.BytesIO(data))
    got = conversion.webdataset_records(manifests.tar_members(spark, str(tmp_path))).collect()
    assert [(r["id"], r["text"], r["bytes"]) for r in got] == [("a", "hello", 3)]


def test_conversion(spark):
    df = spark.createDataFrame([("x/y.z", "hi", 1.0, "de_de"), (None, None, 2.0, "en")], "id string, transcription string, duration double, locale string")
    got = conversion.to_records(df, conversion.RECIPES["fleurs"]).collect()
    assert got[0]["id"] == "x_y_z" and got[0]["supervisions"][0]["language"] == "de" and got[0]["custom"] is None
    assert got[1]["id"].startswith("chunk") and got[1]["error"] == "no text"
    assert conversion.workers_for(50, 8, 100) == 1 and conversion.workers_for(1000, 8, 100) == 8


def test_configuration():
    cfg = config.load("a: ${oc.env:X,d}\nb: ${Y:-e}\nc: [$Z]\n", {"Z": "z"})
    assert cfg == {"a": "d", "b": "e", "c": ["z"]}
    tree = {"input_cfg": [{"type": "group", "weight": 0.5, "tags": {"lang": "en"}, "input_cfg": [{"type": "s", "weight": 0.25, "tags": {"lang": "de", "t": "1"}}, {"type": "s", "weight": 0.75}]}, {"type": "group", "weight": 0.5, "input_cfg": [{"type": "s"}]}]}
    leaves = config.leaves(tree)
    assert [x["effective_weight"] for x in leaves] == [0.125, 0.375, 0.5] and leaves[0]["tags"] == {"lang": "en", "t": "1"}
    assert batches.resolved_weights([None, None], [0, 900]) == [1.0, 900.0]
    with pytest.raises(ValueError):
        batches.resolved_weights([0.5, None], [1, 1])
    assert config.validation_path("/a/train", "dev") == "/a/dev"
    assert config.evaluation_settings({"text_field": "x", "other": 1}, {"text_field": None}) == {"text_field": None}


def test_boundaries_walk_like_the_plain_loop():
    import random

    rng = random.Random(0)
    values = sorted(round(rng.uniform(0.5, 30), 2) for _ in range(5000))
    total, run, want = sum(values) / 20, 0.0, []
    for d in values:
        if run > total:
            want.append(d)
            run = 0.0
        run += d
    hist = {}
    for d in values:
        hist[d] = hist.get(d, 0) + 1
    got = batches.boundaries(sorted(hist.items()), 20)
    assert len(got) == len(want) and all(abs(a - b) <= 0.01 for a, b in zip(got, want, strict=True))
    with pytest.raises(ValueError):
        batches.boundaries([], 5)
    with pytest.raises(ValueError):
        batches.boundaries([(1.0, 2)], 5)


def test_steps_and_shapes(spark):
    steps = arithmetic.steps_per_epoch(F.lit(0), F.lit(360000.0), batch_duration=200.0, world=4, accumulate=8)
    assert one(spark, steps) == 57
    assert one(spark, arithmetic.conv_length(F.lit(101), 2, 3, 2)) == 26
    assert one(spark, arithmetic.prefix_mask(F.lit(1), F.lit(3))) == [True, False, False]


def test_draws_follow_their_weights(spark):
    got = {r["source"]: r["count"] for r in batches.draw(spark.range(3000), [("a", 0.125), ("b", 0.375), ("c", 0.5)]).groupBy("source").count().collect()}
    assert abs(got["a"] / 3000 - 0.125) < 0.05 and abs(got["b"] / 3000 - 0.375) < 0.05 and abs(got["c"] / 3000 - 0.5) < 0.05


def test_languages(spark):
    assert one(spark, languages.folded(F.lit("ZH-CN"))) == "zh" and one(spark, languages.folded(F.lit("pt_PT"))) == "pt_PT"
    assert one(spark, languages.base_language(F.lit("a_b-c"))) == "a_b"
    assert one(spark, languages.language_name(F.lit("xx"))) == "xx"
    none = F.lit(None).cast("string")
    assert one(spark, languages.tracker_key(F.lit("st"), F.lit(" "), F.lit("en"), none)) == "st/en-unknown"
    assert one(spark, languages.tracker_key(F.lit(""), none, none, none)) == "unknown/unknown"


@pytest.mark.parametrize(("field", "strict", "want"), [("a.b", False, "x"), ("blank", False, None), ("none", False, "fall"), ("none", True, None), ("text", False, "fall")])
def test_text_resolution(spark, field, strict, want):
    custom = F.lit('{"a": {"b": " x "}, "blank": "  "}')
    assert one(spark, records.resolved_text(custom, field, F.lit("fall"), strict)) == want


def test_normalisers(spark):
    assert one(spark, text.basic_normalised(F.lit("Hello, [noise] (um) WORLD!  "))) == "hello world"
    assert one(spark, text.without_diacritics(F.lit("Łódź Straße"))) == "lodz strasse"
    assert one(spark, text.english_normalised(F.lit("Um, Mr. Smith won't pay twenty one dollars"))) == "mister smith will not pay $21"
    assert numbers.digits("one hundred and five") == "105" and numbers.digits("no one came") == "no one came"


def test_error_rates(spark):
    rows = [(0, "a b c", "a b c", "de"), (1, "a b c", "x y z", "fr"), (2, "a b c", "a x c", None), (3, "", "q", "fr")]
    df = spark.createDataFrame(rows, "batch int, prediction string, reference string, lang string")
    got = {r["lang"]: (r["samples"], r["wer"]) for r in scoring.error_rates(scoring.edits(df), ["lang"]).collect()}
    assert got == {"de": (1, 0.0), "fr": (2, 1.0), "unknown": (1, pytest.approx(1 / 3))}
    assert scoring.split_rates(scoring.edits(df.where("lang = 'de'")), "lang").count() == 0


def test_weights(spark):
    df = spark.createDataFrame([("en", "a", 900.0), ("en", "b", 100.0), ("de", "c", 400.0), ("fr", "d", 0.0)], "lang_key string, source string, hours double")
    got = {r["source"]: r for r in measure.two_tier_weights(df, 0.5, 0.5).collect()}
    assert got["a"]["p_c"] == pytest.approx(0.75) and got["d"]["p_c"] == 1.0 and got["d"]["p_l"] == 0.0
    assert sum(r["p_cl"] for r in got.values()) == pytest.approx(1.0)
    assert measure.greedy_budget([("a", 5), ("b", 3), ("c", 4)], 8) == ["b", "c"]


def test_label_masks(spark):
    ids = F.array(*[F.lit(x) for x in [9, 1, 2, 3, 4, 9]])
    assert one(spark, prompts.keep_spans(ids, [1, 2], [4])) == [-100, 1, 2, 3, 4, -100]
    assert one(spark, prompts.keep_spans(F.array(*[F.lit(x) for x in [1, 2, 7]]), [1, 2], [4])) == [1, 2, 7]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 0), (0, 3), (3, 6), (6, 9)]])
    assert one(spark, prompts.mask_prompt(F.array(*[F.lit(x) for x in [1, 2, 3, 4]]), spans, F.lit(5))) == [1, -100, 3, 4]
    assert one(spark, prompts.padded(F.array(F.lit(1)), F.lit(3), 0, left=True)) == [0, 0, 1]
    with pytest.raises(ValueError):
        prompts.boundaries("other")


def test_checks(spark):
    leaves = spark.createDataFrame([("l", 0.7, "en"), ("l", None, "de")], "level string, weight double, lang_key string")
    found = checks.union([checks.partly_weighted(leaves), checks.mixed_groups(leaves)])
    assert {r["check"] for r in found.collect()} == {"W1", "W4"} and checks.exit_code(found) == 2
    cfg = spark.createDataFrame([("t", 3, [1.0, 2.0], None, 5.0), ("u", 3, [2.0, 1.0], None, None), ("v", None, [1.0], None, None)], "split string, num_buckets int, bins array<double>, low double, high double")
    assert {(r["check"], r["place"]) for r in checks.bin_shape(cfg).collect()} == {("B2", "u"), ("B1", "v")}


def test_batches_close_before_the_limit(spark):
    df = spark.createDataFrame([(i, float(d), "x") for i, d in enumerate([4, 4, 4, 12, 1])], "id long, duration double, corpus string")
    got = {r["id"]: r["batch"] for r in batches.duration_batches(df, ["corpus"], 10.0, block=1).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "asr/en", 1800.0), ("b", "asr/en", 1800.0), ("c", "st/en-de", 3600.0)], "id string, key string, duration double").write.parquet(str(src))
    stream = spark.readStream.schema("id string, key string, duration double").parquet(str(src))
    q = streaming.seen_hours(stream, F.col("key")).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: r["hours"] for r in spark.table("hours").collect()} == {"asr/en": 1.0, "st/en-de": 1.0}
    out = str(tmp_path / "out")
    for k in range(2):
        streaming.append_new(stream, out, str(tmp_path / f"ck{k}")).start().awaitTermination()
    assert spark.read.json(out).count() == 3
    more = [("c", "x", 1.0), ("d", "x", 1.0), ("d", "x", 1.0)]
    spark.createDataFrame(more, "id string, key string, duration double").coalesce(1).write.mode("append").parquet(str(src))
    for k in (0, 2):  # a restart of the first query, and a new one
        streaming.append_new(stream, out, str(tmp_path / f"ck{k}")).start().awaitTermination()
        assert sorted(r["id"] for r in spark.read.json(out).collect()) == ["a", "b", "c", "d"]


def test_yaml_edits():
    body = "data:\n  train_ds:\n    total_hours: 1.0  # measured\n    input_cfg:\n      - weight: 2\n"
    assert config.line_index(body)["data.train_ds.total_hours"] == 3
    assert "total_hours: 7  # measured" in config.replaced_scalar(body, "data.train_ds.total_hours", "7")
    rows = [{"lang_key": "en", "path": "/a", "p_l": 0.6, "p_c": 1.0, "tags": {"lang": "en"}}, {"lang_key": "de", "path": "/b", "p_l": 0.4, "p_c": 1.0}]
    tree = config.load("input_cfg:\n" + config.weighted_yaml(rows))
    assert [x["effective_weight"] for x in config.leaves(tree)] == [0.6, 0.4]


def test_runtime_checks():
    cfg = {"data": {"strict_text_field": True, "train_ds": {"force_estimate": True, "max_duration": 40}, "validation_ds": {"total_hours": 1, "batch_size": 4, "input_cfg": [{"tags": {"text_field": "x"}}]}}}
    cfg |= {"trainer": {"do_eval": True, "eval_strategy": "steps", "per_device_eval_batch_size": -1}, "model": {"encoder": {"max_audio_seq_len": 1500}}}
    assert {f["check"] for f in checks.runtime(cfg, {"train_ds": True})} == {"E1", "E2", "E3", "C1", "C2", "C3", "C6"}


def test_probe_and_index_checks(spark):
    leaves = spark.createDataFrame([("a", "custom.t", "asr"), ("b", "", "asr"), ("c", "", "st"), ("d", "", "asr"), ("e", "custom.t", "asr")], "path string, text_field string, task string")
    first = spark.createDataFrame([("a", "x", "{}"), ("b", " ", "{}"), ("c", "x", '{"translation_en": "y"}'), ("d", "x", '{"pnc_text": "X."}'), ("e", "x", '{"t": "ok"}')], "path string, supervision_text string, custom string")
    assert {r["place"] for r in checks.text_probe(leaves, first).collect()} == {"a", "b", "c", "d"}
    files = spark.createDataFrame([("a", "0", 10.0, 10.0), ("a", "1", 10.0, 8.0), ("b", "0", 10.0, None)], "path string, shard string, modified double, index_modified double")
    assert {r["place"] for r in checks.stale_indexes(files).collect()} == {"a/1", "b/0"}
    assert {r["place"] for r in checks.missing_manifests(files, leaves).collect()} == {"c", "d", "e"}


def test_datasets(spark, tmp_path):
    from weftline.operators import datasets, schedule

    home = tmp_path / "set" / "en" / "train"
    home.mkdir(parents=True)
    shard(home, "cuts.000000.jsonl", [{"id": "a", "duration": 1.0}, {"id": "b", "duration": 1.0}])
    d = datasets.Dataset(str(tmp_path / "set"), languages=["en"])
    assert d.load(spark, "train", "en").count() == 2
    with pytest.raises(ValueError):
        d.path("train", "xx")
    assert datasets.resolve(spark, f"shar::{home}", "train", 1).count() == 1
    assert {r["id"] for r in datasets.manifest_ids(spark, str(home)).collect()} == {"a", "b"}
    assert schedule.evaluation_batch_size(-1) == 1 and schedule.resolved_seed("randomized", True, 3) == 3
    with pytest.raises(ValueError):
        schedule.resumed(spark.range(1).withColumnRenamed("id", "batch_idx"), 0, 2, 1, (4, 1))
    assert prompts.check_boundaries("chatml", "<|im_start|>assistant\nPROBE<|im_end|>\n") == []


def test_cache_and_copied_bins(spark):
    from weftline.operators import cache

    sources = spark.createDataFrame([("a", 5.0, 3), ("b", 9.0, 6), ("c", 1.0, 1)], "path string, modified double, shards int")
    known = spark.createDataFrame([("a", 5.5, 10, "{}", False, 1.0), ("b", 5.0, 10, "{}", False, 2.0)], "path string, measured double, cuts int, hist string, sampled boolean, hours double")
    j = cache.judged(sources, known)
    assert {r["path"]: r["verdict"] for r in j.collect()} == {"a": "reuse", "b": "stale", "c": "missing"}
    assert cache.to_measure(j, 5) == ["c"] and cache.to_measure(j, None) == ["b", "c"]
    assert cache.updated(known, known.where("path = 'b'").withColumn("hours", F.lit(7.0))).agg(F.sum("hours")).first()[0] == 8.0
    cfg = spark.createDataFrame([("t", [1.0, 5.0], [1.0, 2.0])], "split string, bins array<double>, expected array<double>")
    others = spark.createDataFrame([("o", [1.0, 5.0])], "name string, bins array<double>")
    assert [r["message"] for r in checks.copied_bins(cfg, others).collect()] == ["also in o"]


def test_diacritics_normalizer_counts_clusters_of_whole_texts(spark, tmp_path):
    letters = ["é", "a", "한", "\U0001f1e9\U0001f1ea", "ñ"]  # each one cluster
    data = [(n, "".join(letters[i % 5] for i in range(n))) for n in (0, 3, 150, 201, 2000)] + [(9, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["clusters"] for r in catalog.diacritics_normalizer(spark, str(tmp_path)).collect()}
    want = {n: None if t is None else len(" ".join(letters[i % 5] for i in range(n))) for n, t in data}
    assert got == want


@pytest.mark.parametrize("cell", [7, 100_000])
def test_places_and_carried_values_over_cells(spark, cell):
    import random

    from weftline.operators import order

    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, i, i + 1])) for i in rng.sample(range(5000), 300)] + [("hot", 9000 + i, None if i % 3 else i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, o long, v long").repartition(5)
    got = {r["o"]: r["pos"] for r in order.numbered(df, ["k"], "o", cell=cell).collect()}
    kept = {r["o"]: r["v"] for r in order.carried(df, "v", ["k"], "o", cell=cell).collect()}
    for k in ("a", "b", None, "hot"):
        rows, last = sorted((o, v) for x, o, v in data if x == k for v in [v if v is not None else -1]), None
        for i, (o, v) in enumerate(rows):
            last = last if v == -1 else v
            assert got[o] == i and kept[o] == last
    assert order.numbered(df.limit(0), ["k"], "o", cell=cell).count() == 0


def test_edit_distances_equal_the_plain_table():
    import random

    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for n, m, letters in ((0, 0, 2), (0, 5, 2), (3, 200, 3), (150, 170, 2), (200, 200, 50), (300, 90, 4)):
        a, b = [rng.randrange(letters) for _ in range(n)], [rng.randrange(letters) for _ in range(m)]
        near = [x for x in a if rng.random() > 0.05]
        for p, q in ((a, b), (b, a), (a, near), (near, a + b)):
            assert text.edit_distance(np.array(p, np.int32), np.array(q, np.int32)) == plain(p, q)


def test_word_errors_equal_the_plain_table(spark):
    rows = [("the cat sat on a mat", "the cat sat mat on"), ("a b c d", "a c d e f"), ("x", "x")]
    got = scoring.edits(spark.createDataFrame(rows, "reference string, prediction string"), normalise=False).collect()
    assert [(r["word_edits"], r["ref_words"]) for r in got] == [(3, 6), (3, 4), (0, 1)]


def test_compatibility_forms_and_white_space(spark):
    assert one(spark, text.basic_normalised(F.lit("ﬁne ½ ＡＢＣ ①"), nfkc=True)) == "fine 1 2 abc 1"
    assert one(spark, records.usable(F.lit("\t\u2003 x \n"))) == "x" and one(spark, records.usable(F.lit("\t\n\u2003"))) is None
    assert one(spark, languages.known(F.lit("\t"))) == "unknown"
    british = {"colour": "color", "organised": "organized"}
    assert one(spark, text.english_normalised(F.lit("The colour was organised"), british)) == "the color was organized"


def test_files_of_runs(spark, tmp_path):
    import gzip

    home = f"file://{tmp_path}"
    assert manifests.read_metadata(spark, f"{home}/none") == {}
    manifests.write_metadata(spark, f"{home}/meta", {"model": "m", "n": 3})
    assert manifests.read_metadata(spark, f"{home}/meta") == {"model": "m", "n": 3}
    next((tmp_path / "meta").glob("part-*")).write_text("{broken")
    for f in (tmp_path / "meta").glob(".*.crc"):
        f.unlink()
    assert manifests.read_metadata(spark, f"{home}/meta") == {}
    (tmp_path / "cuts").mkdir()
    shard(tmp_path / "cuts", "cuts.000000.jsonl", [{"id": "a", "duration": 1.0}])
    (tmp_path / "cuts" / "cuts.000001.jsonl.gz").write_bytes(gzip.compress(b'{"id": "b"}')[:-9])
    assert [r["id"] for r in manifests.read_manifests(spark, [f"{home}/cuts"], unreadable="empty").collect()][:1] == ["a"]
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        manifests.read_manifests(spark, [f"{home}/cuts"]).collect()
    for name in ("fleurs/de_de/train", "librispeech/clean/train", "odd/en/test", ".hidden/en/test"):
        (tmp_path / "tree" / name).mkdir(parents=True)
    with pytest.warns(UserWarning, match="odd"):
        tree = manifests.dataset_tree(spark, f"{home}/tree", ("fleurs", "librispeech"))
    assert [(e["dataset"], e["lang"]) for e in tree] == [("fleurs", "de"), ("librispeech", "en")]
