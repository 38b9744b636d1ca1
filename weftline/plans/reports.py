"""Further registered queries: statistics, reports, configuration checks, and sources and sinks over real files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import languages, text
from weftline.operators import batches, checks, datasets, measure, pairing, records, schedule
from weftline.plans.catalog import _QUERIES, CUTS, FOLD, WORDS, query, read
from weftline.sources import conversion, manifests


def registered() -> dict[str, Callable]:
    return _QUERIES


# records and statistics


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(9) || ' ' || chr(10) ELSE text END AS text, CASE WHEN doc_id % 11 > 0 THEN doc_id END AS audio FROM documents)
  SELECT doc_id FROM d WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND audio IS NOT NULL""")
def validity_filter(spark, sf_dir):
    """Records with text and with audio that can be read."""
    d = read(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "\t \n").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 11 > 0, F.col("doc_id")).alias("audio"))
    return records.valid(d, F.col("text"), F.col("audio")).select("doc_id")


@query(f"""WITH {CUTS}, w AS (SELECT *, CAST({WORDS} AS BIGINT) AS n_words FROM cuts)
  SELECT coalesce(corpus, '') AS corpus, coalesce(task, '') AS task, coalesce(lang, '') AS lang, count(*) AS num_cuts, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS mean_seconds,
  CAST(sum(n_words) AS BIGINT) AS total_words, round(avg(n_words), 6) AS mean_words, round(CAST(median(n_words) AS DOUBLE), 6) AS median_words, round(coalesce(stddev_samp(n_words), 0), 6) AS stdev_words,
  CAST(grouping_id(corpus, task, lang) AS BIGINT) AS level FROM w GROUP BY GROUPING SETS ((corpus, task, lang), (corpus), (task), (lang), ())""")
def length_report(spark, sf_dir):
    """Duration and words with mean, median and deviation by source, task, language and in all."""
    d = records.records(spark, sf_dir).withColumn("n_words", text.word_count(F.col("text")))
    return measure.length_statistics(d.select("corpus", "task", "lang", "duration", "n_words"), [["corpus", "task", "lang"], ["corpus"], ["task"], ["lang"], []], ["corpus", "task", "lang"])


_BASE = "CASE WHEN contains({0}, '-') THEN split_part({0}, '-', 1) ELSE split_part({0}, '_', 1) END"


@query(f"""WITH {CUTS}, t AS (SELECT corpus, task, lang || '_XX' AS lang, CASE WHEN task = 'st' AND id % 3 > 0 THEN lang || '-YY' END AS src, CASE WHEN task = 'st' AND id % 5 > 0 THEN tgt_lang END AS tgt, duration FROM cuts),
  s AS (SELECT corpus, task, lang, src, tgt, count(*) AS n, floor(round(sum(duration) * 100) / 36 + 0.5) / 10000 AS h FROM t GROUP BY ALL),
  p AS (SELECT *, coalesce(src, 'en') AS a, coalesce(tgt, lang) AS b FROM s),
  k AS (SELECT 'task' AS kind, task AS key, n, h FROM s UNION ALL SELECT 'pair', a || '->' || b, n, h FROM p WHERE task = 'st'
  UNION ALL SELECT 'base_pair', {_BASE.format('a')} || '->' || {_BASE.format('b')}, n, h FROM p WHERE task = 'st'
  UNION ALL SELECT 'variant', lang, n, h FROM s WHERE task <> 'st' UNION ALL SELECT 'language', {_BASE.format('lang')}, n, h FROM s WHERE task <> 'st')
  SELECT kind, key, CAST(sum(n) AS BIGINT) AS num_cuts, round(sum(h), 4) AS hours FROM k GROUP BY ALL""")
def keyed_statistics(spark, sf_dir):
    """By task, language, variant, pair and base pair, hours rounded by source first."""
    d, st = records.durations(spark, sf_dir), F.col("task") == "st"
    d = d.select("corpus", "task", F.concat("lang", F.lit("_XX")).alias("lang"), F.when(st & (F.col("id") % 3 > 0), F.concat("lang", F.lit("-YY"))).alias("src_lang"), F.when(st & (F.col("id") % 5 > 0), F.col("tgt_lang")).alias("tgt_lang"), "duration")
    return measure.keyed_statistics(d, ["corpus"])


@query("""WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS v, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 16) AS BIGINT) AS chunk FROM events)
  SELECT event_type, chunk, count(*) AS rows, count(*) FILTER (TRY_CAST(v AS BIGINT) IS NULL) AS bad FROM e GROUP BY ALL""")
def chunk_errors(spark, sf_dir):
    """Chunks whose bad rows are counted and fail alone."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("v"))
    return schedule.chunk_report(schedule.chunked(e, 16, ["event_type"], "event_id"), ["event_type"], F.col("v").try_cast("bigint"))


@query("SELECT source, CASE lower(lang || '_' || upper(lang)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in languages.FOLDERS.items()) + " ELSE lower(lang || '_' || lang) END AS code, count(*) AS n FROM documents GROUP BY ALL")
def folder_codes(spark, sf_dir):
    """Folder names to language codes."""
    d = read(spark, sf_dir, "documents").select("source", languages.folder_language(F.concat("lang", F.lit("_"), F.upper("lang"))).alias("code"))
    return d.groupBy("source", "code").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sv-SE' WHEN doc_id % 3 = 0 THEN 'de_DE' ELSE lang END AS tag FROM documents) SELECT doc_id, {FOLD.format('tag')} AS lang, CASE WHEN {FOLD.format('tag')} <> tag THEN tag END AS region_code FROM t")
def region_tags(spark, sf_dir):
    """Tags folded, the region kept."""
    tag = F.when(F.col("doc_id") % 2 == 0, "sv-SE").when(F.col("doc_id") % 3 == 0, "de_DE").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in languages.rewritten(tag).items()])


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def dataset_shard(spark, sf_dir):
    """One worker's share of a Parquet snapshot."""
    return datasets.sharded(read(spark, sf_dir, "documents").select("doc_id"), 4, 1, "doc_id")


@query("SELECT epoch, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents, (SELECT unnest(range(3)) AS epoch) GROUP BY 1")
def repeated_epochs(spark, sf_dir):
    """Passes over a source, each complete and in its own order."""
    d = schedule.repeated(read(spark, sf_dir, "documents").select("doc_id"), 3, 42, "doc_id")
    return d.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@query(f"""WITH {CUTS}, s AS (SELECT lang, corpus, sum(duration) / 3600 AS h FROM cuts GROUP BY ALL), l AS (SELECT *, sum(h) OVER (PARTITION BY lang) AS of FROM s)
  SELECT row_number() OVER (ORDER BY round(of, 6) DESC, lang, round(h, 6) DESC, corpus) AS place, printf('%-6s %-12s %10.2f h %6.2f %%', lang, corpus, h, 100 * h / of) AS line FROM l""")
def report_table(spark, sf_dir):
    """Languages by hours, their sources by hours, as lines of a table."""
    s = records.durations(spark, sf_dir).groupBy("lang", "corpus").agg((F.sum("duration") / 3600).alias("h")).withColumn("of", F.sum("h").over(Window.partitionBy("lang")))
    order = Window.orderBy(F.desc(F.round("of", 6)), "lang", F.desc(F.round("h", 6)), "corpus")  # a report's rows
    return s.select(F.row_number().over(order).cast("long").alias("place"), F.format_string("%-6s %-12s %10.2f h %6.2f %%", "lang", "corpus", F.col("h"), 100 * F.col("h") / F.col("of")).alias("line"))


# configuration checks


@query("""WITH w AS (SELECT o_orderpriority AS level, o_orderstatus AS source, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS expected FROM orders GROUP BY 1, 2),
  g AS (SELECT level, level || '/' || source AS source, expected, CASE WHEN level LIKE '1%' THEN 2 * expected WHEN level LIKE '2%' AND source = 'P' THEN -expected ELSE expected END AS weight FROM w)
  SELECT 'W2' AS "check", 'FAIL' AS severity, level AS place, printf('sum %.6f, %d not positive', sum(weight), count(*) FILTER (weight <= 0)) AS message FROM g GROUP BY level HAVING abs(sum(weight) - 1) > 1e-6 OR count(*) FILTER (weight <= 0) > 0
  UNION ALL SELECT 'W3', 'FAIL', source, printf('%.6f, expected %.6f', weight, expected) FROM g WHERE abs(weight - expected) > 1e-6""")
def weight_checks(spark, sf_dir):
    """chk:W2 chk:W3: sums of given weights, and their drift from computed ones."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("level"), "o_orderstatus").agg(F.count("*").alias("n"))
    w = o.select("level", F.concat_ws("/", "level", "o_orderstatus").alias("source"), (F.col("n") / F.sum("n").over(Window.partitionBy("level"))).alias("expected"))
    minus = F.col("level").startswith("2") & F.col("source").endswith("/P")
    given = w.withColumn("weight", F.when(F.col("level").startswith("1"), 2 * F.col("expected")).when(minus, -F.col("expected")).otherwise(F.col("expected")))
    return checks.weight_sums(given).unionByName(checks.weight_drift(given.drop("expected"), w.select("source", "expected")))


@query("""WITH n AS (SELECT n_regionkey AS g, CASE WHEN n_regionkey > 1 AND (n_regionkey = 2 OR n_nationkey % 2 = 0) THEN n_name END AS name FROM nation), c AS (SELECT g, count(name) AS named, count(*) AS n FROM n GROUP BY 1)
  SELECT 'N1' AS "check", 'FAIL' AS severity, 'sets' AS place, 'no set is named' AS message FROM c WHERE g = 0 AND named = 0
  UNION ALL SELECT 'N2', 'FAIL', 'sets', named || ' of ' || n || ' named' FROM c WHERE g = 3 AND named > 0 AND named < n""")
def name_checks(spark, sf_dir):
    """chk:N1 chk:N2 on three configurations: nothing named, all named, some named."""
    n = read(spark, sf_dir, "nation")
    named = (F.col("n_regionkey") > 1) & ((F.col("n_regionkey") == 2) | (F.col("n_nationkey") % 2 == 0))
    sets = n.select("n_regionkey", F.when(named, F.col("n_name")).alias("name"))
    return checks.union([checks.partly_named(sets.where(F.col("n_regionkey") == g).select("name")) for g in (0, 2, 3)])


@query("""WITH m AS (SELECT o_orderpriority AS split, sum(o_totalprice) / 3600 AS h, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT *, CASE WHEN split LIKE '1%' THEN h * 1.001 ELSE h END AS dh, CASE WHEN split LIKE '2%' THEN n + 2 ELSE n END AS dn FROM m)
  SELECT 'H1' AS "check", 'FAIL' AS severity, split AS place, printf('%.4f h, measured %.4f h', dh, h) AS message FROM d WHERE abs(dh - h) > greatest(0.1, 0.0005 * h)
  UNION ALL SELECT 'H2', 'FAIL', split, printf('%d records, measured %d', dn, n) FROM d WHERE abs(dn - n) > greatest(1, floor(0.0001 * n))""")
def total_checks(spark, sf_dir):
    """chk:H1 chk:H2: declared totals against measured ones."""
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("split")).agg((F.sum("o_totalprice") / 3600).alias("measured_hours"), F.count("*").alias("measured_cuts"))
    declared = m.select(
        "split",
        F.when(F.col("split").startswith("1"), F.col("measured_hours") * 1.001).otherwise(F.col("measured_hours")).alias("hours"),
        F.when(F.col("split").startswith("2"), F.col("measured_cuts") + 2).otherwise(F.col("measured_cuts")).alias("cuts"),
    )
    return checks.drift(declared, m)


_BINS = """WITH c AS (SELECT n_name AS split, CASE WHEN n_nationkey % 6 > 0 THEN 4 END AS k, [1.0 + n_regionkey, 3.5, 6.0 + n_nationkey % 3]::DOUBLE[] AS bins, [1.0 + n_regionkey, 3.5, 6.0]::DOUBLE[] AS expected, 0.5::DOUBLE AS low, 7.5::DOUBLE AS high, 6.5::DOUBLE AS p99 FROM nation),
  o AS (SELECT *, list_max(list_transform(list_zip(bins, expected), lambda z: abs(z[1] - z[2]))) AS off, list_max(list_transform(list_zip(bins, expected), lambda z: abs(z[1] - z[2]) / z[2])) AS rel FROM c)"""


@query(f"""{_BINS} SELECT 'B1' AS "check", 'FAIL' AS severity, split AS place, 'no num_buckets' AS message FROM o WHERE k IS NULL
  UNION ALL SELECT 'B2', 'FAIL', split, '3 boundaries' FROM o WHERE k IS NOT NULL AND (bins[1] >= bins[2] OR bins[2] >= bins[3] OR bins[3] >= high)
  UNION ALL SELECT 'B3', 'FAIL', split, printf('off by %.4f s', off) FROM o WHERE off > 0.05 AND rel > 0.02
  UNION ALL SELECT 'C4', 'WARN', split, 'p99 is 6.50 s' FROM o WHERE bins[3] < p99
  UNION ALL SELECT 'C5', 'WARN', a.split, 'also in ' || b.name FROM o a JOIN (SELECT n_regionkey AS name, [1.0 + n_regionkey, 3.5, 7.0]::DOUBLE[] AS bins FROM nation GROUP BY 1) b ON a.bins = b.bins WHERE off > 0.05 AND rel > 0.02""")
def bin_checks(spark, sf_dir):
    """chk:B1 chk:B2 chk:B3 chk:C4 chk:C5: shape, drift, reach and origin of bucket boundaries."""
    n, d = read(spark, sf_dir, "nation"), lambda c: c.cast("double")
    first = d(1 + F.col("n_regionkey"))
    configs = n.select(
        F.col("n_name").alias("split"), F.when(F.col("n_nationkey") % 6 > 0, 4).alias("num_buckets"), F.array(first, F.lit(3.5), d(6 + F.col("n_nationkey") % 3)).alias("bins"),
        F.array(first, F.lit(3.5), F.lit(6.0)).alias("expected"), F.lit(0.5).alias("low"), F.lit(7.5).alias("high"), F.lit(6.5).alias("p99"),
    )
    others = n.select(F.col("n_regionkey").cast("string").alias("name"), F.array(first, F.lit(3.5), F.lit(7.0)).alias("bins")).distinct()
    return checks.union([checks.bin_shape(configs), checks.bin_drift(configs), checks.short_top(configs), checks.copied_bins(configs, others)])


@query("""WITH l AS (SELECT n_name AS source, n_regionkey % 3 AS r, n_nationkey % 4 AS t, n_nationkey FROM nation),
  f AS (SELECT r, CASE WHEN n_nationkey % 5 = 0 THEN 'custom.x' ELSE 'text' END AS text_field, count(*) AS n FROM l GROUP BY ALL),
  m AS (SELECT r, arg_min(text_field, (-n, text_field)) AS best, sum(n) - max(n) AS other FROM f GROUP BY 1)
  SELECT 'T1' AS "check", 'WARN' AS severity, source AS place, 'lang' AS message FROM l WHERE t = 1
  UNION ALL SELECT 'T5', 'WARN', 'c' || r || '/asr', CAST(other AS BIGINT) || ' do not read ' || best FROM m WHERE other > 0
  UNION ALL SELECT 'D1', 'WARN', source, 'no manifest' FROM l WHERE t = 2
  UNION ALL SELECT 'D2', 'WARN', source || '/0', 'no index' FROM l WHERE t = 0
  UNION ALL SELECT 'D2', 'WARN', source || '/0', 'index older than its shard' FROM l WHERE t = 3""")
def tag_and_file_checks(spark, sf_dir):
    """chk:T1 chk:T5 chk:D1 chk:D2: tags that groups override, fields that sources disagree on, manifests and indexes."""
    n = read(spark, sf_dir, "nation").withColumn("t", F.col("n_nationkey") % 4)
    name = F.col("n_name")
    tags = n.select(name.alias("source"), F.create_map(F.lit("lang"), F.lit("de"), F.lit("task"), F.lit("asr")).alias("tags"), F.create_map(F.lit("lang"), F.when(F.col("t") == 1, "en").otherwise("de")).alias("group_tags"))
    fields = n.select(F.concat(F.lit("c"), F.col("n_regionkey") % 3).alias("corpus"), F.lit("asr").alias("task"), F.when(F.col("n_nationkey") % 5 == 0, "custom.x").otherwise("text").alias("text_field"))
    files = n.where("t <> 2").select(name.alias("path"), F.lit("0").alias("shard"), F.lit(10.0).alias("modified"), F.when(F.col("t") == 1, 10.0).when(F.col("t") == 3, 5.0).alias("index_modified"))
    return checks.union([checks.tag_conflicts(tags), checks.field_disagreement(fields), checks.missing_manifests(files, n.select(name.alias("path"))), checks.stale_indexes(files)])


# sources and sinks over files


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, round(CAST(n_chars AS DOUBLE) / 15, 2) AS duration, md5(text) AS digest, lang AS language, source, CAST(doc_id % 3 AS VARCHAR) AS k FROM documents""")
def manifest_round_trip(spark, sf_dir):
    """Documents as gzip manifests of one source and plain ones of another, read in one scan."""
    d = read(spark, sf_dir, "documents")
    one = F.array(F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("language")))
    out = d.select(F.col("doc_id").cast("string").alias("id"), F.round(F.col("n_chars").cast("double") / 15, 2).alias("duration"), one.alias("supervisions"), F.struct("source", (F.col("doc_id") % 3).alias("k")).alias("custom"), "doc_id")
    home = manifests.scratch(spark, "manifests")
    for part in (0, 1):
        manifests.write_manifest(out.where(F.col("doc_id") % 2 == part).drop("doc_id"), f"{home}/{part}", 100, gzip=bool(part))
    got = manifests.read_manifests(spark, [f"{home}/0", f"{home}/1"])
    field = lambda name: F.get_json_object("custom", f"$.{name}").alias(name)
    return got.select("id", "duration", F.md5(F.get("supervisions", 0)["text"]).alias("digest"), F.get("supervisions", 0)["language"].alias("language"), field("source"), field("k"))


@query("""WITH b AS (SELECT user_id % 4 AS rank, event_id % 2 AS worker, floor(event_id / 50) AS batch_idx, event_id FROM events)
  SELECT CAST(rank AS INT) AS rank, 4 AS world_size, CAST(worker AS INT) AS worker, CAST(batch_idx AS BIGINT) AS batch_idx, CAST(count(*) AS INT) AS num_cuts, min(event_id) AS first FROM b WHERE batch_idx % 2 = 0 AND batch_idx < 100 GROUP BY ALL""")
def emission_round_trip(spark, sf_dir):
    """The batch plan written as emission logs, every second batch, fifty at most, and read back."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rank"), (F.col("event_id") % 2).alias("worker"), F.floor(F.col("event_id") / 50).alias("batch_idx"), F.col("event_id").cast("string").alias("id"))
    plan = e.groupBy("rank", "worker", "batch_idx").agg(F.collect_list("id").alias("cut_ids"))  # a batch of at most 50
    home = manifests.scratch(spark, "emissions")
    manifests.write_emissions(plan, home, 4, every=2, most=50)
    got = manifests.read_emissions(spark, home)
    return got.select("rank", "world_size", "worker", "batch_idx", "num_cuts", F.array_min(F.transform("cut_ids", lambda c: c.cast("bigint"))).alias("first"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 > 0")
def results_round_trip(spark, sf_dir):
    """Results appended in two runs; what they hold is left out of the next."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    home = manifests.scratch(spark, "results")
    for part in (0, 3):
        manifests.append_results(d.where(F.col("doc_id") % 6 == part).select(F.col("doc_id").cast("string").alias("id" if part else "file_id")), home)
    done = manifests.completed_ids(spark, home).select(F.col("id").cast("long").alias("doc_id"))
    return pairing.pending(d, done, "doc_id")


@query("SELECT CAST(source AS VARCHAR) AS source, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT lang) AS VARCHAR) AS langs FROM documents GROUP BY 1")
def report_round_trip(spark, sf_dir):
    """K5 K6: a report without its arrays as JSON and as tab-separated text, joined again."""
    r = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.collect_set("lang").alias("all_langs"), F.count_distinct("lang").alias("langs"))
    home = manifests.scratch(spark, "report")
    manifests.write_results(r, f"{home}/json")
    manifests.write_report(r.select("source", "n"), f"{home}/tsv", "\t")
    tsv = spark.read.option("header", True).option("sep", "\t").csv(f"{home}/tsv")
    return tsv.join(spark.read.json(f"{home}/json").drop("n"), "source").select("source", "n", F.col("langs").cast("string").alias("langs"))


@query("""WITH r AS (SELECT dayofyear(ts) AS step, avg(value) AS loss, max(value) AS grad FROM events GROUP BY 1)
  SELECT CAST(step AS BIGINT) AS step, 'loss' AS metric, round(loss, 9) AS value FROM r UNION ALL SELECT step, 'grad_norm', round(grad, 9) FROM r""")
def history_round_trip(spark, sf_dir):
    """A run's state with its metric history; a later entry of a step wins."""
    r = read(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("step")).agg(F.avg("value").alias("loss"), F.max("value").alias("grad_norm"))
    log = r.agg(F.sort_array(F.collect_list(F.struct("step", F.lit(None).cast("double").alias("grad_norm"), F.lit(-1.0).alias("loss")))).alias("old"), F.sort_array(F.collect_list(F.struct("step", "grad_norm", "loss"))).alias("new"))  # a row per step of a run
    home = manifests.scratch(spark, "state")
    log.select(F.concat("old", "new").alias("log_history")).coalesce(1).write.json(home)
    got = manifests.read_history(spark, home)
    return got.select("step", "metric", F.round("value", 9).alias("value"))


@query("SELECT replace(replace('a/' || doc_id || '.wav', '/', '_'), '.', '_') AS id, CASE WHEN doc_id % 9 = 0 THEN 'no text' END AS error, CASE WHEN doc_id % 9 > 0 THEN md5(text) END AS digest, lang AS language, '{\"translation_en\":\"' || source || '\"}' AS custom FROM documents")
def converted_records(spark, sf_dir):
    """A tabular corpus as records by its recipe; rows without text carry an error."""
    d = read(spark, sf_dir, "documents")
    rows = d.select(F.format_string("a/%d.wav", "doc_id").alias("id"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("text"), F.concat("lang", F.lit("_x")).alias("lang"), (F.col("n_chars") / 15).alias("duration"), F.col("source").alias("translation_en"))
    got = conversion.to_records(rows, conversion.RECIPES["yodas"])
    return got.select("id", "error", F.md5(F.get("supervisions", 0)["text"]).alias("digest"), F.get("supervisions", 0)["language"].alias("language"), "custom")
