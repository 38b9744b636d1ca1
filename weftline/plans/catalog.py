"""Registered queries over the operators, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import arithmetic, languages, numbers, text
from weftline.operators import batches, cache, checks, datasets, logs, measure, pairing, prompts, records, schedule, scoring

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

WORDS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"
CUTS = f"""cuts AS (SELECT d.doc_id AS id, round(CAST(d.n_chars AS DOUBLE) / 15, 2) AS duration, d.text, d.lang, d.source AS corpus,
  CASE WHEN d.doc_id % 4 = 0 THEN 'st' ELSE 'asr' END AS task, CASE WHEN d.lang = 'en' THEN 'de' ELSE 'en' END AS tgt_lang,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST({WORDS} AS BIGINT) END AS num_tokens, CAST(l.quality AS DOUBLE) * 100 AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
FOLD = "CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in languages.LOCALES.items()) + " ELSE {0} END"
BASIC = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g')), '\s+', ' ', 'g'))"


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weftline.plans import reports  # registers its own

    return dict(reports.registered())


def oracles() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# measurement


@query(f"""WITH {CUTS} SELECT corpus, lang, task, count(*) AS num_cuts, round(coalesce(sum(duration), 0), 6) AS total_seconds,
  round(coalesce(avg(duration), 0), 6) AS mean_seconds, round(coalesce(median(duration), 0), 6) AS median_seconds,
  round(coalesce(stddev_samp(duration), 0), 6) AS stdev_seconds, CAST(grouping_id(corpus, lang, task) AS BIGINT) AS level
  FROM cuts WHERE duration BETWEEN 0.5 AND 2000 GROUP BY GROUPING SETS ((corpus, lang, task), (lang), (corpus), ())""")
def corpus_stats_rollup(spark, sf_dir):
    """Statistics of each set, language, corpus and all."""
    df = records.within_duration(records.durations(spark, sf_dir), 0.5, 2000)
    return measure.statistics(df, [["corpus", "lang", "task"], ["lang"], ["corpus"], []], ["corpus", "lang", "task"])


@query(f"WITH {CUTS} SELECT corpus, count(*) AS num_cuts, round(sum(duration) / 3600, 6) AS hours FROM cuts WHERE duration >= 1 AND duration <= 1000 GROUP BY 1")
def source_hours(spark, sf_dir):
    """A1 A2 P1."""
    df = records.within_duration(records.durations(spark, sf_dir), 1, 1000)
    return df.groupBy("corpus").agg(F.count("*").alias("num_cuts"), F.round(measure.hours(F.col("duration")), 6).alias("hours"))


@query(f"""WITH {CUTS} SELECT lang, count(*) AS num_cuts, CAST(sum({WORDS}) AS BIGINT) AS total_words,
  count(nullif({WORDS}, 0)) AS cuts_with_text, round(CAST(median(nullif({WORDS}, 0)) AS DOUBLE), 6) AS median_words FROM cuts GROUP BY 1""")
def word_count_stats(spark, sf_dir):
    """A6 A7 X9."""
    docs = read(spark, sf_dir, "documents").select("lang", "text")
    return measure.word_statistics(docs, ["lang"])


@query(f"WITH {CUTS} SELECT corpus, CAST(round_even(duration / 0.01, 0) AS BIGINT) AS key, count(*) AS n FROM cuts GROUP BY ALL")
def duration_histogram(spark, sf_dir):
    """A11."""
    return measure.histogram(records.durations(spark, sf_dir), F.col("duration"), ["corpus"])


@query(f"""WITH {CUTS}, h AS (SELECT lang, CAST(round_even(duration / 0.01, 0) AS BIGINT) AS key, count(*) AS n FROM cuts GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY key) AS cum, sum(n) OVER (PARTITION BY lang) AS total FROM h)
  SELECT lang, round(min(key) FILTER (cum >= 0.99 * total) * 0.01::DOUBLE, 6) AS at_share, round(max(key) * 0.01::DOUBLE, 6) AS longest FROM c GROUP BY 1""")
def histogram_p99(spark, sf_dir):
    """A12 A16 W5."""
    hist = measure.histogram(records.durations(spark, sf_dir), F.col("duration"), ["corpus", "lang"])
    return measure.percentile(measure.merged(hist, ["lang"]), 0.99, ["lang"])


@query("""WITH s AS (SELECT l_returnflag AS corpus, l_orderkey % 20 AS shard, sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY shard) AS place FROM s)
  SELECT corpus, round(sum(seconds) FILTER (place <= 4) / 3600 * count(*) / count(*) FILTER (place <= 4), 6) AS hours, count(*) AS shards FROM r GROUP BY 1""")
def sampled_hours_extrapolation(spark, sf_dir):
    """A3."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("corpus"), (F.col("l_orderkey") % 20).alias("shard"), "l_quantity")
    return measure.extrapolated_hours(li, ["corpus"], "shard", "l_quantity", 4)


@query(f"""WITH {CUTS}, s AS (SELECT CASE WHEN task = 'st' THEN lang || '-' || tgt_lang ELSE lang END AS lang_key, corpus AS source, sum(duration) / 3600 AS hours FROM cuts GROUP BY ALL),
  a AS (SELECT *, sum(hours) OVER (PARTITION BY lang_key) AS n_l, sum(hours) OVER () AS n_all FROM s),
  b AS (SELECT *, pow(hours / n_l, 0.5) AS w_c FROM a), l AS (SELECT lang_key, pow(sum(hours) / any_value(n_all), 0.5) AS w_l FROM a GROUP BY 1),
  p AS (SELECT lang_key, w_l / sum(w_l) OVER () AS p_l FROM l), c AS (SELECT *, w_c / sum(w_c) OVER (PARTITION BY lang_key) AS p_c FROM b)
  SELECT lang_key, source, round(hours, 6) AS hours, round(p_c, 9) AS p_c, round(p_l, 9) AS p_l, round(p_c * p_l, 9) AS p_cl,
  round(hours / n_all, 9) AS share, round(p_c * p_l / (hours / n_all), 6) AS boost FROM c JOIN p USING (lang_key)""")
def mixture_weights(spark, sf_dir):
    """Two-tier weights with report columns."""
    key = languages.language_key(F.col("task"), F.col("lang"), F.col("lang"), F.col("tgt_lang"))
    sources = records.durations(spark, sf_dir).groupBy(key.alias("lang_key"), F.col("corpus").alias("source")).agg((F.sum("duration") / 3600).alias("hours"))
    return measure.two_tier_weights(sources, 0.5, 0.5)


@query(f"""WITH {CUTS}, h AS (SELECT corpus, sum(duration) / 3600 AS hours FROM cuts WHERE lang = 'en' GROUP BY 1),
  r AS (SELECT corpus, sum(duration) AS s FROM cuts WHERE lang = 'de' GROUP BY 1), sh AS (SELECT corpus, s / (SELECT sum(s) FROM r) AS share FROM r),
  j AS (SELECT sh.corpus, share, coalesce(hours, 0) AS hours FROM sh LEFT JOIN h USING (corpus)), c AS (SELECT min(hours / share) FILTER (share > 0) AS ceiling FROM j)
  SELECT corpus, round(ceiling, 6) AS ceiling, round(ceiling * share, 6) AS need, round(hours, 6) AS have FROM j, c""")
def matched_design(spark, sf_dir):
    """Shares of a reference language, and the largest total that another can match."""
    d = records.durations(spark, sf_dir)
    have = d.where("lang = 'en'").groupBy("corpus").agg((F.sum("duration") / 3600).alias("hours"))
    ref = d.where("lang = 'de'").groupBy("corpus").agg(F.sum("duration").alias("s"))
    shares = ref.crossJoin(F.broadcast(ref.agg(F.sum("s").alias("t")))).select("corpus", (F.col("s") / F.col("t")).alias("share"))  # one row
    return measure.matched_ceiling(have, shares)


@query(f"""WITH {CUTS}, g AS (SELECT task, lang, sum(duration) / 3600 AS hours FROM cuts GROUP BY ALL)
  SELECT task, lang, round(CASE WHEN task = 'asr' THEN 5.0 ELSE least(5.0, hours) END, 6) AS used FROM g""")
def group_budget(spark, sf_dir):
    """A20."""
    g = records.durations(spark, sf_dir).groupBy("task", "lang").agg((F.sum("duration") / 3600).alias("hours"))
    return measure.budgeted(g, 5.0).select("task", "lang", F.round("used", 6).alias("used"))


@query(f"""WITH {CUTS}, k AS (SELECT task || '/' || CASE WHEN task = 'st' THEN lang || '-' || tgt_lang ELSE lang END AS key, duration FROM cuts)
  SELECT coalesce(key, 'total') AS key, round(sum(duration) / 3600, 6) AS hours FROM k GROUP BY ROLLUP (key)""")
def hours_seen(spark, sf_dir):
    """A22 P18 R2 (batch form)."""
    none, st = F.lit(None).cast("string"), F.col("task") == "st"
    key = languages.tracker_key(F.col("task"), F.col("lang"), F.when(st, F.col("lang")).otherwise(none), F.when(st, F.col("tgt_lang")).otherwise(none))
    return measure.seen_hours(records.durations(spark, sf_dir), key)


@query(f"""WITH {CUTS} SELECT lang, min(score) AS low, max(score) AS high, count(score) AS scores, count(*) - count(score) AS missing,
  CASE WHEN max(score) <= 1 THEN 1.0 WHEN max(score) <= 100 THEN 100.0 ELSE max(score) END AS factor FROM cuts GROUP BY 1""")
def score_ranges(spark, sf_dir):
    """A23 P12."""
    return measure.score_ranges(records.records(spark, sf_dir), ["lang"])


@query(f"""WITH {CUTS}, f AS (SELECT corpus, task, CASE WHEN id % 3 = 0 THEN 'custom.pnc' ELSE 'text' END AS text_field FROM cuts),
  n AS (SELECT corpus, task, text_field, count(*) AS n FROM f GROUP BY ALL)
  SELECT corpus, task, arg_min(text_field, (-n, text_field)) AS majority, max(n) AS agree, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - max(n) AS BIGINT) AS outliers FROM n GROUP BY ALL""")
def majority_field(spark, sf_dir):
    """A29."""
    d = records.durations(spark, sf_dir).withColumn("text_field", F.when(F.col("id") % 3 == 0, "custom.pnc").otherwise("text"))
    return measure.majority(d, ["corpus", "task"], "text_field")


@query("""WITH s AS (SELECT l_shipmode AS source, count(DISTINCT l_orderkey % 64) AS shards FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_orderkey FROM lineitem) GROUP BY 1)
  SELECT source, shards, round(CAST(shards AS DOUBLE) / 64, 6) AS per_partition, CASE WHEN shards / 64.0 < 0.5 THEN 'very low' WHEN shards / 64.0 < 1 THEN 'low' ELSE 'ok' END AS verdict FROM s""")
def shard_coverage(spark, sf_dir):
    """Shards per partition and the risk."""
    li = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("source"), (F.col("l_orderkey") % 64).alias("shard"))
    return measure.coverage_risk(li.groupBy("source").agg(F.count_distinct("shard").alias("shards")), 64)


@query(f"""WITH {CUTS} SELECT CASE WHEN contains(lang, '-') THEN split_part(lang, '-', 1) ELSE split_part(lang, '_', 1) END AS base,
  string_agg(DISTINCT lang || '_' || upper(lang), ',' ORDER BY lang || '_' || upper(lang)) AS codes FROM cuts GROUP BY 1""")
def folding_report(spark, sf_dir):
    """A32 P15 P19."""
    d = read(spark, sf_dir, "documents").select("lang")
    return d.groupBy(languages.base_language(F.col("lang")).alias("base")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("lang", F.lit("_"), F.upper("lang")))), ",").alias("codes"))


# filters, tags, text


@query(f"""WITH {CUTS} SELECT id, duration, num_tokens FROM cuts WHERE duration >= 1 AND duration <= 1500
  AND (num_tokens IS NULL OR (num_tokens <= 800 AND NOT (duration > 0 AND num_tokens / duration > 3)))""")
def duration_token_filter_train(spark, sf_dir):
    """P1 P2."""
    df = records.within_duration(records.records(spark, sf_dir).select("id", "duration", "num_tokens"), 1, 1500)
    return records.train_token_filter(df, 800, 3.0)


@query(f"WITH {CUTS} SELECT id, duration, num_tokens FROM cuts WHERE coalesce(num_tokens, 0) <= 800 AND coalesce(num_tokens, 0) / greatest(duration, 1e-6) <= 3")
def duration_token_filter_eval(spark, sf_dir):
    """P2e."""
    return records.eval_token_filter(records.records(spark, sf_dir).select("id", "duration", "num_tokens"), 800, 3.0)


@query(f"WITH {CUTS} SELECT corpus, count(*) - count(num_tokens) AS missing FROM cuts GROUP BY 1")
def missing_tokens(spark, sf_dir):
    """P3."""
    return records.records(spark, sf_dir).groupBy("corpus").agg(F.count_if(F.col("num_tokens").isNull()).alias("missing"))


def strip_sql(text: str) -> str:
    return rf"nullif(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '')"


K, MISSING, TYPE = strip_sql("json_extract_string(props, '$.k')"), strip_sql("json_extract_string(props, '$.missing')"), strip_sql("event_type")


@query(f"""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN {K} ELSE {TYPE} END AS resolved,
  {MISSING} AS strict_missing, CASE WHEN json_extract_string(props, '$.missing') IS NOT NULL THEN {MISSING} ELSE {TYPE} END AS fallback FROM events""")
def text_resolution(spark, sf_dir):
    """P7 P21 RULE1: a field by path, strict and with a fallback."""
    e = read(spark, sf_dir, "events").select("event_id", "props", "event_type")
    r = lambda path, strict=False: records.resolved_text(F.col("props"), path, F.col("event_type"), strict)
    return e.select("event_id", r("k").alias("resolved"), r("missing", True).alias("strict_missing"), r("missing").alias("fallback"))


@query(f"SELECT count(*) AS violations FROM events WHERE event_type = 'click' AND {MISSING} IS NULL")
def strict_violations(spark, sf_dir):
    """P8."""
    e = read(spark, sf_dir, "events").where("event_type = 'click'")
    return records.strict_violations(e, F.col("props"), "missing", F.col("event_type")).agg(F.count("*").alias("violations"))


@query(f"""WITH {CUTS} SELECT id, CASE WHEN task = 'st' THEN {FOLD.format('lang')} || '-' || {FOLD.format('tgt_lang')} ELSE {FOLD.format('lang')} END AS lang_key,
  task || '/' || CASE WHEN task = 'st' THEN lang || '-' || tgt_lang ELSE lang END AS tracker, CASE WHEN task = 'st' THEN tgt_lang ELSE lang END AS spoken,
  lower(replace(CASE WHEN task = 'st' THEN 'st_' || lang || '_' || tgt_lang ELSE 'asr_' || lang END, '-', '_')) AS set_name,
  CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM cuts""")
def tags_and_lang_key(spark, sf_dir):
    """P4 P9 P13 P14 P16 P18 X12."""
    d = records.durations(spark, sf_dir)
    task, lang, tgt = F.col("task"), F.col("lang"), F.col("tgt_lang")
    st = task == "st"
    tags = records.merged_tags(F.create_map(F.lit("lang"), F.lit("")), F.create_map(F.lit("tgt_lang"), tgt, F.lit("lang"), lang))
    none = F.lit(None).cast("string")
    return d.withColumn("tags", tags).select(
        "id",
        languages.language_key(task, lang, lang, tgt).alias("lang_key"),
        languages.tracker_key(task, lang, F.when(st, lang).otherwise(none), F.when(st, tgt).otherwise(none)).alias("tracker"),
        records.spoken_language(F.col("tags"), lang, task).alias("spoken"),
        text.set_name(task, lang, lang, tgt).alias("set_name"),
        languages.language_name(lang).alias("name"),
    )


@query(f"""WITH {CUTS}, h AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || id), id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM cuts)
  SELECT id, lang, CASE WHEN p <= round(n * 0.9) THEN 'train' ELSE 'validation' END AS split FROM h""")
def stratified_split(spark, sf_dir):
    """Exact shares of each stratum without ordering a whole stratum in one task."""
    return records.stratified_split(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "lang", 0.9)


@query("SELECT doc_id AS id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def subsample(spark, sf_dir):
    """P5 P5e."""
    return records.subsample(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), 100)


@query(f"WITH {CUTS} (SELECT id, duration, 'longest' AS side FROM cuts ORDER BY duration DESC, id LIMIT 20) UNION ALL (SELECT id, duration, 'shortest' FROM cuts ORDER BY duration, id LIMIT 20)")
def extremes(spark, sf_dir):
    """O1 O2 A10 B18."""
    d = records.durations(spark, sf_dir).select("id", "duration")
    return records.longest(d, 20).withColumn("side", F.lit("longest")).unionByName(records.shortest(d, 20).withColumn("side", F.lit("shortest")))


@query(f"WITH {CUTS} SELECT id, round(duration + coalesce(num_tokens, 0), 6) AS cost FROM cuts ORDER BY cost DESC, id")
def eval_order(spark, sf_dir):
    """O3: the whole set, longest first."""
    return records.evaluation_order(records.records(spark, sf_dir)).select("id", F.round(F.col("duration") + F.coalesce("num_tokens", F.lit(0)), 6).alias("cost"))


@query("SELECT o_orderpriority AS name, min(o_orderkey) AS first, count(*) AS sources FROM orders GROUP BY 1")
def named_sets(spark, sf_dir):
    """A30."""
    return records.named_sets(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("pos")))


@query(f"SELECT doc_id, md5({BASIC.format('text')}) AS digest FROM documents")
def basic_normalizer(spark, sf_dir):
    """X1."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.basic_normalised(F.col("text"), nfkc=True)).alias("digest"))


@query()
def diacritics_normalizer(spark, sf_dir):
    """X2 X3."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.without_diacritics(F.col("text"))).alias("plain"), F.length(text.spaced_letters(F.col("text"))).alias("clusters"))


@query()
def english_normalizer(spark, sf_dir):
    """X4 X5."""
    d = read(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", text.english_normalised(F.col("text")).alias("normalised"))


@query(r"""SELECT doc_id, regexp_replace(lang || '_train_' || source || '/' || doc_id, '[/. ]', '_', 'g') AS cut_id, substr(regexp_replace(source || ' ' || lang, '[^A-Za-z0-9._-]', '_', 'g'), 1, 60) AS slug,
  substr(md5(source), 1, 8) AS run FROM documents""")
def identifiers(spark, sf_dir):
    """X13 P24 I1."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.select(
        "doc_id",
        text.identifier(F.col("lang"), F.lit("train"), F.concat_ws("/", "source", "doc_id")).alias("cut_id"),
        text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"),
        text.run_id(F.col("source")).alias("run"),
    )


# scoring


def _pairs(spark, sf_dir):
    """Sentences against themselves with every seventh word lost and 'e' misread."""
    few = read(spark, sf_dir, "conversations").repartition(spark.sparkContext.defaultParallelism)  # a small file, much work per row
    c = few.select("conv_id", "turn", "role", text.basic_normalised(F.col("text")).alias("reference"))
    words = F.filter(F.split("reference", " "), lambda w, i: i % 7 != 6)
    return c.withColumn("prediction", F.when(F.col("turn") % 2 == 0, F.array_join(words, " ")).otherwise(F.replace("reference", F.lit("e"), F.lit("a"))))


@query()
def wer_by_role(spark, sf_dir):
    """X7 X8 A21 RULE4: corpus-level rates by bucket."""
    return scoring.error_rates(scoring.edits(_pairs(spark, sf_dir), normalise=False), ["role"])


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS char_edits, length(a.p_name) AS ref_chars FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey WHERE length(a.p_name) = strlen(a.p_name)")
def char_edits(spark, sf_dir):
    """X8."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    j = p.join(q, "p_partkey")
    return j.select("p_partkey", text.char_edits(F.col("p_name"), F.col("other")).cast("long").alias("char_edits"), F.length("p_name").cast("long").alias("ref_chars"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)
  SELECT vec_id, round(list_max(list_transform(list_zip(x, y), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 5) AS max_abs,
  round(list_sum(list_transform(list_zip(x, y), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(x), 5) AS mean_abs,
  round(list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])), 5) AS cosine FROM p""")
def vector_compare(spark, sf_dir):
    """A36."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(f, "vec_id").select("vec_id", *[F.round(c, 5).alias(k) for k, c in scoring.vector_difference(F.col("x"), F.col("y")).items()])


@query("""WITH e AS (SELECT vec_id, list_transform(list_sort(list_zip(list_transform(embedding, lambda v: -v), range(len(embedding))))[1:10], lambda z: z[2]) AS best FROM embeddings)
  SELECT a.vec_id, CAST(len(list_intersect(a.best, b.best)) AS INT) AS shared FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id""")
def top_overlap(spark, sf_dir):
    """Greatest places that neighbouring vectors share."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(f, "vec_id").select("vec_id", scoring.top_overlap(F.col("embedding"), F.col("y")).alias("shared"))


# buckets, batches, mixtures


def _bins(spark, sf_dir, k):
    return batches.bucket_boundaries(records.durations(spark, sf_dir), k)


BINS = f"""RECURSIVE {CUTS}, o AS (SELECT CAST(round_even(duration / 0.01, 0) AS BIGINT) * 0.01::DOUBLE AS d, row_number() OVER (ORDER BY duration, id) AS p FROM cuts),
  t AS (SELECT sum(d) / 10 AS share FROM o), w AS (SELECT 0::BIGINT AS p, 0::DOUBLE AS run, NULL::DOUBLE AS bound
  UNION ALL SELECT o.p, CASE WHEN w.run > share THEN o.d ELSE w.run + o.d END, CASE WHEN w.run > share THEN o.d END FROM w JOIN o ON o.p = w.p + 1, t)"""


@query(f"WITH {BINS} SELECT CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS place, round(bound, 6) AS bound FROM w WHERE bound IS NOT NULL")
def bucket_bins(spark, sf_dir):
    """From the duration histogram."""
    bounds = _bins(spark, sf_dir, 10)
    return spark.createDataFrame([(i + 1, round(b, 6)) for i, b in enumerate(bounds)], "place long, bound double")


@query(f"WITH {BINS}, b AS (SELECT round(bound, 6) AS bound FROM w WHERE bound IS NOT NULL) SELECT id, (SELECT count(*) FROM b WHERE b.bound <= cuts.duration) AS bucket FROM cuts")
def bucket_assign(spark, sf_dir):
    """B2."""
    bounds = [round(b, 6) for b in _bins(spark, sf_dir, 10)]
    return records.durations(spark, sf_dir).select("id", batches.bucket_of(F.col("duration"), bounds).cast("long").alias("bucket"))


@query(f"""WITH RECURSIVE {CUTS}, o AS (SELECT corpus, id % 8 AS block, id, duration, row_number() OVER (PARTITION BY corpus, id % 8 ORDER BY id) AS p FROM cuts),
  w AS (SELECT corpus, block, id, p, duration AS run, 0::BIGINT AS batch FROM o WHERE p = 1
  UNION ALL SELECT o.corpus, o.block, o.id, o.p, CASE WHEN w.run + o.duration > 600 THEN o.duration ELSE w.run + o.duration END,
  CASE WHEN w.run + o.duration > 600 THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.corpus = w.corpus AND o.block = w.block AND o.p = w.p + 1) SELECT corpus, id, block, batch FROM w""")
def duration_batches(spark, sf_dir):
    """Greedy batches in each corpus and block of ids."""
    d = records.durations(spark, sf_dir).select("corpus", "id", "duration")
    got = batches.duration_batches(d, ["corpus"], 600.0, block=F.col("id") % 8)
    return got.select("corpus", "id", F.col("batch_block").cast("long").alias("block"), "batch")


@query("""WITH u AS (SELECT CAST('0x' || substr(md5('42:' || id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(20000) t(id)),
  d AS (SELECT CASE WHEN u < 0.125 THEN 'a' WHEN u < 0.5 THEN 'b' ELSE 'c' END AS source FROM u) SELECT source, count(*) AS n, round(count(*) / 20000, 6) AS share FROM d GROUP BY 1""")
def mixture_draw_shares(spark, sf_dir):
    """20,000 draws, one share per source."""
    drawn = batches.draw(spark.range(20_000), [("a", 0.125), ("b", 0.375), ("c", 0.5)])
    return drawn.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count("*") / 20_000, 6).alias("share"))


@query("SELECT user_id % 4 AS rank, event_id % 2 AS worker, (event_id % 8) AS part, count(*) AS n FROM events GROUP BY ALL")
def partition_assign(spark, sf_dir):
    """B9 P23."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rank"), (F.col("event_id") % 2).alias("worker"), batches.partition_of(F.col("event_id"), 4, 2).alias("part"))
    return e.groupBy("rank", "worker", "part").agg(F.count("*").alias("n"))


@query(f"""WITH {CUTS}, s AS (SELECT lang, count(*) AS cuts, sum(duration) AS seconds FROM cuts GROUP BY 1)
  SELECT lang, CAST(ceil(ceil(ceil(seconds / 200) / 4) / 8) AS BIGINT) AS by_duration, CAST(ceil(ceil(ceil(cuts / 16) / 4) / 8) AS BIGINT) AS by_size, CAST(-1 AS BIGINT) AS unknown FROM s""")
def steps_per_epoch(spark, sf_dir):
    """B12 B13."""
    s = records.durations(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("cuts"), F.sum("duration").alias("seconds"))
    step = lambda **kw: arithmetic.steps_per_epoch(F.col("cuts"), F.col("seconds"), world=4, accumulate=8, **kw)
    return s.select("lang", step(batch_duration=200.0).alias("by_duration"), step(batch_size=16).alias("by_size"), step().alias("unknown"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor((floor((l_quantity * 100 + 2 - 3) / 2 + 1) + 2 - 3) / 2 + 1) AS BIGINT) AS frames,
  CAST(ceil(l_quantity * 100 / 25) * 4 AS BIGINT) AS queries, CAST(ceil(l_quantity / 30) AS BIGINT) AS windows, CAST(least(16, greatest(1, floor(200 / l_quantity))) AS BIGINT) AS batch FROM lineitem WHERE l_quantity > 0""")
def shape_arithmetic(spark, sf_dir):
    """M1 M3 M4 M6."""
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 0")
    q = F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        arithmetic.conv_length(q * 100, 2, 3, 2).alias("frames"), arithmetic.query_length(q * 100, 25, 4).alias("queries"),
        arithmetic.window_count(q, 30.0).alias("windows"), arithmetic.largest_batch(q, 200.0, 16).alias("batch"),
    )


# logs


def _stream(spark, sf_dir):
    return read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rank"), (F.col("event_id") % 2).alias("worker"), "event_id", "event_type", "user_id", "value", "ts")


@query("""WITH s AS (SELECT user_id % 4 AS rank, event_id % 2 AS worker, event_type, user_id FROM events)
  SELECT rank, worker, event_type, count(*) AS emitted, count(DISTINCT user_id) AS distinct_ids FROM s GROUP BY ALL""")
def stream_composition(spark, sf_dir):
    """A24 A26."""
    return logs.composition(_stream(spark, sf_dir), ["rank", "worker"], "event_type", "user_id")


@query("""WITH s AS (SELECT DISTINCT user_id % 4 AS rank, event_id % 2 AS worker, event_type FROM events)
  SELECT event_type, count(*) AS streams, round(100.0::DOUBLE * count(*) / 8, 6) AS share_percent FROM s GROUP BY 1""")
def source_reach(spark, sf_dir):
    """A25."""
    return logs.reach(_stream(spark, sf_dir), ["rank", "worker"], "event_type", 8)


@query("""WITH s AS (SELECT DISTINCT event_id % 5 AS stream, user_id FROM events)
  SELECT x.stream AS a, y.stream AS b, count(*) AS shared FROM s x JOIN s y ON x.user_id = y.user_id AND x.stream < y.stream GROUP BY ALL""")
def partition_overlap(spark, sf_dir):
    """Ids that pairs of streams share."""
    return logs.overlaps(read(spark, sf_dir, "events"), F.col("event_id") % 5, "user_id")


@query("""WITH a AS (SELECT user_id % 4 AS rank, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS pos, event_type AS v FROM events),
  f AS (SELECT rank, pos - 100 AS pos, v FROM a WHERE pos >= 100), s AS (SELECT user_id % 4 AS rank, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS pos, event_type AS v FROM events WHERE event_id % 11 <> 0)
  SELECT rank, count(*) AS compared, count(*) FILTER (f.v IS NOT DISTINCT FROM s.v) AS equal, min(pos) FILTER (f.v IS DISTINCT FROM s.v) AS first_difference FROM f JOIN s USING (rank, pos) GROUP BY 1""")
def stream_prefix_compare(spark, sf_dir):
    """W3 J3 W6."""
    e = _stream(spark, sf_dir)
    first = logs.positions(e, ["rank"], "event_id")
    second = logs.positions(e.where("event_id % 11 <> 0"), ["rank"], "event_id")
    return logs.prefix_compare(first, second, 100, ["rank"], "event_type")


@query("""WITH r AS (SELECT CAST(dayofyear(ts) AS INT) AS step, event_type AS metric, event_id % 2 AS run, avg(value) AS value FROM events GROUP BY ALL),
  j AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.metric, b.metric) AS metric, a.value AS x, b.value AS y FROM (SELECT * FROM r WHERE run = 0) a FULL JOIN (SELECT * FROM r WHERE run = 1) b USING (step, metric))
  SELECT metric, round(max(abs(x - y)), 9) AS max_abs, count(*) - count(x) AS missing_first, count(*) - count(y) AS missing_second, min(step) FILTER (x <> y) AS first_step FROM j GROUP BY 1""")
def metric_divergence(spark, sf_dir):
    """A27 J5 S13."""
    r = read(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("step"), F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("run")).agg(F.avg("value").alias("value"))
    return logs.divergence(r.where("run = 0"), r.where("run = 1"))


@query("""WITH b AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL ELSE event_id END AS good FROM events)
  SELECT user_id, event_id, last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS good FROM b""")
def last_good_batch(spark, sf_dir):
    """B15 R6."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when((F.col("event_type") != "error") & (F.col("event_id") % 7 != 0), F.col("event_id")).alias("good"))
    return logs.last_good(e, "good", ["user_id"], "event_id")


@query("SELECT user_id % 4 AS rank, event_id % 2 AS worker, user_id AS batch_idx, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_record_per_batch(spark, sf_dir):
    """W2."""
    e = _stream(spark, sf_dir).withColumnRenamed("user_id", "batch_idx")
    return logs.first_per_batch(e, "event_id").select("rank", "worker", "batch_idx", "event_id")


# joins


@query("SELECT o_orderkey AS key, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def pairing_join(spark, sf_dir):
    """Pairs by key."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("key"), "o_custkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(c, "o_custkey").select("key", "o_custkey", "c_name")


@query("""WITH a AS (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY 1), b AS (SELECT doc_id, arg_min(quality, (quality, toxic)) AS quality, arg_min(toxic, (quality, toxic)) AS toxic FROM labels GROUP BY 1)
  SELECT doc_id, lang, quality, toxic FROM a JOIN b USING (doc_id)""")
def one_to_one_pairs(spark, sf_dir):
    """One-to-one pairing, repeated keys count once."""
    return pairing.paired(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only
  FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def unpaired_keys(spark, sf_dir):
    """J1 leftovers, U6."""
    return pairing.unpaired(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT e.event_id, s.source FROM events e LEFT JOIN (SELECT o_orderkey AS cut_id, min(o_orderpriority) AS source FROM orders GROUP BY 1) s ON e.user_id = s.cut_id")
def first_source_lookup(spark, sf_dir):
    """J2."""
    ids = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("cut_id"))
    manifest = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cut_id"), F.col("o_orderpriority").alias("source"))
    return pairing.first_source(ids, manifest).select("event_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def completed_anti(spark, sf_dir):
    """J8 S16 R5."""
    return pairing.pending(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def overlap_semi(spark, sf_dir):
    """J6 J9."""
    return pairing.overlapping(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT (SELECT count(*) FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 3 <> 0)) AS left_more,
  (SELECT count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT lang, source FROM documents)) AS right_more""")
def multiset_equality(spark, sf_dir):
    """J7 U3 U4."""
    a = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return pairing.same_rows(a.drop("doc_id"), a.where("doc_id % 3 <> 0").drop("doc_id"))


@query("""SELECT n_name AS path, h.hours, CASE WHEN h.hours IS NULL THEN 'SKIP' ELSE 'OK' END AS status FROM nation LEFT JOIN
  (SELECT n_name AS path, round(sum(c_acctbal), 2) AS hours FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 > 0 GROUP BY 1) h ON n_name = h.path""")
def cached_measurements(spark, sf_dir):
    """J10 A40 A13."""
    nation = read(spark, sf_dir, "nation")
    cache = read(spark, sf_dir, "customer").join(F.broadcast(nation.where("n_nationkey % 3 > 0")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    cache = cache.groupBy(F.col("n_name").alias("path")).agg(F.round(F.sum("c_acctbal"), 2).alias("hours"))
    return pairing.with_measurements(nation.select(F.col("n_name").alias("path")), cache)


@query("SELECT doc_id AS id, lang FROM documents UNION ALL SELECT page_id, CAST(NULL AS VARCHAR) FROM pages")
def source_union(spark, sf_dir):
    """Every record of several sources once, missing columns null."""
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), allowMissingColumns=True)


@query("SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """U5."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))


@query("SELECT DISTINCT lang AS tgt_lang FROM documents WHERE lang IS NOT NULL AND lang <> ''")
def target_languages(spark, sf_dir):
    """S7."""
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("tgt_lang")).where("tgt_lang is not null and tgt_lang <> ''").distinct()


# prompts


@query("SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations")
def chat_render(spark, sf_dir):
    """C5."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.chat(F.col("role"), F.col("text")).alias("rendered"))


def _template_sql() -> str:
    offered = [t for t in prompts.TEMPLATES["asr"] if "{lang}" in t]
    listed = ", ".join("'" + t + "'" for t in offered)
    return f"""SELECT doc_id, replace(replace(([{listed}])[1 + CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) % {len(offered)}], '{{audio_token}}', '<audio>'), '{{lang}}', lang) AS prompt FROM documents"""


@query(_template_sql())
def prompt_render(spark, sf_dir):
    """C1 C2 C3 C4."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.select("doc_id", prompts.rendered(prompts.chosen_template("asr", F.col("doc_id"), "with_language"), {"audio_token": F.lit("<audio>"), "lang": F.col("lang")}).alias("prompt"))


@query("""WITH c AS (SELECT conv_id, turn, range(10, turn % 5 + 11) AS body FROM conversations)
  SELECT conv_id, turn, '[-100,1,2,' || array_to_string(body, ',') || ',4,-100]' AS labels,
  '[-100,1,2,' || array_to_string(body, ',') || ',4,-100' || repeat(',-100', 7 - len(body)::INT) || ']' AS padded FROM c""")
def label_mask(spark, sf_dir):
    """Spans kept, special ids masked, padded."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.array(F.lit(9), F.lit(1), F.lit(2)), F.transform(F.sequence(F.lit(10), (F.col("turn") % 5 + 10).cast("int")), lambda x: x), F.array(F.lit(4), F.lit(9))).alias("ids"))
    kept = prompts.keep_spans(F.col("ids"), [1, 2], [4])
    return c.select("conv_id", "turn", F.to_json(kept).alias("labels"), F.to_json(prompts.padded(prompts.mask_ids(F.col("ids"), [9]), F.lit(12), -100)).alias("padded"))


@query("SELECT conv_id, turn, len(string_split(text, 'the')) - 1 AS placeholders, replace(text, 'the', 'thethe') AS expanded, replace(text, 'the', '[the]') AS surrounded FROM conversations")
def placeholders(spark, sf_dir):
    """C10 C11."""
    t = F.col("text")
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompts.placeholder_count(t, "the").cast("long").alias("placeholders"), prompts.expanded(t, "the", F.lit(2)).alias("expanded"), prompts.surrounded(t, "the", "[", "]").alias("surrounded")
    )


# quality checks


@query("""WITH leaves AS (SELECT source, lang, doc_id FROM documents),
  t3 AS (SELECT DISTINCT source, lang || '_xx' AS lang FROM leaves),
  w1 AS (SELECT source AS level, count(CASE WHEN doc_id % 2 = 0 THEN 1 END) AS w, count(*) AS n FROM leaves GROUP BY 1),
  w4 AS (SELECT source AS level, count(DISTINCT lang) AS k FROM leaves GROUP BY 1)
  SELECT 'T3' AS "check", 'WARN' AS severity, source AS place, lang AS message FROM t3
  UNION ALL SELECT 'W1', 'FAIL', level, w || ' of ' || n || ' weighted' FROM w1 WHERE n > 1 AND w > 0 AND w < n
  UNION ALL SELECT 'W4', 'FAIL', level, k || ' language keys' FROM w4 WHERE k > 1
  UNION ALL SELECT 'D3', 'WARN', source, 'in train and validation' FROM (SELECT source FROM leaves WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM leaves WHERE doc_id % 2 = 1)""")
def quality_checks(spark, sf_dir):
    """2.14: findings of several checks in one table."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    coded = d.select("source", F.concat("lang", F.lit("_xx")).alias("lang")).distinct()
    leaves = d.select(F.col("source").alias("level"), F.when(F.col("doc_id") % 2 == 0, 1.0).alias("weight"), F.col("lang").alias("lang_key"))
    path = lambda side: d.where(f"doc_id % 2 = {side}").select(F.col("source").alias("path"))
    return checks.union([checks.unfolded_codes(coded), checks.partly_weighted(leaves), checks.mixed_groups(leaves), checks.shared_paths(path(0), path(1))])


@query("""WITH f AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'W1' ELSE event_type END AS "check", CASE WHEN event_id % 3 = 0 THEN 'FAIL' WHEN event_id % 3 = 1 THEN 'WARN' ELSE 'OK' END AS severity FROM events)
  SELECT "check", CASE max(CASE severity WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 WHEN 'SKIP' THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'SKIP' ELSE 'OK' END AS severity, count(*) AS findings FROM f GROUP BY 1""")
def check_status(spark, sf_dir):
    """A34 O5."""
    e = read(spark, sf_dir, "events")
    m = F.col("event_id") % 3
    return checks.status(e.select(F.when(m == 0, "W1").otherwise(F.col("event_type")).alias("check"), F.when(m == 0, "FAIL").when(m == 1, "WARN").otherwise("OK").alias("severity")))


SAID = {"twenty one": "21", "one hundred and five dollars": "$105", "three point one four": "3.14", "fifty percent": "50%", "double seven five": "775", "two and a half": "2.5", "twenty first": "21st"}


@query("SELECT said, expected, expected AS digits FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SAID.items()) + ") t(said, expected)")
def number_words(spark, sf_dir):
    """X5 on generated phrases."""
    return spark.createDataFrame([(a, b, numbers.digits(a)) for a, b in SAID.items()], "said string, expected string, digits string")


@query("""WITH g AS (SELECT o_orderpriority AS name, o_custkey % 10 AS part, count(*) AS n FROM orders GROUP BY ALL)
  SELECT name, part, n, CAST(sum(n) OVER (PARTITION BY name ORDER BY part) AS BIGINT) AS running FROM g""")
def running_totals(spark, sf_dir):
    """Cumulative counts within groups, over an aggregate."""
    g = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 10).alias("part")).agg(F.count("*").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy("name").orderBy("part")))


@query("""WITH e AS (SELECT DISTINCT user_id, event_id % 4 AS stream FROM events), p AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)
  SELECT count(*) AS distinct_ids, round(count(*) / 200::DOUBLE, 6) AS share, CAST(sum(n - 1) AS BIGINT) AS cross_stream_duplicates FROM p""")
def epoch_coverage(spark, sf_dir):
    """What streams cover together, and what several of them saw."""
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("stream"))
    return schedule.coverage(e, "user_id", 200, ["stream"])


@query("SELECT o_orderpriority, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 16) AS BIGINT) AS chunk FROM orders")
def fixed_chunks(spark, sf_dir):
    """B17."""
    return schedule.chunked(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), 16, ["o_orderpriority"], "o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_id > 5000")
def resume_position(spark, sf_dir):
    """Batches after a checkpoint."""
    plan = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("batch_idx"), "event_type")
    return schedule.resumed(plan, 5000, 4, 2, (4, 2)).withColumnRenamed("batch_idx", "event_id")


@query(f"""WITH {CUTS}, s AS (SELECT lang, count(*) AS cuts, sum(duration) / 3600 AS hours, ceil(ceil(ceil(sum(duration) / 200) / 4) / 8) AS steps FROM cuts GROUP BY 1)
  SELECT lang, cuts, CAST(ceil(steps * 2.5) AS BIGINT) AS max_steps, round(hours / greatest(steps, 1), 6) AS hours_per_step, round(hours / greatest(steps, 1) * 10, 6) AS hours_per_log FROM s""")
def run_schedule(spark, sf_dir):
    """B13."""
    s = records.durations(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("cuts"), F.sum("duration").alias("seconds"))
    steps = arithmetic.steps_per_epoch(F.col("cuts"), F.col("seconds"), batch_duration=200.0, world=4, accumulate=8)
    return s.select("lang", *[c.alias(k) for k, c in schedule.schedule(F.col("cuts"), F.col("seconds") / 3600, 2.5, steps, 10).items()])


@query("""SELECT url, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS name, CASE WHEN len(string_split(rtrim(url, '/'), '/')) >= 3 THEN list_extract(string_split(rtrim(url, '/'), '/'), -3) END AS dataset FROM pages""")
def source_paths(spark, sf_dir):
    """P22 P31."""
    return read(spark, sf_dir, "pages").select("url", *[c.alias(k) for k, c in datasets.path_columns(F.col("url")).items()])


@query("""SELECT conv_id, coalesce(nullif(arg_min(role, turn), ''), 'unknown') AS language, nullif(trim(string_agg(trim(text), ' ' ORDER BY turn)), '') AS joined FROM conversations GROUP BY 1""")
def supervision_text(spark, sf_dir):
    """The first supervision's tag, and all texts from first to last."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.col("role").alias("language")))).alias("s"))
    return c.select("conv_id", datasets.record_language(F.col("s"), F.lit(None).cast("string")).alias("language"), datasets.joined_text(F.col("s")).alias("joined"))


@query("""SELECT '/r/checkpoint-' || max(o_custkey) AS path, max(o_custkey) AS step FROM orders""")
def latest_checkpoint(spark, sf_dir):
    """W7."""
    return datasets.latest_checkpoint(read(spark, sf_dir, "orders").select(F.concat(F.lit("/r/checkpoint-"), F.col("o_custkey")).alias("path")))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value IS NULL) AS skipped FROM events""")
def run_counters(spark, sf_dir):
    """A31 A37."""
    e = read(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("completed"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value").isNull()).alias("skipped"))


@query("SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def value_distribution(spark, sf_dir):
    """A38 K10."""
    return read(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {CUTS}, s AS (SELECT corpus, count(*) AS n, sum(duration) AS d FROM cuts GROUP BY 1)
  SELECT corpus, CASE WHEN n = 0 THEN '' ELSE printf('%.2f', d / n) END AS mean_text FROM s""")
def report_formats(spark, sf_dir):
    """X14."""
    s = records.durations(spark, sf_dir).groupBy("corpus").agg(F.count("*").alias("n"), F.sum("duration").alias("d"))
    return s.select("corpus", text.ratio_text(F.col("d"), F.col("n"), 2).alias("mean_text"))


@query("""WITH l AS (SELECT n_name AS source, n_regionkey % 2 AS t, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'en' END AS lang FROM nation)
  SELECT 'T2' AS "check", 'WARN' AS severity, source AS place, 'language missing' AS message FROM l WHERE (t = 0 AND lang = '') OR t = 1""")
def language_checks(spark, sf_dir):
    """chk:T2."""
    n = read(spark, sf_dir, "nation")
    leaves = n.select(F.col("n_name").alias("source"), F.when(F.col("n_regionkey") % 2 == 0, "asr").otherwise("st").alias("task"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise("en").alias("lang"), F.lit(None).cast("string").alias("src_lang"), F.lit("de").alias("tgt_lang"))
    return checks.missing_languages(leaves)


@query("SELECT conv_id, turn, [1, 2, 3, turn % 3 + 7]::BIGINT[]::VARCHAR AS places, turn % 3 + 7 AS total FROM conversations")
def merged_positions(spark, sf_dir):
    """M5: places of tokens after an audio token has grown."""
    c = read(spark, sf_dir, "conversations")
    tokens = F.array(*[F.lit(i) for i in range(4)])
    audio, length = F.array(F.lit(False), F.lit(False), F.lit(True), F.lit(False)), F.array_repeat((F.col("turn") % 3 + 4).cast("long"), 4)
    places, total = schedule.merged_positions(tokens, audio, length)
    return c.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(F.transform(places, lambda p: (p + 1).cast("string")), ", "), F.lit("]")).alias("places"), (total + 0).alias("total"))


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'missing' WHEN o_totalprice > 150000 THEN 'stale' ELSE 'reuse' END AS verdict FROM orders""")
def cache_verdicts(spark, sf_dir):
    """Which measurements can be used again."""
    o = read(spark, sf_dir, "orders")
    sources = o.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("modified"), F.lit(1).alias("shards"))
    known = o.where("o_orderkey % 7 <> 0").select(
        F.col("o_orderkey").alias("path"), F.lit(149999.0).alias("measured"), F.when(F.col("o_orderkey") % 5 != 0, 1).alias("cuts"), F.lit("{}").alias("hist"), (F.col("o_orderkey") % 3 == 0).alias("sampled")
    )
    return cache.judged(sources, known).select("path", "verdict")


@query("""WITH leaves AS (SELECT o_orderpriority AS split, o_custkey AS path FROM orders), c AS (SELECT c_custkey AS path, c_acctbal AS hours, c_nationkey AS cuts FROM customer WHERE c_custkey % 4 > 0)
  SELECT split, round(coalesce(sum(hours), 0), 6) AS hours, CAST(coalesce(sum(cuts), 0) AS BIGINT) AS cuts, count(DISTINCT path) AS paths, count(*) - count(DISTINCT path) AS duplicates,
  count(*) - count(hours) AS unmeasured FROM leaves LEFT JOIN c USING (path) GROUP BY 1""")
def split_totals(spark, sf_dir):
    """A13 A35 RULE7: a path listed twice counts twice."""
    leaves = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_custkey").alias("path"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("hours"), F.col("c_nationkey").cast("long").alias("cuts"))
    return cache.split_totals(leaves, known)
