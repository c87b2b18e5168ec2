"""Queries of sources, intervals, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, joins, metrics, splits
from ..operators.common import shared_path
from ..sources import annotations, audio, manifests
from .base import query
from .metrics import PAIR_SQL, _BA, _N, _preds, paired_runs, rounded
from .roles import role, table

# ---------------------------------------------------------------------------- sources

_RTTM = "SELECT concat_ws(' ', CASE WHEN event_id % 9 = 0 THEN 'SPKR-INFO' ELSE 'SPEAKER' END, concat('file_', CAST(user_id AS STRING)), '1', CAST(event_id % 500 AS STRING), CASE WHEN event_id % 7 = 0 THEN '0' WHEN event_id % 11 = 0 THEN '<NA>' ELSE CAST(event_id % 13 AS STRING) END, '<NA> <NA> spk <NA> <NA>') AS value FROM {events}"


@query(f"""WITH f AS (SELECT string_split(value, ' ') AS f FROM ({_RTTM.format(events="events")})), r AS (SELECT f[2] AS uri, TRY_CAST(f[4] AS DOUBLE) AS start_s, TRY_CAST(f[5] AS DOUBLE) AS n FROM f WHERE f[1] = 'SPEAKER')
SELECT DISTINCT uri, start_s, start_s + n AS end_s, 'SPEECH' AS label, 'dev' AS split, 'vox' AS dataset FROM r WHERE n > 0""")
def io01_parse_rttm(spark, d):
    return annotations.parse_rttm(spark.sql(_RTTM, events=table(spark, d, "events")), "vox", "dev")


_UEM = "SELECT concat_ws('  ', concat('file_', CAST(user_id AS STRING)), '1', CAST(event_id % 500 AS STRING), CAST(event_id % 700 AS STRING)) AS value FROM {events}"


@query("SELECT concat('file_', CAST(user_id AS STRING)) AS uri, CAST(event_id % 500 AS DOUBLE) AS start_s, CAST(event_id % 700 AS DOUBLE) AS end_s FROM events WHERE event_id % 700 > event_id % 500")
def io02_parse_uem(spark, d):
    return annotations.parse_uem(spark.sql(_UEM, events=table(spark, d, "events")))


@query("""WITH a AS (SELECT CAST(user_id AS STRING) AS uri, CAST(event_id AS DOUBLE) AS start_s, event_id + value AS end_s, CASE event_id % 3 WHEN 0 THEN 'CLEAN_SPEECH' WHEN 1 THEN 'NO_SPEECH' ELSE 'SPEECH_WITH_NOISE' END AS l FROM events)
SELECT uri, start_s, end_s, CASE WHEN contains(l, 'SPEECH') AND NOT contains(l, 'NO_SPEECH') THEN 'SPEECH' ELSE 'NONSPEECH' END AS label, 'train' AS split, 'ava' AS dataset, CASE WHEN contains(l, 'CLEAN') THEN 'clean' WHEN contains(l, 'NOISE') THEN 'noise' ELSE 'none' END AS condition FROM a""")
def io03_ava_frames(spark, d):
    e = table(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS video_id", "CAST(event_id AS DOUBLE) AS start_s", "event_id + value AS end_s", "CASE event_id % 3 WHEN 0 THEN 'CLEAN_SPEECH' WHEN 1 THEN 'NO_SPEECH' ELSE 'SPEECH_WITH_NOISE' END AS label")
    return annotations.ava_frames(e, "ava", "train")


@query("SELECT uri, start_s, end_s, label, 'dev' AS split, 'ev' AS dataset FROM frames", "frames")
def io04_frame_table(spark, d):
    """Written as a frame table and read back."""
    f = role(spark, d, "frames").select("uri", "start_s", "end_s", "label", F.lit("dev").alias("split"), F.lit("ev").alias("dataset"))
    path = shared_path(spark, "frames")
    annotations.write_frame_table(f, path)
    return annotations.read_frame_table(spark, path)


@query("SELECT regexp_replace(regexp_extract(audio_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS clip_id, audio_path, ground_truth AS label, ground_truth FROM manifest", "manifest")
def io05_harmonise_manifest(spark, d):
    return manifests.harmonise_manifest(role(spark, d, "manifest").select("audio_path", F.col("ground_truth").alias("label")))


@query("SELECT clip_id, CASE WHEN clip_id % 2 = 0 THEN snr_db END AS snr_db, CASE WHEN clip_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM manifest", "manifest")
def io06_union_split_manifests(spark, d):
    m = role(spark, d, "manifest")
    return manifests.union_split_manifests({"dev": m.filter("clip_id % 2 = 0").select("clip_id", "snr_db"), "test": m.filter("clip_id % 2 = 1").select("clip_id")})


@query("SELECT concat('run_', CAST(run AS STRING)) AS run, clip_id, ground_truth, prediction, correct FROM preds", "preds")
def io07_union_predictions(spark, d):
    """The rows of all seven runs, of which every second one has y_true and y_pred in place of correct."""
    p = _preds(spark, d)
    with_correct = ("clip_id", "ground_truth", "prediction", "correct")
    without = ("clip_id", "prediction", F.col("ground_truth").alias("y_true"), F.col("prediction").alias("y_pred"))
    u = manifests.union_predictions({f"run_{r}": p.filter(F.col("run") == r).select(*(with_correct if r % 2 else without)) for r in range(1, 8)})
    return u.select("run", "clip_id", "ground_truth", "prediction", "correct")


@query("SELECT concat('run_', CAST(run AS STRING)) AS run, ground_truth, count(*) AS n, sum(CAST(correct AS INTEGER))::BIGINT AS n_correct FROM preds GROUP BY 1, 2", "preds")
def io07_union_predictions_all_runs(spark, d):
    p = _preds(spark, d)
    with_correct = ("clip_id", "ground_truth", "correct")
    without = ("clip_id", F.col("ground_truth").alias("y_true"), F.col("prediction").alias("y_pred"))
    u = manifests.union_predictions({f"run_{r}": p.filter(F.col("run") == r).select(*(with_correct if r % 2 else without)) for r in range(1, 8)})
    return u.groupBy("run", "ground_truth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"))


@query("WITH a AS (SELECT o_custkey, list(CAST(o_orderkey % 2 AS INTEGER) ORDER BY o_orderkey) AS p, list(CAST(o_orderkey % 3 % 2 AS INTEGER) ORDER BY o_orderkey) AS g FROM orders GROUP BY 1) SELECT o_custkey, CAST(i AS INTEGER) AS position, p[i + 1] AS prediction, g[i + 1] AS ground_truth FROM (SELECT *, unnest(range(len(p))) AS i FROM a)")
def io08_prediction_arrays(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    arrays = o.select("o_custkey", F.transform("k", lambda k: (k % 2).cast("int")).alias("predictions"), F.transform("k", lambda k: (k % 3 % 2).cast("int")).alias("ground_truth"))
    path = shared_path(spark, "prediction-arrays")
    arrays.write.json(path)
    return manifests.read_prediction_arrays(spark, path, keys="o_custkey long", multi_line=False)


@query("SELECT 'open' AS format, concat('t', item_id) AS id, text, CASE WHEN item_id % 2 = 0 THEN 'SPEECH' END AS a_label, 2 AS n_labels FROM benchmark")
def io09_prompt_templates(spark, d):
    t = F.struct(F.concat(F.lit("t"), F.col("item_id")).alias("id"), F.col("text").alias("text"), F.expr("CASE WHEN item_id % 2 = 0 THEN map('A', 'SPEECH') END").alias("mapping"), F.array(F.lit("yes")).alias("verbalizers"))
    docs = table(spark, d, "benchmark").select(F.lit("open").alias("format"), F.array(F.lit("SPEECH"), F.lit("NONSPEECH")).alias("label_space"), F.array(t).alias("templates"))
    rows = manifests.explode_templates(docs)
    return rows.select("format", "id", "text", F.try_element_at("mapping", F.lit("A")).alias("a_label"), F.size("label_space").alias("n_labels"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def io10_jsonl_log(spark, d):
    """Half of the events are a log, to which the other half is appended."""
    path = shared_path(spark, "log")
    lines = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("j")).select("event_id", "j.k")
    for half in (0, 1):
        manifests.append_jsonl_log(lines.filter(F.col("event_id") % 2 == half), path)
    return manifests.read_jsonl_log(spark, path, "event_id long, k int")


@query("SELECT clip_id, group_id, ground_truth, CASE WHEN clip_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM manifest", "manifest")
def io13_write_splits(spark, d):
    """A folder for each split, read back as one table."""
    m = role(spark, d, "manifest").select("clip_id", "group_id", "ground_truth", F.when(F.col("clip_id") % 3 == 0, "test").otherwise("train").alias("split"))
    path = shared_path(spark, "splits")
    manifests.write_splits(m, path)
    return spark.read.parquet(path).select("clip_id", "group_id", "ground_truth", "split")


@query("SELECT regexp_replace(regexp_extract(audio_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS clip_id, audio_path, 'NONSPEECH' AS ground_truth, 'files' AS source, 1000 AS duration_ms, CAST(NULL AS DOUBLE) AS snr_db FROM manifest", "manifest")
def io12_manifest_from_files(spark, d):
    return manifests.manifest_from_files(role(spark, d, "manifest").select(F.col("audio_path").alias("path")), "NONSPEECH", "files")


_JSON = '"ba":\', ba, \',"speech_acc":\', acc_pos, \',"nonspeech_acc":\', acc_neg, \''


@query(f"""WITH c AS (SELECT variant_type, CAST(dur AS STRING) AS condition, {_BA}, {_N} FROM preds GROUP BY 1, 2), t AS (SELECT variant_type, {_BA}, {_N} FROM preds GROUP BY 1), o AS (SELECT {_BA}, {_N} FROM preds),
cj AS (SELECT variant_type, string_agg(concat('"', condition, '":{{{_JSON},"n_samples":', n, ',"n_speech":', n_pos, ',"n_nonspeech":', n_neg, '}}'), ',' ORDER BY condition) AS j FROM c GROUP BY 1),
tj AS (SELECT string_agg(concat('"', t.variant_type, '":{{{_JSON},"n_samples":', n, ',"conditions":{{', j, '}}}}'), ',' ORDER BY t.variant_type) AS j FROM t JOIN cj ON t.variant_type = cj.variant_type)
SELECT concat('{{"mode":"base","threshold":0.5,"n_samples":', n, ',"overall":{{{_JSON}}},"by_variant_type":{{', j, '}}}}') AS document FROM o, tj""", "preds")
def io14_metrics_document(spark, d):
    return manifests.metrics_document(_preds(spark, d).withColumn("condition", F.col("dur").cast("string")), {"mode": "base", "threshold": 0.5}, digits=6)


# ---------------------------------------------------------------------------- intervals

_MERGED = """s AS (SELECT uri, start_s, end_s FROM frames WHERE label = 'SPEECH' AND end_s > start_s), i AS (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY uri ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM i), merged AS (SELECT uri, min(start_s) AS start_s, max(end_s) AS end_s FROM g GROUP BY uri, island)"""


def _speech(spark, d):
    return role(spark, d, "frames").filter("label = 'SPEECH'").select("uri", "start_s", "end_s")


@query(f"WITH {_MERGED} SELECT uri, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM merged", "frames")
def iv01_merge_intervals(spark, d):
    return rounded(intervals.merge_intervals(_speech(spark, d), ["uri"]))


@query("""SELECT f.uri, round(greatest(f.start_s, r.start_s), 6) AS start_s, round(least(f.end_s, r.end_s), 6) AS end_s FROM frames f JOIN regions r ON f.uri = r.uri AND f.start_s < r.end_s AND f.end_s > r.start_s WHERE f.label = 'SPEECH'
UNION ALL SELECT uri, round(start_s, 6), round(end_s, 6) FROM frames WHERE label = 'SPEECH' AND uri NOT IN (SELECT uri FROM regions)""", "frames", "regions")
def iv02_crop_intervals(spark, d):
    return rounded(intervals.crop_intervals(_speech(spark, d), role(spark, d, "regions")))


@query(f"""WITH {_MERGED}, e AS (SELECT uri, min(start_s) AS lo, max(end_s) AS hi FROM regions GROUP BY uri), o AS (SELECT uri, min(start_s) AS lo, max(end_s) AS hi FROM merged GROUP BY uri),
x AS (SELECT coalesce(e.uri, o.uri) AS uri, coalesce(e.lo, o.lo) AS lo, coalesce(e.hi, o.hi) AS hi FROM o FULL JOIN e ON o.uri = e.uri),
n AS (SELECT uri, start_s, end_s, lead(start_s) OVER w AS nx, lag(end_s) OVER w AS pv FROM merged WINDOW w AS (PARTITION BY uri ORDER BY start_s)),
a AS (SELECT x.uri, lo, hi, lo AS s, coalesce(start_s, hi) AS e FROM x LEFT JOIN n ON x.uri = n.uri WHERE pv IS NULL UNION ALL SELECT x.uri, lo, hi, end_s, coalesce(nx, hi) FROM x JOIN n ON x.uri = n.uri)
SELECT uri, round(greatest(s, lo), 6) AS start_s, round(least(e, hi), 6) AS end_s FROM a WHERE least(e, hi) > greatest(s, lo)""", "frames", "regions")
def iv03_interval_gaps(spark, d):
    return rounded(intervals.interval_gaps(_speech(spark, d), role(spark, d, "regions")))


_SLICES = """b AS (SELECT event_id, uri, start_s + 1.0::DOUBLE AS s, end_s - 1.0::DOUBLE AS e, unnest([30000, 60000]) AS duration_ms FROM frames WHERE label = 'SPEECH'),
c AS (SELECT *, CAST(floor((e - s) / (duration_ms / 1000.0::DOUBLE)) AS INTEGER) AS n FROM b), sl AS (SELECT event_id, uri, duration_ms, CAST(i AS INTEGER) AS slice_no, s + i * (duration_ms / 1000.0::DOUBLE) AS start_s, e AS lim FROM (SELECT *, unnest(range(n)) AS i FROM c WHERE n > 0)),
sliced AS (SELECT event_id, uri, duration_ms, slice_no, start_s, start_s + duration_ms / 1000.0::DOUBLE AS end_s FROM sl WHERE start_s + duration_ms / 1000.0::DOUBLE <= lim)"""


def _sliced(spark, d):
    f = role(spark, d, "frames").filter("label = 'SPEECH'").select("event_id", "uri", "start_s", "end_s")
    return intervals.slice_intervals(f, [30000, 60000])


@query(f"WITH {_SLICES} SELECT event_id, uri, duration_ms, slice_no, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM sliced", "frames")
def iv04_slice_intervals(spark, d):
    return rounded(_sliced(spark, d))


@query(f"WITH {_SLICES}, r AS (SELECT *, row_number() OVER (PARTITION BY duration_ms ORDER BY start_s, event_id, slice_no) AS k FROM sliced) SELECT event_id, uri, duration_ms, slice_no FROM r WHERE k <= 50", "frames")
def iv05_cap_per_config(spark, d):
    return intervals.cap_per_config(_sliced(spark, d), ["duration_ms"], 50, ["start_s", "event_id", "slice_no"]).select("event_id", "uri", "duration_ms", "slice_no")


@query("SELECT vec_id AS uri, CAST(vec_id % 3 AS INTEGER) AS k, len(embedding[1 + CAST(floor((vec_id % 3) * 0.01::DOUBLE * 1000) AS INTEGER):CAST(floor(((vec_id % 3) * 0.01::DOUBLE + 0.02::DOUBLE) * 1000) AS INTEGER)])::INTEGER AS n, round(CAST(embedding[1 + CAST(floor((vec_id % 3) * 0.01::DOUBLE * 1000) AS INTEGER)] AS DOUBLE), 6) AS first FROM embeddings")
def iv06_segment_clips(spark, d):
    w = role(spark, d, "waves").withColumnRenamed("clip_id", "uri")
    seg = w.selectExpr("uri", "CAST(uri % 3 AS INT) AS k", "(uri % 3) * CAST(0.01 AS DOUBLE) AS start_s", "(uri % 3) * CAST(0.01 AS DOUBLE) + CAST(0.02 AS DOUBLE) AS end_s")
    clips, _ = intervals.segment_clips(w, seg)
    return clips.select("uri", "k", F.size("samples").alias("n"), F.round(F.col("samples")[0].cast("double"), 6).alias("first"))


@query("""WITH s AS (SELECT vec_id AS uri, [CAST(trunc(greatest(least(CAST(v AS DOUBLE), 1), -1) * 32767) AS DOUBLE) / 32768 FOR v IN embedding] AS x, unnest([0, 1, 2]) AS k FROM embeddings),
t AS (SELECT uri, k, x[1 + CAST(floor(k * 0.02::DOUBLE * 1000) AS INTEGER):CAST(floor((k * 0.02::DOUBLE + 0.03::DOUBLE) * 1000) AS INTEGER)] AS y FROM s) SELECT uri, k, len(y)::INTEGER AS n, round(list_sum(y), 4) AS total, round(y[1], 6) AS first, NULL::STRING AS error FROM t""")
def iv06_segments_of_files(spark, d):
    """Every vector as a WAV file; of each, three overlapping segments of 30 ms, the last one cut short by the end, read by ranges of bytes."""
    folder = shared_path(spark, "recordings")
    w = role(spark, d, "waves")
    audio.write_wav_corpus(w, folder)
    index = audio.index_wav_corpus(spark, folder).withColumn("uri", F.regexp_extract("path", r"([^/]*)\.wav$", 1).cast("long"))
    seg = w.select(F.col("clip_id").cast("long").alias("uri"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).selectExpr("uri", "k", "k * CAST(0.02 AS DOUBLE) AS start_s", "k * CAST(0.02 AS DOUBLE) + CAST(0.03 AS DOUBLE) AS end_s")
    clips, _ = audio.read_segments(index, seg)
    x = F.col("samples").cast("array<double>")
    return clips.select("uri", "k", F.size("samples").alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(x[0], 6).alias("first"), "error")


@query("""WITH s AS (SELECT uri, sum(end_s - start_s) AS t FROM frames WHERE label = 'SPEECH' GROUP BY uri), c AS (SELECT DISTINCT uri FROM frames) SELECT c.uri, round(coalesce(t, 0) / 5000, 6) AS ratio, coalesce(t, 0) / 5000 >= 0.8 AS passed FROM c LEFT JOIN s ON c.uri = s.uri""", "frames")
def iv07_speech_ratio(spark, d):
    clips = role(spark, d, "frames").select("uri").distinct().withColumn("duration_s", F.lit(5000.0))
    return rounded(intervals.speech_ratio(_speech(spark, d), clips, 0.8, "uri"))


# ---------------------------------------------------------------------------- joins


@query(f"WITH {PAIR_SQL} SELECT * FROM pair", "preds")
def jn01_pair_predictions(spark, d):
    return joins.pair_predictions(*paired_runs(spark, d), ["clip_id"])


@query(f"WITH {PAIR_SQL} SELECT (SELECT count(*) FROM pair) AS matched, (SELECT count(*) FROM f WHERE run = 1) - (SELECT count(*) FROM pair) AS only_a, (SELECT count(*) FROM f WHERE run = 2) - (SELECT count(*) FROM pair) AS only_b, (SELECT count(*) FROM pair WHERE ground_truth_a <> ground_truth_b) AS truth_differs", "preds")
def jn01_pairing_report(spark, d):
    return joins.pairing_report(*paired_runs(spark, d), ["clip_id"])


@query("SELECT count(*) AS n_rows, count(*) FILTER (p_partkey IN (SELECT s_suppkey FROM supplier)) AS n_found, round(count(*) FILTER (p_partkey IN (SELECT s_suppkey FROM supplier)) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM part")
def jn02_manifest_coverage(spark, d):
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return rounded(joins.manifest_coverage(table(spark, d, "part"), files, "p_partkey")[2])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def jn02_missing_files(spark, d):
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return joins.manifest_coverage(table(spark, d, "part"), files, "p_partkey")[1].select("p_partkey")


_SPLIT = "CASE WHEN clip_id % 2 = 0 THEN 'dev' ELSE 'test' END"


@query(f"SELECT group_id, string_agg(DISTINCT {_SPLIT}, ',' ORDER BY {_SPLIT}) AS splits FROM manifest GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1", "manifest")
def jn03_leakage_audit(spark, d):
    return joins.leakage_audit(role(spark, d, "manifest").withColumn("split", F.expr(_SPLIT)), "group_id", "split")[1]


@query(f"SELECT {_SPLIT} AS split, count(DISTINCT group_id) AS n_groups, count(*) AS n_rows FROM manifest GROUP BY 1", "manifest")
def jn03_split_sizes(spark, d):
    return joins.leakage_audit(role(spark, d, "manifest").withColumn("split", F.expr(_SPLIT)), "group_id", "split")[0]


def _unit(key, seed):
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', {key}, '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH p AS (SELECT vec_id AS noise_id, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings WHERE label = 9), n AS (SELECT count(*) AS n FROM p)
SELECT clip_id, noise_id, round(20 * {_unit('CAST(clip_id AS STRING)', 2)}, 6) AS snr_db, {_unit('CAST(clip_id AS STRING)', 3)} < 0.5 AS applied FROM manifest, n JOIN p ON p.slot = CAST(floor({_unit('CAST(clip_id AS STRING)', 1)} * n.n) AS INTEGER)""", "manifest")
def jn04_assign_noise(spark, d):
    pool = table(spark, d, "embeddings").filter("label = 9").select(F.col("vec_id").alias("noise_id"))
    return rounded(joins.assign_noise(role(spark, d, "manifest").select("clip_id"), pool, seed=1, share=0.5))


_CELL = "WITH c AS (SELECT run, dur, snr, avg(CAST(correct AS INTEGER)) AS a FROM preds WHERE run IN (1, 2) GROUP BY 1, 2, 3)"


@query(f"{_CELL} SELECT coalesce(x.dur, y.dur) AS dur, coalesce(x.snr, y.snr) AS snr, round(x.a, 6) AS base, round(y.a, 6) AS other, round(y.a - x.a, 6) AS delta FROM (SELECT * FROM c WHERE run = 1) x FULL JOIN (SELECT * FROM c WHERE run = 2) y ON x.dur = y.dur AND x.snr = y.snr", "preds")
def jn05_delta_cells(spark, d):
    t = metrics.accuracy_table(_preds(spark, d), ["run", "dur", "snr"])
    return rounded(joins.delta_cells(t.filter("run = 1"), t.filter("run = 2"), ["dur", "snr"], "accuracy"))


@query("""WITH m AS (SELECT run, dur AS metric, avg(score) AS v FROM preds WHERE run IN (1, 2) GROUP BY 1, 2) SELECT x.metric, round(x.v, 6) AS base, round(y.v, 6) AS new, round(y.v - x.v, 6) AS delta, round((y.v - x.v) / abs(x.v) * 100, 6) AS percent, y.v < x.v AS improved FROM m x JOIN m y ON x.metric = y.metric AND x.run = 1 AND y.run = 2""", "preds")
def jn06_compare_thresholds(spark, d):
    m = _preds(spark, d).groupBy("run", F.col("dur").alias("metric")).agg(F.avg("score").alias("value"))
    return rounded(joins.compare_thresholds(m.filter("run = 1"), m.filter("run = 2")))


# ---------------------------------------------------------------------------- splits


def _h(col, seed):
    return f"md5(concat_ws('|', CAST({col} AS STRING), '{seed}')), {col}"


@query(f"WITH n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM manifest GROUP BY dataset, ground_truth)), r AS (SELECT clip_id, dataset, ground_truth, row_number() OVER (PARTITION BY dataset, ground_truth ORDER BY {_h('clip_id', 3)}) AS k FROM manifest) SELECT clip_id, dataset, ground_truth FROM r, n WHERE k <= least", "manifest")
def sp01_balance_to_min(spark, d):
    return splits.balance_to_min(role(spark, d, "manifest"), ["dataset", "ground_truth"], "clip_id", 3).select("clip_id", "dataset", "ground_truth")


@query(f"""WITH c AS (SELECT group_id, min(dataset) AS dataset, min(ground_truth) AS ground_truth FROM manifest GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, ground_truth ORDER BY {_h('group_id', 5)}) AS k, count(*) OVER (PARTITION BY dataset, ground_truth) AS n FROM c)
SELECT m.clip_id, m.group_id, CASE WHEN k <= greatest(1, CAST(floor(n * 0.2::DOUBLE) AS INTEGER)) THEN 'test' ELSE 'dev' END AS split FROM manifest m JOIN r USING (group_id)""", "manifest")
def sp02_split_clips_stratified(spark, d):
    m = role(spark, d, "manifest")
    return splits.split_clips_stratified(m, 0.2, 5, "group_id").select("clip_id", "group_id", "split")


@query(f"""WITH c AS (SELECT group_id, ground_truth, count(*) AS n FROM manifest GROUP BY 1, 2), j AS (SELECT group_id, ground_truth FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, ground_truth) AS k FROM c) WHERE k = 1),
r AS (SELECT group_id, row_number() OVER (PARTITION BY ground_truth ORDER BY {_h('group_id', 7)}) AS k, count(*) OVER (PARTITION BY ground_truth) AS n FROM j) SELECT clip_id, m.group_id, CASE WHEN k <= ceil(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM manifest m JOIN r USING (group_id)""", "manifest")
def sp03_split_groups_by_majority(spark, d):
    return splits.split_groups_by_majority(role(spark, d, "manifest"), 0.25, 7).select("clip_id", "group_id", "split")


@query(f"""WITH g AS (SELECT DISTINCT group_id FROM manifest), n AS (SELECT count(*) AS n FROM g), r AS (SELECT group_id, row_number() OVER (ORDER BY {_h('group_id', 9)}) AS k FROM g)
SELECT clip_id, m.group_id, CASE WHEN k <= floor(n * 0.5::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.5::DOUBLE) + floor(n * 0.25::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM manifest m JOIN r USING (group_id), n""", "manifest")
def sp04_split_groups(spark, d):
    return splits.split_groups(role(spark, d, "manifest"), {"train": 0.5, "dev": 0.25, "test": None}, 9).select("clip_id", "group_id", "split")


@query(f"""WITH r AS (SELECT clip_id, ground_truth, duration_ms, snr_db, row_number() OVER (PARTITION BY ground_truth, duration_ms, snr_db ORDER BY {_h('clip_id', 2)}) AS k, count(*) OVER (PARTITION BY ground_truth, duration_ms, snr_db) AS n FROM manifest),
t AS (SELECT count(*) AS total, count(*) - CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS seats FROM manifest),
g AS (SELECT ground_truth, duration_ms, snr_db, n, n * seats // total AS least, n * seats % total AS rest, seats - sum(n * seats // total) OVER () AS spare FROM (SELECT DISTINCT ground_truth, duration_ms, snr_db, n FROM r), t),
s AS (SELECT *, least + CASE WHEN row_number() OVER (ORDER BY rest DESC, md5(concat_ws('|', ground_truth, CAST(duration_ms AS STRING), CAST(snr_db AS STRING), '2')), ground_truth, duration_ms, snr_db) <= spare THEN 1 ELSE 0 END AS train FROM g)
SELECT clip_id, CASE WHEN k <= r.n - train THEN 'test' ELSE 'train' END AS split FROM r JOIN s ON r.ground_truth = s.ground_truth AND r.duration_ms = s.duration_ms AND r.snr_db IS NOT DISTINCT FROM s.snr_db""", "manifest")
def sp05_split_rows_stratified(spark, d):
    return splits.split_rows_stratified(role(spark, d, "manifest"), ["ground_truth", "duration_ms", "snr_db"], ["ground_truth"], 0.3, 2).select("clip_id", "split")


@query(f"WITH r AS (SELECT clip_id, row_number() OVER (ORDER BY {_h('clip_id', 4)}) AS k, count(*) OVER () AS n FROM manifest) SELECT clip_id, CASE WHEN k <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'test' END AS split FROM r", "manifest")
def sp06_split_rows_random(spark, d):
    return splits.split_rows_random(role(spark, d, "manifest").select("clip_id"), 0.8, 4)


@query(f"""WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM manifest GROUP BY ground_truth)), r AS (SELECT clip_id, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY {_h('clip_id', 6)}) AS k FROM manifest)
SELECT clip_id, ground_truth, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r, n WHERE k <= n""", "manifest")
def sp07_split_balanced_ratios(spark, d):
    return splits.split_balanced_ratios(role(spark, d, "manifest"), 0.7, 0.2, 6).select("clip_id", "ground_truth", "split")


@query(f"SELECT clip_id FROM manifest ORDER BY {_h('clip_id', 8)} LIMIT 500", "manifest")
def sp08_sample_uniform(spark, d):
    return splits.sample_uniform(role(spark, d, "manifest").select("clip_id"), 500, 8)


@query(f"""WITH r AS (SELECT clip_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_h('clip_id', 1)}) AS k, count(*) OVER (PARTITION BY dataset) AS n, count(*) OVER () AS t FROM manifest), s AS (SELECT clip_id, dataset FROM r WHERE k <= greatest(1, CAST(round_even(400.0::DOUBLE * n / t, 0) AS INTEGER)))
SELECT * FROM s ORDER BY {_h('clip_id', 1)} LIMIT 400""", "manifest")
def sp09_sample_stratified(spark, d):
    return splits.sample_stratified(role(spark, d, "manifest").select("clip_id", "dataset"), 400, "dataset", 1)


@query(f"WITH r AS (SELECT clip_id, row_number() OVER (PARTITION BY duration_ms, snr_db, ground_truth ORDER BY {_h('clip_id', 2)}) AS k FROM manifest), s AS (SELECT clip_id FROM r WHERE k <= 20) SELECT clip_id FROM s ORDER BY {_h('clip_id', 2)} LIMIT 300", "manifest")
def sp10_sample_per_condition(spark, d):
    return splits.sample_per_condition(role(spark, d, "manifest"), ["duration_ms", "snr_db", "ground_truth"], 20, 300, 2).select("clip_id")


@query(f"""WITH r AS (SELECT clip_id, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY {_h('clip_id', 3)}) - 1 AS p, count(*) OVER (PARTITION BY ground_truth) AS n FROM manifest), g AS (SELECT DISTINCT ground_truth, n FROM r), dr AS (SELECT ground_truth, n, CAST(i AS INTEGER) AS draw FROM g, range(6000) AS t(i)),
q AS (SELECT ground_truth, draw, CASE WHEN n >= 6000 THEN draw ELSE CAST(concat('0x', substr(md5(concat_ws('|', ground_truth, CAST(draw AS STRING), '3')), 1, 8)) AS BIGINT) % n END AS p FROM dr) SELECT r.clip_id, r.ground_truth, q.draw FROM r JOIN q ON r.ground_truth = q.ground_truth AND r.p = q.p""", "manifest")
def sp11_sample_half_half(spark, d):
    return splits.sample_half_half(role(spark, d, "manifest").select("clip_id", "ground_truth"), 12000, seed=3)


@query(f"WITH r AS (SELECT clip_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_h('clip_id', 4)}) AS k FROM manifest) SELECT clip_id, dataset FROM r WHERE k <= CASE dataset WHEN '1-URGENT' THEN 400 WHEN '2-HIGH' THEN 400 WHEN '5-LOW' THEN 200 ELSE 0 END", "manifest")
def sp12_compose_by_share(spark, d):
    return splits.compose_by_share(role(spark, d, "manifest").select("clip_id", "dataset"), {"1-URGENT": 0.4, "2-HIGH": 0.4, "5-LOW": 0.2}, 1000, "dataset", seed=4)


@query(f"""WITH m AS (SELECT *, {_SPLIT} AS split FROM manifest), g AS (SELECT split, ground_truth, duration_ms, snr_db, grouping_id(split, ground_truth, duration_ms, snr_db) AS level, count(*) AS n FROM m GROUP BY GROUPING SETS ((split), (split, ground_truth), (split, ground_truth, duration_ms, snr_db)))
SELECT *, round(n / sum(n) OVER (PARTITION BY level), 6) AS share FROM g""", "manifest")
def sp13_split_summary(spark, d):
    return splits.split_summary(role(spark, d, "manifest").withColumn("split", F.expr(_SPLIT)))

