"""The driver's tables in the roles that the operators expect.

Each role is one SELECT that Spark and DuckDB both read; ``{table}`` stands for a table, ``{since}`` for the
microseconds of a timestamp since the first of January 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")

ROLES = {
    "preds": """
        SELECT *, CASE WHEN score > 0.5 THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction,
          (score > 0.5) = (ground_truth = 'SPEECH') AS correct, CASE WHEN score > 0.5 THEN score ELSE 1 - score END AS confidence,
          CASE WHEN variant_type = 'duration' THEN dur END AS duration_ms, CASE WHEN variant_type = 'snr' THEN snr END AS snr_db,
          CASE WHEN variant_type = 'band' THEN CASE WHEN dur < 80 THEN 'lowpass' WHEN dur < 200 THEN 'highpass' ELSE 'telephony' END END AS band_filter,
          CASE WHEN variant_type = 'rir' THEN CASE WHEN snr < 0 THEN 'short' WHEN snr < 10 THEN 'middle' ELSE 'long' END END AS t60_bin
        FROM (SELECT concat('clip_', CAST(l_orderkey AS STRING)) AS clip_id, l_linenumber AS run,
          CASE WHEN l_returnflag = 'R' THEN 'SPEECH' ELSE 'NONSPEECH' END AS ground_truth,
          l_quantity / CAST(50 AS DOUBLE) AS score, (l_quantity - 25) / CAST(5 AS DOUBLE) AS logit_diff,
          CASE CAST(round(l_tax * 100) AS INT) WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 80 WHEN 4 THEN 100 WHEN 5 THEN 200 WHEN 6 THEN 500 ELSE 1000 END AS dur,
          CAST(round(l_discount * 100) AS INT) * 3 - 10 AS snr,
          CASE (l_orderkey + l_partkey) % 4 WHEN 0 THEN 'duration' WHEN 1 THEN 'snr' WHEN 2 THEN 'band' ELSE 'rir' END AS variant_type,
          l_partkey, l_suppkey, l_quantity, l_extendedprice FROM {lineitem}) AS base""",
    "frames": """
        SELECT CAST(user_id AS STRING) AS uri, start_s, start_s + value * 60 AS end_s,
          CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'SPEECH' ELSE 'NONSPEECH' END AS label, event_type, event_id
        FROM (SELECT user_id, event_type, event_id, value, {since} / CAST(1000000 AS DOUBLE) AS start_s FROM {events}) AS e""",
    "regions": """
        SELECT CAST(user_id AS STRING) AS uri, {since} / CAST(1000000 AS DOUBLE) - 3600 AS start_s, {since} / CAST(1000000 AS DOUBLE) + 7200 AS end_s
        FROM {events} WHERE event_type = 'signup'""",
    "manifest": """
        SELECT o_orderkey AS clip_id, o_custkey AS group_id, o_orderpriority AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'SPEECH' ELSE 'NONSPEECH' END AS ground_truth,
          CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 100 WHEN 2 THEN 500 ELSE 1000 END AS duration_ms, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS INT) * 10 END AS snr_db,
          concat('/clips/', CAST(o_orderkey AS STRING), '_dur', CAST(o_orderkey % 1000 AS STRING), 'ms_snr', CASE WHEN o_custkey % 3 = 0 THEN '-5' WHEN o_custkey % 3 = 1 THEN '+10' ELSE '20' END, 'dB.wav') AS audio_path
        FROM {orders}""",
    "answers": """
        SELECT conv_id * 100 + turn AS answer_id, CASE (conv_id + turn) % 16
          WHEN 0 THEN text WHEN 1 THEN 'NON-SPEECH' WHEN 2 THEN 'Speech.' WHEN 3 THEN 'B) music' WHEN 4 THEN 'A' WHEN 5 THEN 'No, nothing at all'
          WHEN 6 THEN 'yes' WHEN 7 THEN 'I hear music and a voice' WHEN 8 THEN 'Background noise followed by laughter' WHEN 9 THEN 'It is not correct'
          WHEN 10 THEN concat('I hear ', text) WHEN 11 THEN 'there is NO human SPEECH' WHEN 12 THEN 'Does not contain' WHEN 13 THEN '' WHEN 14 THEN NULL ELSE 'An engine idling' END AS answer
        FROM {conversations}""",
    "waves": """SELECT vec_id AS clip_id, embedding AS samples, 1000 AS sr, CASE WHEN label < 5 THEN 'SPEECH' ELSE 'NONSPEECH' END AS ground_truth, label FROM {embeddings}""",
    "log": """
        SELECT CAST(l_suppkey % 8 AS INT) AS prompt_id, l_linenumber AS iteration, CASE WHEN l_linestatus = 'F' THEN 'free' ELSE 'constrained' END AS decoding_mode,
          (l_returnflag = 'R') = (l_quantity > 25) AS is_correct FROM {lineitem}""",
    "history": """
        SELECT o_orderkey AS candidate, CAST(o_orderkey % 15 AS INT) AS iteration, o_totalprice / CAST(500000 AS DOUBLE) AS ba_clip,
          CAST(o_custkey % 100 AS DOUBLE) / 100 AS ba_cond, CAST(o_custkey % 300 AS INT) AS prompt_length FROM {orders}""",
}

_SINCE = {"spark": "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS DOUBLE)", "duckdb": "CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ROLES[name].replace("{since}", _SINCE["spark"])
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_roles(sql: str, *names: str) -> str:
    """DuckDB text of a query over roles."""
    parts = []
    for n in names:
        text = ROLES[n].replace("{since}", _SINCE["duckdb"])
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        parts.append(f"{n} AS ({text})")
    head = "WITH " + ",\n".join(parts)
    body = sql.strip()
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
