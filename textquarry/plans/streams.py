"""Streams and resumed runs as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import detectors as D
from textquarry.plans.corpus import LOG, log
from textquarry.plans.overlay import read
from textquarry.sources.staging import new_folder
from textquarry.streaming import machine, resume

CHUNKS = 4


def _stopped_and_restarted(spark, d) -> DataFrame:
    """The log's transitions, by a stream that gets it in parts by time and is stopped and restarted after each."""
    folder, rows = new_folder(spark, "machine"), log(spark, d)
    us = F.unix_micros(F.col("at").cast("timestamp"))
    least, most = rows.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - F.lit(least or 0)) * CHUNKS / F.lit((most or 0) - (least or 0) + 1))
    for k in range(CHUNKS):
        rows.filter(part == k).write.mode("append").parquet(f"{folder}/in")
        machine.write(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(machine.TRANSITION).parquet(f"{folder}/out")


def j2_state_stream(spark, d):
    """Every transition, the rejected ones and retries by timer included."""
    done = _stopped_and_restarted(spark, d)
    return done.select("sha256", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "seq", "event", "before", "state", "attempts", "accepted")


def j2_state_stream_totals(spark, d):
    """The states that the stream leaves applications in."""
    left = machine.current(_stopped_and_restarted(spark, d))
    return left.groupBy("state", "attempts").agg(F.count("*").alias("n"), F.sum("rejected").alias("rejected"))


_TEXT = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' https://api.openai.com/v1' WHEN 1 THEN c_name || ' com/anthropic/x' ELSE c_name END"
_BROKEN, _MISSING = "c_nationkey % 7 = 2", "c_nationkey % 5 = 4"
_FINDING = "app_id string, kind string, provider string, evidence string, severity string"


def _packages(spark, d) -> tuple[DataFrame, DataFrame]:
    """A manifest of all customers, and packages of most: JSON payloads, of which some are cut off and can't be read."""
    people = read(spark, d, "customer").withColumn("app_id", F.concat(F.lit("u"), "c_custkey"))
    whole = F.to_json(F.struct(F.expr(_TEXT).alias("text"))).cast("binary")
    payload = F.when(F.expr(_BROKEN), F.substring(whole, 1, 9)).otherwise(whole)
    came = people.filter(f"NOT ({_MISSING})").select("app_id", F.lit(0).alias("source_idx"), F.lit("classes.dex").alias("source_file"), payload.alias("payload"))
    return people.select(F.col("app_id").alias("sha256")), came


def read_text(payload: bytes) -> str:
    import json

    return json.loads(payload)["text"]


def _scan(sources: DataFrame) -> DataFrame:
    return D.scan(sources, scanners=())[0].select("app_id", "kind", "provider", "evidence", "severity")


class Stopped(Exception):
    pass


def _dying(sources: DataFrame) -> DataFrame:
    """A scan that writes its findings and is killed before the batch's events are."""

    def fail(batches):
        for batch in batches:
            yield batch
        raise Stopped("killed")

    found = _scan(sources)
    return found.mapInArrow(fail, found.schema)


def _resumed(spark, d) -> tuple[str, DataFrame]:
    """Run 1 commits two batches, dies in the third, repeats it and stops; run 2 gets what the fold of run 1's events leaves."""
    manifest, packages = _packages(spark, d)
    folder = new_folder(spark, "runs")
    enrolled, bucket = resume.state(spark, folder, manifest), F.substring("app_id", 2, 20).cast("bigint") % 4
    resume.run(enrolled, packages, folder, 1, _scan, read_text, only=(0, 1), bucket=bucket)
    try:
        resume.run(enrolled, packages, folder, 1, _dying, read_text, only=(2,), bucket=bucket)
    except Exception as e:  # noqa: BLE001  Spark wraps what a task raised
        if "killed" not in str(e):
            raise
    resume.run(enrolled, packages, folder, 1, _scan, read_text, only=(2,), bucket=bucket)
    resume.run(resume.state(spark, folder, manifest), packages, folder, 2, _scan, read_text, bucket=bucket)
    return folder, manifest


def j7_resumed_findings(spark, d):
    """Findings after a run with a killed batch and the run that resumed it, as one clean run gives them."""
    folder, _ = _resumed(spark, d)
    return resume.findings(spark, folder, _FINDING).select("app_id", "kind", "provider", "evidence", "severity")


def j7_resumed_ledger(spark, d):
    """States and attempts after both runs: run 2 tried the failed ones again, and scanned only what run 1 hadn't."""
    folder, manifest = _resumed(spark, d)
    last = resume.events(spark, folder).groupBy("sha256").agg(F.count("*").alias("tries"), F.max_by("error", "run").alias("error"))
    return resume.state(spark, folder, manifest).join(last, "sha256", "left").groupBy("state", "attempts", "error").agg(F.count("*").alias("n"), F.max("tries").alias("most_tries"))


def j8_poisoned_packages(spark, d):
    """Packages whose reading raises: each fails alone, with the exception's name."""
    _, packages = _packages(spark, d)
    return resume.guarded(packages, read_text).select("app_id", F.md5("content").alias("digest"), "error")


_WALK = f"""{LOG}, ordered AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY moment, seq) AS i FROM log),
walk(sha256, i, moment, seq, event, before, state, attempts, failed, accepted, retried, retried_from, had) AS (
 SELECT DISTINCT sha256, 0::BIGINT, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 'pending', 0::BIGINT, NULL::TIMESTAMP, NULL::BOOLEAN, NULL::TIMESTAMP, NULL::VARCHAR, 0::BIGINT FROM log
 UNION ALL SELECT sha256, i, moment, seq, event, s, CASE WHEN NOT ok THEN s WHEN event = 'reset' THEN 'pending' ELSE event END, CASE WHEN NOT ok THEN attempts WHEN event = 'reset' THEN 0 ELSE attempts + (event LIKE '%failed')::INT END,
  CASE WHEN NOT ok THEN failed WHEN event LIKE '%failed' THEN moment END, ok, CASE WHEN back THEN failed + INTERVAL 6 HOUR END, old, attempts FROM (
   SELECT *, CASE s WHEN 'pending' THEN event IN ('downloaded', 'download_failed') WHEN 'downloaded' THEN event IN ('scanned', 'scan_failed') WHEN 'scanned' THEN false ELSE event = 'reset' END AS ok FROM (
    SELECT *, CASE WHEN back THEN 'pending' ELSE old END AS s FROM (
     SELECT o.*, w.state AS old, w.attempts, w.failed, coalesce(w.state LIKE '%failed' AND w.attempts < 3 AND o.moment >= w.failed + INTERVAL 6 HOUR, false) AS back FROM walk w JOIN ordered o ON o.sha256 = w.sha256 AND o.i = w.i + 1)))),
ends AS (SELECT sha256, max(i) AS i FROM walk GROUP BY 1), mark AS (SELECT date_trunc('millisecond', max(moment)) - INTERVAL 1 HOUR AS m FROM log),
done AS (SELECT sha256, moment, seq, event, before, state, attempts, accepted FROM walk WHERE i > 0
 UNION ALL SELECT sha256, retried, NULL, 'retry', retried_from, 'pending', had, true FROM walk WHERE retried IS NOT NULL
 UNION ALL SELECT sha256, failed + INTERVAL 6 HOUR, NULL, 'retry', state, 'pending', attempts, true FROM walk JOIN ends USING (sha256, i), mark WHERE state LIKE '%failed' AND attempts < 3 AND failed + INTERVAL 6 HOUR <= m)"""
_RESUMED = f"""people AS (SELECT 'u' || c_custkey AS app_id, {_TEXT} AS content, {_BROKEN} AS broken, {_MISSING} AS missing FROM customer),
good AS (SELECT * FROM people WHERE NOT broken AND NOT missing)"""

QUERIES = {f.__name__: f for f in (j2_state_stream, j2_state_stream_totals, j7_resumed_findings, j7_resumed_ledger, j8_poisoned_packages)}
ORACLE_SQL = {
    "j2_state_stream": f"WITH RECURSIVE {_WALK} SELECT sha256, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS moment, seq, event, before, state, attempts, accepted FROM done",
    "j2_state_stream_totals": f"""WITH RECURSIVE {_WALK}, left_in AS (SELECT sha256, arg_max(state, (moment, seq IS NOT NULL, coalesce(seq, 0))) AS state, arg_max(attempts, (moment, seq IS NOT NULL, coalesce(seq, 0))) AS attempts, count(*) FILTER (NOT accepted) AS rejected FROM done GROUP BY 1)
 SELECT state, attempts, count(*) AS n, sum(rejected)::BIGINT AS rejected FROM left_in GROUP BY ALL""",
    "j7_resumed_findings": f"""WITH {_RESUMED} SELECT app_id, 'llm_endpoint' AS kind, 'openai' AS provider, 'api.openai.com' AS evidence, 'info' AS severity FROM good WHERE contains(content, 'api.openai.com')
 UNION ALL SELECT app_id, 'llm_sdk_reference', 'anthropic', 'com/anthropic', 'info' FROM good WHERE contains(content, 'com/anthropic')""",
    "j7_resumed_ledger": f"""WITH {_RESUMED}, tried AS (SELECT CASE WHEN missing THEN 'download_failed' WHEN broken THEN 'scan_failed' ELSE 'scanned' END AS state, CASE WHEN NOT missing AND broken THEN 'JSONDecodeError' END AS error,
 CASE WHEN NOT missing AND NOT broken OR substr(app_id, 2)::BIGINT % 4 = 3 THEN 1 ELSE 2 END AS tries FROM people)
 SELECT state, CASE WHEN state = 'scanned' THEN 0 ELSE tries END::BIGINT AS attempts, error, count(*) AS n, max(tries)::BIGINT AS most_tries FROM tried GROUP BY ALL""",
    "j8_poisoned_packages": f"WITH {_RESUMED} SELECT app_id, CASE WHEN NOT broken THEN md5(content) END AS digest, CASE WHEN broken THEN 'JSONDecodeError' END AS error FROM people WHERE NOT missing",
}
