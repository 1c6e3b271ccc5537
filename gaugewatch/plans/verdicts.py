"""Queries over detection, prompts and feedback, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.constants import COMPARISON_TERMS, EXPLAIN_GROUPS, PROMPT_GROUPS
from gaugewatch.functions import texts
from gaugewatch.operators import clean, detect, feedback, prompts, retrieval
from gaugewatch.plans import tables as t
from gaugewatch.plans.profiles import HELD
from gaugewatch.plans.retrievals import (
    CITY_DIM,
    K,
    city_patterns,
    city_samples,
    wide_patterns,
    wide_samples,
)
from gaugewatch.plans.tables import fmt, r
from gaugewatch.session import cut, fresh_path
from gaugewatch.sources import store

THRESHOLD = t.EMBEDDING_THRESHOLD


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its hits."""
    return retrieval.retrieve(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, exclude_self=True
    )


# --- distance rules -------------------------------------------------------------------

_FACTS = """facts AS (
  SELECT query_id, count(*) AS hits, count(*) FILTER (NOT is_anomaly) AS normal_hits,
         count(*) FILTER (is_anomaly) AS anomaly_hits,
         min(distance) FILTER (NOT is_anomaly) AS min_normal, min(distance) FILTER (is_anomaly) AS min_anomaly,
         arg_min(anomaly_type, distance) FILTER (is_anomaly) AS anomaly_type,
         arg_min(explanation, distance) FILTER (is_anomaly) AS anomaly_text,
         arg_min(pattern_id, distance) FILTER (NOT is_anomaly) AS normal_id,
         arg_min(pattern_id, distance) FILTER (is_anomaly) AS anomaly_id
  FROM hits GROUP BY query_id)"""


def _semantic_cte(threshold: float) -> str:
    return f"""{_FACTS},
semantic AS (
  SELECT *, min_normal IS NULL OR min_normal > {threshold} OR coalesce(min_anomaly < min_normal, false) AS semantic_anomaly,
         CASE WHEN min_normal IS NULL OR min_normal > {threshold} THEN
                'Distance to closest normal pattern (' || coalesce({fmt('min_normal', 4)}, 'inf') ||
                ') exceeds threshold ({threshold:.4f})'
              WHEN min_anomaly < min_normal THEN 'More similar to known anomaly (' || {fmt('min_anomaly', 4)} ||
                ') than to normal pattern (' || {fmt('min_normal', 4)} || ')'
              ELSE '' END AS anomaly_reason
  FROM facts)"""


def _rules_cte(threshold: float) -> str:
    return f"""rules AS (
  SELECT query_id, semantic_anomaly OR anomaly_hits > 0 AS is_anomaly,
         greatest(0.1::double, least(0.9::double, CASE WHEN semantic_anomaly THEN coalesce(least(0.9::double, min_normal / {threshold}::double), 0.9::double)
           WHEN anomaly_hits > 0 THEN 0.9::double - min_anomaly ELSE 0.9::double - min_normal END)) AS confidence,
         CASE WHEN NOT semantic_anomaly AND anomaly_hits > 0 THEN anomaly_type END AS anomaly_type,
         CASE WHEN semantic_anomaly THEN anomaly_reason WHEN anomaly_hits > 0 THEN anomaly_text
              ELSE 'Similar to known normal patterns.' END AS explanation
  FROM semantic)"""


SEMANTIC_CTE = f"{t.HOST_FIRST}, {_semantic_cte(THRESHOLD)}"


def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = detect.hit_summary(_found(spark, sf_dir))
    return t.tidy(counted.select("query_id", F.col("n_hits").alias("hits"), "normal_hits", "anomaly_hits"))


HIT_SUMMARY = f"WITH {SEMANTIC_CTE} SELECT query_id, hits, normal_hits, anomaly_hits FROM facts"


def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.semantic_match(_found(spark, sf_dir), threshold=THRESHOLD)
    return t.tidy(
        found.select(
            "query_id", F.col("n_hits").alias("hits"), "min_normal_distance", "min_anomaly_distance",
            "semantic_anomaly", "anomaly_reason",
            F.coalesce("closest_normal.pattern_id", F.lit(-1)).alias("normal_id"),
            F.coalesce("closest_anomaly.pattern_id", F.lit(-1)).alias("anomaly_id"),
        )
    )


SEMANTIC_MATCH = f"""WITH {SEMANTIC_CTE}
SELECT query_id, hits, {r('min_normal')} AS min_normal_distance, {r('min_anomaly')} AS min_anomaly_distance,
       semantic_anomaly, anomaly_reason, coalesce(normal_id, -1) AS normal_id, coalesce(anomaly_id, -1) AS anomaly_id
FROM semantic"""


def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: retrieve, compare distances, decide by rules."""
    verdict = detect.rule_verdict(detect.semantic_match(_found(spark, sf_dir), threshold=THRESHOLD), THRESHOLD)
    return t.tidy(verdict.select("query_id", "is_anomaly", "confidence", "anomaly_type", "explanation"))


RULE_VERDICT = f"""WITH {SEMANTIC_CTE}, {_rules_cte(THRESHOLD)}
SELECT query_id, is_anomaly, {r('confidence')} AS confidence, anomaly_type, explanation FROM rules"""


def rule_verdict_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = detect.semantic_match(_found(spark, sf_dir), threshold=THRESHOLD)
    verdict = detect.rule_verdict(near, THRESHOLD, strict=True)
    return t.tidy(verdict.select("query_id", "is_anomaly", "confidence", "anomaly_type"))


RULE_VERDICT_STRICT = f"""WITH {SEMANTIC_CTE}
SELECT query_id, semantic_anomaly AS is_anomaly,
       {r(f'greatest(0.1::double, least(0.9::double, CASE WHEN semantic_anomaly THEN coalesce(least(0.9::double, min_normal / {THRESHOLD}::double), 0.9::double) ELSE 0.9::double - min_normal END))')} AS confidence,
       NULL::varchar AS anomaly_type FROM semantic"""


def similar_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = detect.similar_patterns(_found(spark, sf_dir))
    one = similar.select("query_id", F.posexplode("similar_patterns").alias("place", "p"))
    return t.tidy(one.select("query_id", "place", "p.distance", "p.is_anomaly", "p.activity", "p.description"))


SIMILAR_PATTERNS = f"""WITH {t.HOST_FIRST}
SELECT query_id, rank - 1 AS place, {r('distance')} AS distance, is_anomaly, activity,
       coalesce(description, explanation, '') AS description FROM hits WHERE rank <= 3"""


def detect_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all nodes against the stored patterns of their own node, by rules."""
    known = cut(city_patterns(spark, sf_dir))
    verdict = detect.detect(city_samples(spark, sf_dir), known)
    return t.tidy(
        verdict.select("query_id", "is_anomaly", "confidence", "anomaly_type", F.size("similar_patterns").alias("similar")), 4
    )


# Every node has at least two patterns, so no other node's patterns are needed; sf0.01 has no smaller node.
DETECT_CITY = f"""WITH {HELD}, vectors AS (
  SELECT ingest_id, node_id, holdout_position IS NOT NULL AS is_anomaly,
         list_concat([(unix_time - epoch(date_trunc('year', strptime(timestamp, '%Y/%m/%d %H:%M:%S'))))::double], vals) AS q,
         list_concat([(unix_time - epoch(date_trunc('year', strptime(timestamp, '%Y/%m/%d %H:%M:%S'))))::double],
           list_transform(vals, lambda v: v * CASE WHEN holdout_position IS NULL THEN 1.0::double
             WHEN holdout_position % 2 = 0 THEN 2.5::double ELSE 0.4::double END)) AS p
  FROM held),
tiled AS (
  SELECT *, list_transform(range(0, {CITY_DIM}), lambda i: q[(i % len(q)) + 1]) AS qe,
         list_transform(range(0, {CITY_DIM}), lambda i: p[(i % len(p)) + 1]) AS pe FROM vectors),
pairs AS (
  SELECT a.ingest_id AS query_id, b.ingest_id AS pattern_id, b.is_anomaly, 'sensor reading' AS anomaly_type,
         'x' AS explanation, list_sum(list_transform(list_zip(a.qe, b.pe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
  FROM tiled a JOIN tiled b ON a.node_id = b.node_id),
hits AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= 5),
{_semantic_cte(0.7)}, {_rules_cte(0.7)}
SELECT query_id, is_anomaly, {r('confidence', 4)} AS confidence, x.anomaly_type, least(hits, 3) AS similar
FROM rules x JOIN semantic s USING (query_id)"""


# --- model answers -------------------------------------------------------------------------


def _half(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The answers of all events to one kind of prompt, beside the readings they are about."""
    return t.event_answers(spark, sf_dir).filter(F.col("prompt_kind") == kind)


_PARSED_CTE = """
read_answers AS (
  SELECT *, coalesce(json_extract_string(j, '$.is_anomaly') = 'true', false) AS j_anomaly,
         CASE WHEN json_extract_string(j, '$.confidence') IS NULL THEN 0.5::double
              ELSE json_extract_string(j, '$.confidence')::double END AS j_confidence
  FROM (SELECT *, try_cast(answer AS json) AS j FROM answers)),
parsed_answers AS (
  SELECT *, CASE WHEN answer IS NULL THEN NULL WHEN j IS NULL THEN contains(lower(answer), 'anomaly') ELSE j_anomaly END AS said,
         CASE WHEN answer IS NULL THEN NULL WHEN j IS NULL THEN 0.5::double ELSE j_confidence END AS conf,
         CASE WHEN answer IS NULL THEN NULL WHEN j IS NULL THEN answer
              ELSE concat_ws(chr(10) || chr(10), json_extract_string(j, '$.explanation'),
                'User-friendly explanation: ' || json_extract_string(j, '$.user_friendly_message'),
                CASE json_type(j, '$.notable_deviations')
                  WHEN 'ARRAY' THEN 'Notable deviations:' || chr(10) || '- ' ||
                    array_to_string(json_extract_string(j, '$.notable_deviations[*]'), chr(10) || '- ')
                  WHEN 'VARCHAR' THEN 'Notable deviations: ' || json_extract_string(j, '$.notable_deviations') END,
                CASE json_type(j, '$.recommended_actions')
                  WHEN 'ARRAY' THEN 'Recommended actions:' || chr(10) || '- ' ||
                    array_to_string(json_extract_string(j, '$.recommended_actions[*]'), chr(10) || '- ') END)
              END AS full_text
  FROM read_answers)"""

_TERMS = " + ".join(f"contains(lower(full_text), '{term}')::int" for term in COMPARISON_TERMS)
_NAMES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
_REFS = " + ".join(f"contains(lower(full_text), '{n}')::int" for n in _NAMES)
_COHERENCE_CTE = f"""{_PARSED_CTE},
numbered AS (
  SELECT *, list_transform(regexp_extract_all(full_text, '\\d+\\.\\d+'), lambda x: x::double) AS numbers FROM parsed_answers),
cohered AS (
  SELECT *, least(1.0::double, ({_REFS}) / 3.0::double) AS named_share,
         CASE WHEN len(numbers) > 0 THEN len(list_filter(numbers, lambda n:
           len(list_filter(vals, lambda v: abs(n - v) < 0.5)) > 0)) / len(numbers)::double ELSE 0.0::double END AS matched_share,
         least(1.0::double, ({_TERMS}) / 3.0::double) AS compared_share FROM numbered),
explained AS (
  SELECT *, (named_share + matched_share + compared_share) / 3.0::double AS coherence FROM cohered)"""


def contextual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detect.contextual_score(_half(spark, sf_dir, "contextual"))
    return t.tidy(scored.select("query_id", "contextual_score"))


_CONTEXTUAL = "CASE WHEN said THEN greatest(0.0::double, least(1.0::double, conf)) WHEN NOT said THEN 0.0::double END"
CONTEXTUAL_SCORE = f"""WITH {t.VECTORS}, {t.EVENT_ANSWERS}, {_PARSED_CTE}
SELECT query_id, {r(_CONTEXTUAL)} AS contextual_score FROM parsed_answers"""


def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled explanations scored against the readings of their sample."""
    told = detect.parsed_answers(_half(spark, sf_dir, "explanation"))
    text = told.withColumn("explanation", detect.assembled_explanation(told)).filter("answer is not null")
    scored = detect.coherence(text)
    return t.tidy(scored.select("query_id", "named_share", "matched_share", "compared_share", "coherence", "explanation"))


COHERENCE = f"""WITH {t.VECTORS}, {t.EVENT_ANSWERS}, {_COHERENCE_CTE}
SELECT query_id, {r('named_share')} AS named_share, {r('matched_share')} AS matched_share,
       {r('compared_share')} AS compared_share, {r('coherence')} AS coherence, full_text AS explanation
FROM explained WHERE answer IS NOT NULL"""


def document_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents scored as explanations of the vector with their number."""
    d = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    scored = detect.coherence(
        d.join(t.vector_queries(spark, sf_dir).select("query_id", "readings"), "query_id", "left"), "text"
    )
    return t.tidy(scored.select("query_id", "named_share", "matched_share", "compared_share"))


DOCUMENT_COHERENCE = f"""WITH {t.VECTORS}, d AS (
  SELECT doc_id AS query_id, text AS full_text, coalesce(vals, []) AS vals,
         list_transform(regexp_extract_all(text, '\\d+\\.\\d+'), lambda x: x::double) AS numbers, vals IS NULL AS bare
  FROM documents LEFT JOIN vectors ON doc_id = vec_id)
SELECT query_id, CASE WHEN bare THEN 0.0::double ELSE {r(f'least(1.0::double, ({_REFS}) / 3.0::double)')} END AS named_share,
       {r('''CASE WHEN len(numbers) > 0 THEN len(list_filter(numbers, lambda n:
         len(list_filter(vals, lambda v: abs(n - v) < 0.5)) > 0)) / len(numbers)::double ELSE 0.0::double END''')} AS matched_share,
       {r(f'least(1.0::double, ({_TERMS}) / 3.0::double)')} AS compared_share FROM d"""


def explanation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect.explanation_verdict(_half(spark, sf_dir, "explanation"))
    verdict = F.coalesce(F.col("explanation_anomaly").cast("string"), F.lit("none"))
    return t.tidy(
        told.select("query_id", verdict.alias("verdict"), "explanation_confidence", "explanation")
    )


_VERDICT_CTE = f"""{_COHERENCE_CTE},
verdicts AS (
  SELECT *, CASE WHEN answer IS NOT NULL THEN said AND coherence >= 0.6 END AS exp_anomaly,
         CASE WHEN coherence >= 0.6 THEN conf ELSE conf * coherence END AS exp_confidence, {_CONTEXTUAL} AS ctx
  FROM explained)"""
EXPLANATION_VERDICT = f"""WITH {t.VECTORS}, {t.EVENT_ANSWERS}, {_VERDICT_CTE}
SELECT query_id, coalesce(exp_anomaly::varchar, 'none') AS verdict, {r('exp_confidence')} AS explanation_confidence,
       full_text AS explanation FROM verdicts"""


def explanation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect.explanation_verdict(_half(spark, sf_dir, "explanation"))
    cut_up = detect.explanation_sections(told)
    return cut_up.select(
        "query_id", "user_friendly_message",
        F.array_join("notable_deviations", "|").alias("deviations"),
        F.array_join("recommended_actions", "|").alias("actions"),
    )


EXPLANATION_SECTIONS = f"""WITH {t.VECTORS}, {t.EVENT_ANSWERS}, {_PARSED_CTE}
SELECT query_id, coalesce(json_extract_string(j, '$.user_friendly_message'), '') AS user_friendly_message,
       CASE json_type(j, '$.notable_deviations') WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$.notable_deviations[*]'), '|')
         WHEN 'VARCHAR' THEN json_extract_string(j, '$.notable_deviations') ELSE '' END AS deviations,
       CASE json_type(j, '$.recommended_actions') WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$.recommended_actions[*]'), '|')
         ELSE '' END AS actions FROM parsed_answers"""


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = detect.semantic_match(_found(spark, sf_dir), threshold=THRESHOLD)
    asked = near.join(detect.answers_by_query(t.answers(spark, sf_dir)), "query_id")
    told = detect.explanation_verdict(
        detect.contextual_score(asked, "contextual_answer"), column="explanation_answer"
    )
    both = detect.ensemble(told, THRESHOLD)
    verdict = F.coalesce(F.col("is_anomaly").cast("string"), F.lit("none"))
    return t.tidy(both.select("query_id", "anomaly_score", verdict.alias("verdict"), "confidence", "anomaly_type"))


_ENSEMBLE_CTE = f"""{SEMANTIC_CTE}, {t.ANSWERS}, {_VERDICT_CTE},
scored AS (
  SELECT s.*, v.ctx, v.exp_anomaly, v.exp_confidence, v.coherence, v.full_text, v.j,
         round(semantic_anomaly::int * 0.4::double + (ctx > 0.5)::int * 0.3::double
               + (semantic_anomaly AND ctx > 0.5)::int * 0.1::double + exp_anomaly::int * 0.2::double, 2) AS anomaly_score,
         1.0::double - least(1.0::double, coalesce(min_normal / (2 * {THRESHOLD}::double), 1.0::double)) AS by_distance
  FROM semantic s JOIN verdicts v USING (query_id)),
ensembled AS (
  SELECT *, CASE WHEN semantic_anomaly THEN (exp_confidence + by_distance) / 2 ELSE exp_confidence END AS confidence,
         CASE WHEN anomaly_score > 0.5 THEN coalesce(anomaly_type, 'unknown') END AS kind FROM scored)"""
ENSEMBLE = f"""WITH {_ENSEMBLE_CTE}
SELECT query_id, {r('anomaly_score')} AS anomaly_score, coalesce((anomaly_score > 0.5)::varchar, 'none') AS verdict,
       {r('confidence')} AS confidence, kind AS anomaly_type FROM ensembled"""


def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection with model answers; rules where an answer is missing."""
    verdict = detect.detect(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), t.answers(spark, sf_dir),
        k=K, threshold=THRESHOLD, exclude_self=True,
    )
    return t.tidy(
        verdict.select(
            "query_id", "is_anomaly", "confidence", "anomaly_type", "explanation", "user_friendly_message",
            F.array_join("notable_deviations", "|").alias("deviations"),
            F.size("similar_patterns").alias("similar"), "method",
        )
    )


DETECT_FULL = f"""WITH {_ENSEMBLE_CTE}, {_rules_cte(THRESHOLD)}
SELECT query_id, CASE WHEN ctx IS NULL THEN x.is_anomaly ELSE anomaly_score > 0.5 END AS is_anomaly,
       {r('CASE WHEN ctx IS NULL THEN x.confidence ELSE e.confidence END')} AS confidence,
       CASE WHEN ctx IS NULL THEN x.anomaly_type ELSE kind END AS anomaly_type,
       CASE WHEN ctx IS NULL THEN x.explanation ELSE full_text END AS explanation,
       coalesce(json_extract_string(j, '$.user_friendly_message'), '') AS user_friendly_message,
       CASE json_type(j, '$.notable_deviations') WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$.notable_deviations[*]'), '|')
         WHEN 'VARCHAR' THEN json_extract_string(j, '$.notable_deviations') ELSE '' END AS deviations,
       least(hits, 3) AS similar, CASE WHEN ctx IS NULL THEN 'rules' ELSE 'ensemble' END AS method
FROM ensembled e JOIN rules x USING (query_id)"""


def detect_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = detect.detect_detail(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), t.answers(spark, sf_dir),
        k=K, threshold=THRESHOLD, exclude_self=True,
    )
    return t.tidy(
        detail.select(
            "query_id", F.col("n_hits").alias("hits"), "normal_hits", "anomaly_hits", "min_normal_distance", "semantic_anomaly",
            "contextual_score", "explanation_confidence", "coherence", "anomaly_score",
        )
    )


DETECT_DETAIL = f"""WITH {_ENSEMBLE_CTE}
SELECT query_id, hits, normal_hits, anomaly_hits, {r('min_normal')} AS min_normal_distance, semantic_anomaly,
       {r('ctx')} AS contextual_score, {r('exp_confidence')} AS explanation_confidence,
       CASE WHEN ctx IS NOT NULL THEN {r('coherence')} END AS coherence, {r('anomaly_score')} AS anomaly_score FROM ensembled"""


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = prompts.parse_answers(_half(spark, sf_dir, "explanation").select("query_id", "answer").filter("answer is not null"))
    return t.tidy(told)


_COMPLETE = "json_exists(j, '$.is_anomaly') AND json_exists(j, '$.confidence') AND json_exists(j, '$.explanation')"
PARSE_ANSWERS = f"""WITH {t.VECTORS}, {t.EVENT_ANSWERS},
j AS (SELECT *, try_cast(answer AS json) AS j FROM answers WHERE answer IS NOT NULL),
c AS (SELECT *, coalesce({_COMPLETE}, false) AS complete FROM j)
SELECT query_id, CASE WHEN complete THEN json_extract_string(j, '$.is_anomaly')::boolean WHEN j IS NOT NULL THEN false
         ELSE contains(lower(answer), 'anomaly') END AS is_anomaly,
       {r('''CASE WHEN complete THEN json_extract_string(j, '$.confidence')::double WHEN j IS NOT NULL THEN 0.0::double
         ELSE 0.5::double END''')} AS confidence,
       CASE WHEN complete THEN json_extract_string(j, '$.anomaly_type') WHEN j IS NULL THEN 'unknown' END AS anomaly_type,
       CASE WHEN complete THEN json_extract_string(j, '$.explanation')
         WHEN j IS NOT NULL THEN 'Failed to parse LLM response properly. Raw response: ' || answer
         ELSE 'Failed to parse LLM response as JSON. Raw response: ' || answer END AS explanation
FROM c"""

# --- texts and prompts ------------------------------------------------------------------------


def _wide_lines(rules: dict | None, ending: str) -> str:
    """SQL for the readings of a wide row as bullet lines, by group or as one list."""

    def line(c: str) -> str:
        return f"coalesce('- {c}: ' || {fmt(c, 4)} || chr(10), '')"

    if rules is None:
        return " || ".join(line(c) for c in t.WIDE_SENSORS)
    groups = clean.column_groups(t.WIDE_SENSORS, rules)
    blocks = []
    for group, cols in groups.items():
        body = " || ".join(line(c) for c in cols)
        head = f"chr(10) || '{group.upper()}{ending}:' || chr(10)"
        blocks.append(f"CASE WHEN {body} <> '' THEN {head} || {body} ELSE '' END")
    return " || ".join(blocks)


def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_samples(spark, sf_dir)
    styles = ["augmented", "contextual", "explanation"]
    for style in styles:
        rows = prompts.sample_text(rows, style).withColumnRenamed("sample_text", style)
    return rows.select("query_id", *styles)


_WHERE = "'Host ' || hostID || ' performing ' || activity || ' at ' || timestamp"
_HEAD_A = f"{_WHERE} || '.' || chr(10) || chr(10) || 'Sensor readings:' || chr(10)"
_HEAD_C = f"{_WHERE} || chr(10) || 'Sensor readings:' || chr(10)"
_HEAD_E = f"{_WHERE} || chr(10) || chr(10) || 'Sensor readings:' || chr(10)"
SAMPLE_TEXT = f"""WITH {t.WIDE}
SELECT uuid AS query_id, {_HEAD_A} || {_wide_lines(PROMPT_GROUPS, ' SENSORS')} AS augmented,
       {_HEAD_C} || {_wide_lines(None, '')} AS contextual,
       {_HEAD_E} || {_wide_lines(EXPLAIN_GROUPS, '')} AS explanation FROM wide"""


def reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = clean.reject_unparsed(clean.normalise_readings(t.readings(spark, sf_dir)))
    return prompts.reading_text(usable, t.sensors(spark)).select("ingest_id", "sample_text")


READING_TEXT = f"""WITH {t.PARSED}, {t.SENSORS}
SELECT ingest_id, 'Host ' || node_id || ' with make ' || p.subsystem || ', model ' || coalesce(p.sensor, 'unknown') ||
       ', and sensor type ' || p.parameter || '. The units of the sensor that is measured are ' ||
       coalesce(hrf_unit, 'unknown') || '.  This measurement was at time ' || timestamp || ' ' || chr(10) || chr(10) ||
       'Sensor readings:' || chr(10) || chr(10) || 'TIMESTAMP SENSORS:' || chr(10) || '- timestamp: ' || timestamp ||
       chr(10) || chr(10) || upper(p.parameter) || ' SENSORS:' || chr(10) || '- ' || p.parameter || ': ' || value_hrf ||
       chr(10) AS sample_text
FROM parsed p LEFT JOIN sensors s USING (subsystem, sensor, parameter) WHERE len(vals) > 0"""


def hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _found(spark, sf_dir)
    styles = ["augmented", "contextual", "explanation"]
    for style in styles:
        out = prompts.hits_text(out, style=style).withColumnRenamed("hits_text", style)
    return out.select("query_id", *styles)


_NL = "chr(10)"
_VECTOR_LINES = " || ".join(f"'- {n}: ' || {fmt(f'vals[{i + 1}]', 4)} || {_NL}" for i, n in enumerate(_NAMES))
_HIT_HEAD = f"""' (Distance: ' || {fmt('distance', 4)} || '):' || {_NL} || '- Activity: ' || h.activity || {_NL} ||
         '- Is Anomaly: ' || CASE WHEN h.is_anomaly THEN 'Yes' ELSE 'No' END || {_NL}"""
_STORY = f"'- Description: ' || coalesce(h.description, h.explanation) || {_NL} || {_NL}"
_HIT_TEXT_CTE = f"""{SEMANTIC_CTE},
placed AS (
  SELECT h.*, v.vals, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS place
  FROM hits h JOIN vectors v ON h.pattern_id = v.vec_id),
told_hits AS (
  SELECT query_id, place, 'PATTERN ' || place::varchar || {_HIT_HEAD} || {_STORY} AS short,
         'Pattern ' || place::varchar || {_HIT_HEAD} || {_VECTOR_LINES} || {_STORY} AS long FROM placed h),
listed AS (
  SELECT query_id, 'Similar patterns found in the database:' || {_NL} || {_NL} || string_agg(short, '' ORDER BY place) AS augmented,
         'Retrieved ' || count(*)::varchar || ' similar patterns:' || {_NL} || {_NL} ||
         string_agg(long, '' ORDER BY place) FILTER (place <= 3) AS contextual
  FROM told_hits GROUP BY query_id),
nearest_text AS (
  SELECT f.query_id, 'Retrieved ' || hits::varchar || ' similar patterns from the database:' || {_NL} || {_NL} ||
         'Summary: ' || normal_hits::varchar || ' normal patterns, ' || anomaly_hits::varchar || ' anomaly patterns' || {_NL} || {_NL} ||
         coalesce('CLOSEST NORMAL PATTERN:' || {_NL} || '- Distance: ' || {fmt('min_normal', 4)} || {_NL} || '- Activity: ' ||
           n.activity || {_NL} || {_VECTOR_LINES.replace('vals', 'n.vals')} || '- Description: ' || n.description || {_NL} || {_NL}, '') ||
         coalesce('CLOSEST ANOMALY PATTERN:' || {_NL} || '- Distance: ' || {fmt('min_anomaly', 4)} || {_NL} || '- Activity: ' ||
           a.activity || {_NL} || '- Anomaly Type: ' || a.anomaly_type || {_NL} || {_VECTOR_LINES.replace('vals', 'a.vals')} ||
           '- Explanation: ' || a.explanation || {_NL}, '') AS explanation
  FROM facts f LEFT JOIN vectors n ON f.normal_id = n.vec_id LEFT JOIN vectors a ON f.anomaly_id = a.vec_id)"""
HITS_TEXT = f"""WITH {_HIT_TEXT_CTE}
SELECT query_id, augmented, contextual, explanation FROM listed JOIN nearest_text USING (query_id)"""


def guidance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.guidance_text(_found(spark, sf_dir)).select("query_id", "guidance_text")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SOME = texts.SOME_ANOMALIES.split("%s")
_GUIDANCE = f"""{_lit(texts.GUIDANCE_HEAD + "When analyzing this data, consider that the user is performing '")} || v.activity ||
       {_lit("'." + chr(10))} || CASE WHEN anomaly_hits > 0 THEN {_lit(_SOME[0])} || anomaly_hits::varchar || {_lit(_SOME[1])}
         ELSE {_lit(texts.NO_ANOMALIES)} END || {_lit(texts.ACCELEROMETER_ADVICE)} || {_lit(texts.GYROSCOPE_ADVICE)}"""
GUIDANCE_TEXT = f"""WITH {SEMANTIC_CTE}
SELECT query_id, {_GUIDANCE} AS guidance_text FROM facts f JOIN vectors v ON f.query_id = v.vec_id"""


def reading_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for usable readings, with the anomalies known for their own node."""
    usable = clean.reject_unparsed(t.readings(spark, sf_dir), "value_hrf")
    rows = usable.select(
        F.col("ingest_id").alias("query_id"), "node_id", "subsystem", "sensor", "parameter",
        F.col("value_hrf").alias("value"),
    )
    known = cut(city_patterns(spark, sf_dir))
    hits = retrieval.knn_same_host(city_samples(spark, sf_dir), known, K)
    told = prompts.reading_guidance(rows, t.sensors(spark), retrieval.with_patterns(hits, known))
    return told.select("query_id", F.md5("guidance_text").alias("digest"), F.length("guidance_text").cast("bigint").alias("n"))


_RANGE = texts.RANGE_ADVICE.split("%s")
_ADVICE = " ".join(f"WHEN '{p}' THEN {_lit(text)}" for p, text in texts.PARAMETER_ADVICE.items())
_DOUBLE = "CASE {0} WHEN 1e9 THEN '1.0E9' ELSE {0}::varchar END"
READING_GUIDANCE = f"""{DETECT_CITY.split(_semantic_cte(0.7))[0].rstrip().rstrip(',')}, {t.SENSORS},
counts AS (SELECT query_id, count(*) FILTER (is_anomaly) AS n FROM hits GROUP BY query_id),
texts AS (
  SELECT ingest_id AS query_id, {_lit(texts.GUIDANCE_HEAD + 'When analyzing this data, consider that the node ')} || node_id ||
         {_lit(' is defined by the following labels: ')} || p.parameter || ', ' || coalesce(p.sensor, 'unknown') || ', ' ||
         p.subsystem || {_lit('.' + chr(10))} ||
         CASE WHEN n > 0 THEN {_lit(_SOME[0])} || n::varchar || {_lit(_SOME[1])} ELSE {_lit(texts.NO_ANOMALIES)} END ||
         {_lit(texts.PLACE_ADVICE)} ||
         coalesce({_lit(_RANGE[0])} || {_DOUBLE.format('hrf_minval')} || {_lit(_RANGE[1])} || {_DOUBLE.format('hrf_maxval')} || {_lit(_RANGE[2])}, '') ||
         CASE p.parameter {_ADVICE} ELSE '' END AS text
  FROM parsed p JOIN counts c ON p.ingest_id = c.query_id LEFT JOIN sensors s USING (subsystem, sensor, parameter)
  WHERE len(vals) > 0)
SELECT query_id, md5(text) AS digest, length(text) AS n FROM texts"""


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(prompts.deviations(_found(spark, sf_dir)), 4)


_DEVIATION_CTE = f"""{SEMANTIC_CTE},
compared AS (
  SELECT f.query_id, unnest({_NAMES}) AS name, unnest(q.vals) AS current, unnest(p.vals) AS normal
  FROM facts f JOIN vectors q ON f.query_id = q.vec_id JOIN vectors p ON f.normal_id = p.vec_id),
changed AS (
  SELECT *, CASE WHEN normal <> 0 THEN (current - normal) / normal * 100 END AS change_pct FROM compared),
deviated AS (
  SELECT *, CASE WHEN change_pct IS NULL OR abs(change_pct) > 50 THEN 'SIGNIFICANT'
                 WHEN abs(change_pct) > 20 THEN 'MODERATE' END AS level FROM changed)"""
DEVIATIONS = f"""WITH {_DEVIATION_CTE}
SELECT query_id, name, {r('current', 4)} AS current, {r('normal', 4)} AS normal, {r('change_pct', 4)} AS change_pct, level
FROM deviated WHERE level IS NOT NULL"""


def deviation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.deviation_text(_found(spark, sf_dir)).select("query_id", "deviation_text")


_DEVIATION_TEXT_CTE = f"""{_DEVIATION_CTE},
lines AS (
  SELECT query_id, string_agg('- ' || name || ': Current ' || {fmt('current', 4)} || ' vs Normal ' || {fmt('normal', 4)} ||
         ' (' || coalesce(CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || {fmt('change_pct', 1)}, '+inf') || '%) [' ||
         level || ' DEVIATION]' || {_NL}, '' ORDER BY list_position({_NAMES}, name)) AS lines
  FROM deviated WHERE level IS NOT NULL GROUP BY query_id),
deviation_texts AS (
  SELECT f.query_id, {_lit(texts.HIGHLIGHTS_HEAD)} ||
         CASE WHEN normal_id IS NULL THEN {_lit(texts.NO_COMPARISON)}
              ELSE {_lit(texts.COMPARISON_HEAD)} || coalesce(lines, '') END ||
         coalesce({_lit(texts.KNOWN_ANOMALY_HEAD + '- Distance: ')} || {fmt('min_anomaly', 4)} || {_NL} || '- Type: ' ||
           anomaly_type || {_NL} || '- Description: ' || anomaly_text || {_NL}, '') AS deviation_text
  FROM facts f LEFT JOIN lines USING (query_id))"""
DEVIATION_TEXT = f"WITH {_DEVIATION_TEXT_CTE} SELECT query_id, deviation_text FROM deviation_texts"


def augmented_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.augmented_prompts(_found(spark, sf_dir))


_VEC_WHERE = "'Host ' || v.host_id || ' performing ' || v.activity || ' at '"
_VEC_GROUPS = " || ".join(
    f"{_NL} || '{kind.upper()} SENSORS:' || {_NL} || "
    + " || ".join(f"'- {n}: ' || {fmt(f'v.vals[{i + 1}]', 4)} || {_NL}" for i, n in enumerate(_NAMES) if n.startswith(short))
    for kind, short in (("accelerometer", "acc"), ("gyroscope", "gyro"))
)
_SENSOR_HEAD = f"{_NL} || {_NL} || 'Sensor readings:' || {_NL}"
AUGMENTED_PROMPTS = f"""WITH {_HIT_TEXT_CTE}, {_DEVIATION_TEXT_CTE.removeprefix(SEMANTIC_CTE).lstrip(',')}
SELECT query_id, 'augmented' AS prompt_kind,
       'SENSOR DATA:' || {_NL} || {_VEC_WHERE} || '.' || {_SENSOR_HEAD} || {_VEC_GROUPS} || {_NL} || {_NL} ||
       'RETRIEVED CONTEXT:' || {_NL} || augmented || {_NL} || {_NL} || {_GUIDANCE} || {_NL} || {_NL} || deviation_text ||
       {_NL} || {_NL} || 'TASK:' || {_NL} || {_lit(texts.AUGMENTED_TASK)} AS prompt
FROM facts f JOIN vectors v ON f.query_id = v.vec_id JOIN listed USING (query_id) JOIN deviation_texts USING (query_id)"""


def contextual_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.contextual_prompts(_found(spark, sf_dir))


_VEC_LIST = _VECTOR_LINES.replace("vals", "v.vals")
CONTEXTUAL_PROMPTS = f"""WITH {_HIT_TEXT_CTE}
SELECT query_id, 'contextual' AS prompt_kind,
       'CURRENT PATTERN:' || {_NL} || {_VEC_WHERE} || {_NL} || 'Sensor readings:' || {_NL} || {_VEC_LIST} || {_NL} || {_NL} ||
       'CONTEXT INFORMATION:' || {_NL} || 'Context: Host ' || v.host_id || ' performing ' || v.activity || {_NL} || {_NL} || {_NL} ||
       'SIMILAR PATTERNS FROM DATABASE:' || {_NL} || contextual || {_NL} || {_NL} || 'TASK:' || {_NL} ||
       {_lit(texts.CONTEXTUAL_TASK)} AS prompt
FROM listed l JOIN vectors v ON l.query_id = v.vec_id"""


def explanation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.explanation_prompts(_found(spark, sf_dir))


EXPLANATION_PROMPTS = f"""WITH {_HIT_TEXT_CTE}
SELECT query_id, 'explanation' AS prompt_kind,
       'CURRENT PATTERN:' || {_NL} || {_VEC_WHERE} || {_SENSOR_HEAD} || {_VEC_GROUPS.replace(' SENSORS:', ':')} || {_NL} || {_NL} ||
       'CONTEXT FROM DATABASE:' || {_NL} || x.explanation || {_NL} || {_NL} || 'TASK:' || {_NL} ||
       {_lit(texts.EXPLANATION_TASK)} AS prompt
FROM nearest_text x JOIN vectors v ON x.query_id = v.vec_id"""


def anomaly_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-shot prompt; compared without its JSON numbers."""
    made = prompts.anomaly_prompts(_found(spark, sf_dir), threshold=THRESHOLD)
    after = F.regexp_extract("prompt", r"(?s)(CONTEXT:\n.*)$", 1)
    hosts = F.size(F.regexp_extract_all("prompt", F.lit(r'("pattern_id":\d+)'), 1))
    return t.tidy(made.select("query_id", "prompt_kind", after.alias("ending"), hosts.alias("listed")))


ANOMALY_PROMPTS = f"""WITH {SEMANTIC_CTE}
SELECT query_id, 'one_shot' AS prompt_kind, 'CONTEXT:' || {_NL} || 'The readings are from "' || v.host_id || '" doing "' ||
       v.activity || '".' || {_NL} || 'Key sensors: {', '.join(_NAMES)}' || {_NL} || 'Similarity threshold: {THRESHOLD}' ||
       {_NL} || {_NL} || 'TASK:' || {_NL} || {_lit(texts.ONE_SHOT_TASK)} AS ending, hits AS listed
FROM facts f JOIN vectors v ON f.query_id = v.vec_id"""

# --- feedback -------------------------------------------------------------------------------------


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of events: the detector said anomaly above 20, the reviewer calls errors anomalies."""
    e = t.read(spark, sf_dir, "events").withColumnRenamed("ts", "event_ts")
    v = t.vector_queries(spark, sf_dir)
    seen = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss")
    sample = F.when(
        F.col("query_id").isNotNull(),
        F.struct(
            "host_id", "activity", seen.alias("ts"), "readings",
            F.col("embedding").cast("array<double>").alias("embedding"),
        ),
    )
    truth = F.when(F.col("event_type") != "view", F.col("event_type") == "error")
    review = F.struct(
        (F.coalesce(truth, F.lit(False)) == (F.col("value") > 20)).alias("correct"),
        truth.alias("actual_anomaly"),
        F.when(F.col("value") > 20, "technical").alias("anomaly_type"),
        F.when(F.col("event_type") == "click", "Looks fine").alias("notes"),
    )
    return e.join(v, F.col("event_id") == F.col("query_id"), "left").select(
        F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("feedback_id"),
        seen.alias("timestamp"),
        sample.alias("sample"),
        F.struct((F.col("value") > 20).alias("is_anomaly"), F.lit(0.8).alias("confidence")).alias("detection"),
        review.alias("user_feedback"),
        (F.col("event_type") == "signup").alias("processed"),
    )


_STATS = """SELECT count(*) AS total_feedback_entries,
       count(*) FILTER (value > 20 AND event_type <> 'error') AS false_positives,
       count(*) FILTER (value <= 20 AND event_type = 'error') AS false_negatives,
       count(*) FILTER (value > 20 AND event_type = 'error') AS confirmed_anomalies,
       count(*) FILTER (value <= 20 AND event_type <> 'error') AS confirmed_normals,
       max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_update FROM events"""


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is appended to a table and read again before it is counted."""
    path = fresh_path(spark, "feedback")
    store.append_feedback(feedback_rows(spark, sf_dir), path)
    return t.tidy(feedback.feedback_stats(store.read_feedback(spark, path)))


FEEDBACK_STATS = f"""WITH s AS ({_STATS})
SELECT *, {r('false_positives / total_feedback_entries * 100')} AS false_positive_rate,
       {r('false_negatives / total_feedback_entries * 100')} AS false_negative_rate,
       {r('(confirmed_anomalies + confirmed_normals) / total_feedback_entries * 100')} AS accuracy FROM s"""


def recent_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.recent_feedback(feedback_rows(spark, sf_dir)).select("feedback_id", "timestamp", "processed")


_FEEDBACK_ID = "'f' || lpad(event_id::varchar, 9, '0')"
RECENT_FEEDBACK = f"""SELECT {_FEEDBACK_ID} AS feedback_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       event_type = 'signup' AS processed FROM events ORDER BY 2 DESC, 1 LIMIT 10"""


def process_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are in the ledger already; the rest of the waiting entries becomes patterns."""
    log = feedback_rows(spark, sf_dir)
    ledger = t.read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("feedback_id")
    )
    made = feedback.process_feedback(log, ledger).patterns
    return made.select(
        "feedback_id", "host_id", "ts", "is_anomaly", "anomaly_type", "description", "explanation"
    )


PROCESS_FEEDBACK = f"""WITH {t.VECTORS}
SELECT {_FEEDBACK_ID} AS feedback_id, host_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type = 'error' AS is_anomaly,
       CASE WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'technical' ELSE 'unknown' END END AS anomaly_type,
       CASE WHEN event_type = 'click' THEN 'Looks fine' END AS description,
       CASE WHEN event_type = 'error' THEN 'Anomaly identified through user feedback' END AS explanation
FROM events JOIN vectors ON event_id = vec_id WHERE event_type IN ('click', 'error')"""


def process_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "feedback_id string")
    return feedback.process_feedback(feedback_rows(spark, sf_dir), empty).counts


PROCESS_COUNTS = """SELECT count(*) AS total, count(*) FILTER (vec_id IS NOT NULL AND event_type <> 'view') AS processed,
       count(*) FILTER (vec_id IS NULL OR event_type = 'view') AS failed
FROM events LEFT JOIN embeddings ON event_id = vec_id WHERE event_type <> 'signup'"""


def mark_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = feedback_rows(spark, sf_dir)
    empty = spark.createDataFrame([], "feedback_id string")
    done = feedback.mark_processed(log, feedback.process_feedback(log, empty).ledger)
    return done.select("feedback_id", "processed")


MARK_PROCESSED = f"""SELECT {_FEEDBACK_ID} AS feedback_id,
       event_type = 'signup' OR (vec_id IS NOT NULL AND event_type <> 'view') AS processed
FROM events LEFT JOIN embeddings ON event_id = vec_id"""


def clear_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the log and in its backup after clearing."""
    path = fresh_path(spark, "feedback")
    store.append_feedback(feedback_rows(spark, sf_dir), path)
    copy = store.clear_feedback(spark, path, "20240201000000")
    kept = store.read_feedback(spark, copy).select("timestamp", F.lit(True).alias("backup"))
    left = store.read_feedback(spark, path).select("timestamp", F.lit(False).alias("backup"))
    return kept.unionByName(left).agg(
        F.count_if("backup").alias("in_backup"),
        F.max(F.when(F.col("backup"), F.col("timestamp"))).alias("last"),
        F.count_if(~F.col("backup")).alias("in_log"),
    )


CLEAR_FEEDBACK = """SELECT count(*) AS in_backup, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last, 0::bigint AS in_log FROM events"""


def detect_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders against finished orders of the same customer, with fill-up from all others."""
    samples = wide_samples(spark, sf_dir).filter(F.col("status") != "F").drop("status")
    verdict = detect.detect(samples, cut(wide_patterns(spark, sf_dir)), threshold=500.0)
    return t.tidy(
        verdict.select("query_id", "is_anomaly", "confidence", "anomaly_type", F.size("similar_patterns").alias("similar"))
    )


_FAR = "list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DETECT_WIDE = f"""WITH {t.WIDE_EMBEDDED},
q AS (SELECT uuid AS query_id, hostID AS own_host, embedding FROM embedded WHERE status <> 'F'),
p AS (
  SELECT uuid AS pattern_id, hostID AS host_id, embedding, activity = '1-URGENT' AS is_anomaly,
         CASE WHEN activity = '1-URGENT' THEN 'behavioral' END AS anomaly_type,
         CASE WHEN activity = '1-URGENT' THEN 'Urgent order of ' || hostID END AS explanation
  FROM embedded WHERE status = 'F'),
own AS (
  SELECT *, 0 AS general, {_FAR} AS distance FROM q JOIN p ON own_host = host_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= 5),
lacking AS (
  SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM own GROUP BY query_id HAVING count(*) >= 2)),
near AS (
  SELECT *, 1 AS general, {_FAR.replace('q.', 'l.')} AS distance FROM lacking l CROSS JOIN p
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= 5),
hits AS (
  SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM near WHERE host_id <> own_host)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY general, distance, pattern_id) <= 5),
{_semantic_cte(500.0)}, {_rules_cte(500.0)}
SELECT query_id, is_anomaly, {r('confidence')} AS confidence, x.anomaly_type, least(hits, 3) AS similar
FROM rules x JOIN semantic s USING (query_id)"""

QUERIES = {
    "hit_summary": (hit_summary, HIT_SUMMARY),
    "semantic_match": (semantic_match, SEMANTIC_MATCH),
    "rule_verdict": (rule_verdict, RULE_VERDICT),
    "rule_verdict_strict": (rule_verdict_strict, RULE_VERDICT_STRICT),
    "similar_patterns": (similar_patterns, SIMILAR_PATTERNS),
    "detect_city": (detect_city, DETECT_CITY),
    "detect_wide": (detect_wide, DETECT_WIDE),
    "contextual_score": (contextual_score, CONTEXTUAL_SCORE),
    "coherence": (coherence, COHERENCE),
    "document_coherence": (document_coherence, DOCUMENT_COHERENCE),
    "explanation_verdict": (explanation_verdict, EXPLANATION_VERDICT),
    "explanation_sections": (explanation_sections, EXPLANATION_SECTIONS),
    "ensemble": (ensemble, ENSEMBLE),
    "detect": (detect_full, DETECT_FULL),
    "detect_detail": (detect_detail, DETECT_DETAIL),
    "parse_answers": (parse_answers, PARSE_ANSWERS),
    "sample_text": (sample_text, SAMPLE_TEXT),
    "reading_text": (reading_text, READING_TEXT),
    "hits_text": (hits_text, HITS_TEXT),
    "guidance_text": (guidance_text, GUIDANCE_TEXT),
    "reading_guidance": (reading_guidance, READING_GUIDANCE),
    "deviations": (deviations, DEVIATIONS),
    "deviation_text": (deviation_text, DEVIATION_TEXT),
    "augmented_prompts": (augmented_prompts, AUGMENTED_PROMPTS),
    "contextual_prompts": (contextual_prompts, CONTEXTUAL_PROMPTS),
    "explanation_prompts": (explanation_prompts, EXPLANATION_PROMPTS),
    "anomaly_prompts": (anomaly_prompts, ANOMALY_PROMPTS),
    "feedback_stats": (feedback_stats, FEEDBACK_STATS),
    "recent_feedback": (recent_feedback, RECENT_FEEDBACK),
    "process_feedback": (process_feedback, PROCESS_FEEDBACK),
    "process_counts": (process_counts, PROCESS_COUNTS),
    "mark_processed": (mark_processed, MARK_PROCESSED),
    "clear_feedback": (clear_feedback, CLEAR_FEEDBACK),
}
