"""Detection on the literal walking samples, with expectations worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gaugewatch.operators import detect, prompts, retrieval
from gaugewatch.sources.store import PATTERN_SCHEMA

NAMES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
NORMAL = [0.1, 9.8, 0.2, 0.01, 0.02, 0.01]
ODD = [0.5, 8.5, 0.9, 0.12, 0.22, 0.11]
MIXED = [0.3, 9.0, 0.5, 0.08, 0.15, 0.07]
ANSWER = {
    "is_anomaly": True,
    "confidence": 0.85,
    "explanation": "The acc_y value of 8.5 is much lower than the expected 9.8, and acc_x and acc_z (0.5 and 0.9)"
    " are higher than in a normal or typical pattern.",
    "user_friendly_message": "Your walking pattern looks unusual.",
    "notable_deviations": ["y-axis is 13% lower", "x-axis is 5x higher"],
    "recommended_actions": ["Check the phone position"],
}


def readings(values):
    return dict(zip(NAMES, values))


@pytest.fixture(scope="module")
def samples(spark):
    schema = """query_id bigint, embedding array<double>, host_id string, activity string, ts string,
                readings map<string,double>"""
    rows = [
        (1, MIXED, "user123", "walking", "2023-01-01T12:00:00", readings(MIXED)),
        (2, NORMAL, "user123", "walking", "2023-01-01T12:00:01", readings(NORMAL)),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [
        (0, NORMAL, "user123", "walking", "", False, None, "Normal walking", None, readings(NORMAL)),
        (1, ODD, "user123", "walking", "", True, "behavioral", None, "Phone held oddly", readings(ODD)),
    ]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


@pytest.fixture(scope="module")
def found(samples, patterns):
    return retrieval.retrieve(samples, patterns)


def hit_rows(spark, *hits):
    rows = [
        (1, i + 1, i, d, "h", "walking", "", a, "behavioral" if a else None, None if a else "fine", "odd" if a else None, None)
        for i, (d, a) in enumerate(hits)
    ]
    return spark.createDataFrame(
        rows,
        """query_id bigint, rank int, pattern_id bigint, distance double, host_id string, activity string, ts string,
           is_anomaly boolean, anomaly_type string, description string, explanation string, readings map<string,double>""",
    )


def test_squared_distances(found):
    row = detect.closest_hits(found).filter("query_id = 1").first()
    assert row.min_normal_distance == pytest.approx(0.7954)
    assert row.min_anomaly_distance == pytest.approx(0.4581)


def test_verdict_of_the_mixed_walk(found):
    row = detect.rule_verdict(detect.semantic_match(found)).filter("query_id = 1").first()
    assert row.is_anomaly and row.confidence == 0.9 and row.anomaly_type is None
    assert row.explanation == "Distance to closest normal pattern (0.7954) exceeds threshold (0.7000)"


@pytest.mark.parametrize(
    "hits, strict, verdict",
    [
        ([(0.2, False), (0.8, True)], False, (True, 0.1, "behavioral", "odd")),
        ([(0.2, False), (0.8, True)], True, (False, 0.7, None, "Similar to known normal patterns.")),
        ([(0.2, False)], False, (False, 0.7, None, "Similar to known normal patterns.")),
        ([(0.3, True), (0.5, False)], False,
         (True, 0.5 / 0.7, None, "More similar to known anomaly (0.3000) than to normal pattern (0.5000)")),
        ([(0.3, True)], False,
         (True, 0.9, None, "Distance to closest normal pattern (inf) exceeds threshold (0.7000)")),
        ([], False, (True, 0.9, "unknown", "No similar patterns found in the database.")),
    ],
)
def test_rules(spark, samples, hits, strict, verdict):
    rows = hit_rows(spark, *hits) if hits else hit_rows(spark, (1.0, False)).filter("false")
    semantic = detect.semantic_match(samples.filter("query_id = 1"), rows)
    row = detect.rule_verdict(semantic, strict=strict).first()
    assert row.is_anomaly == verdict[0] and row.confidence == pytest.approx(max(0.1, verdict[1]))
    assert (row.anomaly_type, row.explanation) == verdict[2:]


def test_ties_go_to_the_lower_id(spark, samples):
    rows = hit_rows(spark, (0.5, False), (0.5, False))
    assert detect.closest_hits(samples.limit(1), rows).first().closest_normal.pattern_id == 0


def answered(spark, samples, answer):
    rows = [(1, answer)]
    return samples.join(spark.createDataFrame(rows, "query_id bigint, answer string"), "query_id")


@pytest.mark.parametrize(
    "answer, score",
    [
        (json.dumps(ANSWER), 0.85),
        ('{"is_anomaly": true, "confidence": "0.5"}', 0.5),
        ('{"is_anomaly": true, "confidence": 7}', 1.0),
        ('{"is_anomaly": true}', 0.5),
        ('{"is_anomaly": false, "confidence": 0.9}', 0.0),
        ('{"confidence": 0.9}', 0.0),
        ("clearly an ANOMALY", 0.5),
        ("all is fine", 0.0),
        ('{"is_anomaly": true, "confidence": "high"} anomaly', 0.5),
        (None, None),
    ],
)
def test_contextual_score(spark, samples, answer, score):
    assert detect.contextual_score(answered(spark, samples, answer)).first().contextual_score == score


def test_coherence_by_hand(spark, samples):
    """Three readings named, two of four numbers within 0.5 of a reading, four comparison terms."""
    told = detect.explanation_verdict(answered(spark, samples, json.dumps(ANSWER))).first()
    assert told.coherence == pytest.approx((1 + 2 / 4 + 1) / 3)
    assert told.explanation_anomaly and told.explanation_confidence == 0.85
    assert told.explanation.split("\n\n")[1:] == [
        "User-friendly explanation: Your walking pattern looks unusual.",
        "Notable deviations:\n- y-axis is 13% lower\n- x-axis is 5x higher",
        "Recommended actions:\n- Check the phone position",
    ]


def test_incoherent_explanation_is_turned_down(spark, samples):
    text = json.dumps({"is_anomaly": True, "confidence": 0.8, "explanation": "acc_x seems off at 77.5, not normal"})
    told = detect.explanation_verdict(answered(spark, samples, text)).first()
    assert told.coherence == pytest.approx((1 / 3 + 0 + 1 / 3) / 3)
    assert told.explanation_anomaly is False
    assert told.explanation_confidence == pytest.approx(0.8 * told.coherence)


def both(spark, answer, explained=None):
    rows = [(1, "contextual", answer), (1, "explanation", explained or answer)]
    return spark.createDataFrame(rows, "query_id bigint, prompt_kind string, answer string")


def test_full_detection(spark, samples, patterns):
    row = detect.detect(samples, patterns, both(spark, json.dumps(ANSWER))).orderBy("query_id").collect()
    model, rules = row
    assert model.method == "ensemble" and model.is_anomaly and model.anomaly_type == "behavioral"
    assert model.confidence == pytest.approx((0.85 + 1 - 0.7954 / 1.4) / 2)
    assert model.user_friendly_message == ANSWER["user_friendly_message"]
    assert model.notable_deviations == ANSWER["notable_deviations"]
    assert model.recommended_actions == ANSWER["recommended_actions"]
    assert [round(p.distance, 4) for p in model.similar_patterns] == [0.4581, 0.7954]
    assert [p.description for p in model.similar_patterns] == ["Phone held oddly", "Normal walking"][:2]
    assert rules.method == "rules" and rules.user_friendly_message == ""


def test_contextual_and_explanation_alone_do_not_pass_half(spark, samples, patterns):
    """0.3 + 0.2 is exactly one half, which is not above it."""
    near = samples.filter("query_id = 2")
    answer = both(spark, json.dumps(ANSWER)).withColumn("query_id", F.lit(2).cast("bigint"))
    row = detect.detect_detail(near, patterns, answer).first()
    assert row.semantic_anomaly is False and row.anomaly_score == 0.5 and row.is_anomaly is False


def test_detection_without_any_pattern(spark, samples):
    row = detect.detect(samples, spark.createDataFrame([], PATTERN_SCHEMA)).first()
    assert row.is_anomaly and row.confidence == 0.9 and row.similar_patterns == []


def test_model_call_failure_falls_back_to_rules(spark, samples, patterns, found):
    asked = prompts.contextual_prompts(found).unionByName(prompts.explanation_prompts(found))

    def broken(texts):
        raise RuntimeError("service is down")

    verdicts = detect.detect(samples, patterns, detect.ask_model(asked, broken))
    assert {r.method for r in verdicts.collect()} == {"rules"}
    reply = json.dumps(ANSWER)
    fine = detect.detect(samples, patterns, detect.ask_model(asked, lambda texts: [reply] * len(texts)))
    assert {r.method for r in fine.collect()} == {"ensemble"}


def test_deviations(samples, found):
    got = {r.name: (round(r.change_pct, 1), r.level) for r in prompts.deviations(found).filter("query_id = 1").collect()}
    assert got == {
        "acc_x": (200.0, "SIGNIFICANT"), "acc_z": (150.0, "SIGNIFICANT"), "gyro_x": (700.0, "SIGNIFICANT"),
        "gyro_y": (650.0, "SIGNIFICANT"), "gyro_z": (600.0, "SIGNIFICANT"),
    }
    text = prompts.deviation_text(found).filter("query_id = 1").first().deviation_text
    assert "- acc_x: Current 0.3000 vs Normal 0.1000 (+200.0%) [SIGNIFICANT DEVIATION]\n" in text
    assert "- Distance: 0.4581\n- Type: behavioral\n- Description: Phone held oddly\n" in text


def test_zero_normal_reading_is_significant(spark, samples):
    rows = hit_rows(spark, (0.1, False)).withColumn("readings", F.create_map(F.lit("acc_x"), F.lit(0.0)))
    got = prompts.deviations(samples.filter("query_id = 1"), rows).collect()
    assert [(r.name, r.change_pct, r.level) for r in got] == [("acc_x", None, "SIGNIFICANT")]
    text = prompts.deviation_text(samples.filter("query_id = 1"), rows).first().deviation_text
    assert "(+inf%)" in text


def test_texts_without_hits(spark, samples):
    none = hit_rows(spark, (1.0, False)).filter("false")
    for style in ("augmented", "contextual", "explanation"):
        assert prompts.hits_text(samples, none, style).first().hits_text == "No similar patterns found in the database."
    assert "No normal patterns found for comparison." in prompts.deviation_text(samples, none).first().deviation_text


def test_sample_text(samples):
    ordered = F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*map(F.lit, NORMAL)))
    rows = samples.filter("query_id = 2").withColumn("readings", ordered)
    text = prompts.sample_text(rows).first().sample_text
    assert text.startswith("Host user123 performing walking at 2023-01-01T12:00:01.\n\nSensor readings:\n\nACCELEROMETER SENSORS:\n")
    assert text.endswith("\nGYROSCOPE SENSORS:\n- gyro_x: 0.0100\n- gyro_y: 0.0200\n- gyro_z: 0.0100\n")


@pytest.mark.parametrize(
    "answer, want",
    [
        (json.dumps(ANSWER), (True, 0.85, None, ANSWER["explanation"])),
        ('{"is_anomaly": true}', (False, 0.0, None, 'Failed to parse LLM response properly. Raw response: {"is_anomaly": true}')),
        ("an Anomaly", (True, 0.5, "unknown", "Failed to parse LLM response as JSON. Raw response: an Anomaly")),
    ],
)
def test_one_shot_answers(spark, answer, want):
    df = spark.createDataFrame([(1, answer)], "query_id bigint, answer string")
    row = prompts.parse_answers(df).first()
    assert (row.is_anomaly, row.confidence, row.anomaly_type, row.explanation) == want


def test_the_closest_hit_of_a_kind_is_of_that_kind(spark, samples):
    # One id for a normal pattern and an anomaly: both lie equally near.
    rows = hit_rows(spark, (0.5, False), (0.5, True), (0.4, True)).withColumn("pattern_id", F.lit(7).cast("bigint"))
    row = detect.closest_hits(samples.limit(1), rows).first()
    assert [hit["rank"] for hit in row.hits] == [1, 2, 3]
    assert not row.closest_normal.is_anomaly and row.min_normal_distance == 0.5
    assert row.closest_anomaly.is_anomaly and row.min_anomaly_distance == 0.4
