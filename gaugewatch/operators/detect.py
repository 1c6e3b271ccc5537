"""Verdicts per query: distance rules, model answers, the ensemble of both.

Samples carry ``query_id, embedding, host_id, activity, ts, readings``;
``retrieve`` adds their ``hits`` as an array. From there on the rules are plain
projections: no shuffle, no join. Only model answers, a table of their own, are
joined on ``query_id``. Functions that take ``(queries, hits)`` also accept
hits as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewatch.constants import (
    COHERENCE_THRESHOLD,
    COMPARISON_TERMS,
    ENSEMBLE_WEIGHTS,
    SEMANTIC_THRESHOLD,
)
from gaugewatch.functions.columns import clamp, fixed_text
from gaugewatch.operators.retrieval import attach_hits, retrieve

# Texts of verdicts and the titles of explanation sections.
NO_PATTERNS_REASON = "No similar patterns found"
NO_PATTERNS_TEXT = "No similar patterns found in the database."
DIFFERS_TEXT = "Pattern differs significantly from known normal patterns."
LIKE_ANOMALY_TEXT = "Similar to known anomaly pattern."
LIKE_NORMAL_TEXT = "Similar to known normal patterns."
NO_EXPLANATION = "No explanation provided."
SECTIONS = {
    "user_friendly_message": "User-friendly explanation:",
    "notable_deviations": "Notable deviations:",
    "recommended_actions": "Recommended actions:",
}


# --- distance rules -----------------------------------------------------------


def _story(h: Column) -> Column:
    """A hit's description, or its explanation where that is missing or empty."""
    description = h["description"]
    return F.coalesce(F.when(description != "", description), h["explanation"], F.lit(""))


def _similar(n: int) -> Column:
    return F.transform(
        F.slice("hits", 1, n),
        lambda h: F.struct(
            h["distance"].alias("distance"), h["is_anomaly"].alias("is_anomaly"),
            F.coalesce(h["activity"], F.lit("unknown")).alias("activity"), _story(h).alias("description"),
        ),
    )


def _closest(is_anomaly: bool) -> Column:
    """The hit with the least (distance, pattern_id) among normal ones or anomalies."""

    def placed(h: Column, place: Column) -> Column:
        mine = h["is_anomaly"] if is_anomaly else ~h["is_anomaly"]
        return F.when(mine, F.struct(h["distance"], h["pattern_id"], place.alias("place")))

    return F.get("hits", F.array_min(F.transform("hits", placed))["place"])


def _found(queries: DataFrame, hits: DataFrame | None) -> DataFrame:
    return queries if hits is None else attach_hits(queries, hits)


def similar_patterns(queries: DataFrame, hits: DataFrame | None = None, n: int = 3) -> DataFrame:
    return _found(queries, hits).withColumn("similar_patterns", _similar(n))


def hit_summary(queries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Add the numbers of hits, of normal ones and of anomalies."""
    anomalies = F.size(F.filter("hits", lambda h: h["is_anomaly"]))
    return _found(queries, hits).withColumns(
        {
            "n_hits": F.size("hits"),
            "normal_hits": F.size("hits") - anomalies,
            "anomaly_hits": anomalies,
        }
    )


def closest_hits(queries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Add the counts, the closest normal pattern and the closest anomaly with their distances."""
    named = hit_summary(queries, hits).withColumns(
        {"closest_normal": _closest(False), "closest_anomaly": _closest(True)}
    )
    return named.withColumns(
        {
            "min_normal_distance": F.col("closest_normal.distance"),
            "min_anomaly_distance": F.col("closest_anomaly.distance"),
        }
    )


def semantic_match(
    queries: DataFrame, hits: DataFrame | None = None, threshold: float = SEMANTIC_THRESHOLD
) -> DataFrame:
    """Is a query far from every normal pattern, or nearer to an anomaly?"""
    facts = closest_hits(queries, hits)
    normal, anomaly = F.col("min_normal_distance"), F.col("min_anomaly_distance")
    none = F.col("n_hits") == 0
    far = normal.isNull() | (normal > threshold)
    nearer = anomaly < normal
    far_text = F.concat(
        F.lit("Distance to closest normal pattern ("),
        F.coalesce(fixed_text(normal, 4), F.lit("inf")),
        F.lit(f") exceeds threshold ({threshold:.4f})"),
    )
    near_text = F.concat(
        F.lit("More similar to known anomaly ("), fixed_text(anomaly, 4),
        F.lit(") than to normal pattern ("), fixed_text(normal, 4), F.lit(")"),
    )
    reason = (
        F.when(none, NO_PATTERNS_REASON).when(far, far_text).when(nearer, near_text).otherwise("")
    )
    return facts.withColumns(
        {
            "semantic_anomaly": none | far | F.coalesce(nearer, F.lit(False)),
            "anomaly_reason": reason,
            "similar_patterns": _similar(3),
        }
    )


def _rule_columns(threshold: float, strict: bool = False) -> dict[str, Column]:
    none, far = F.col("n_hits") == 0, F.col("semantic_anomaly")
    known = F.lit(False) if strict else F.col("anomaly_hits") > 0
    normal, anomaly = F.col("min_normal_distance"), F.col("min_anomaly_distance")
    confidence = (
        F.when(none, 0.9)
        .when(far, F.coalesce(F.least(F.lit(0.9), normal / threshold), F.lit(0.9)))
        .when(known, 0.9 - anomaly)
        .otherwise(0.9 - normal)
    )
    text = (
        F.when(none, NO_PATTERNS_TEXT)
        .when(far, F.coalesce("anomaly_reason", F.lit(DIFFERS_TEXT)))
        .when(known, F.coalesce("closest_anomaly.explanation", F.lit(LIKE_ANOMALY_TEXT)))
        .otherwise(LIKE_NORMAL_TEXT)
    )
    kind = F.when(none, "unknown").when(
        ~far & known, F.coalesce("closest_anomaly.anomaly_type", F.lit("unknown"))
    )
    return {
        "is_anomaly": far | known,
        "confidence": clamp(confidence, 0.1, 0.9),
        "anomaly_type": kind,
        "explanation": text,
    }


def rule_verdict(
    semantic: DataFrame, threshold: float = SEMANTIC_THRESHOLD, strict: bool = False
) -> DataFrame:
    """The verdict without a model.

    A retrieved anomaly alone makes the verdict an anomaly, even behind a
    closer normal pattern; ``strict=True`` leaves that to the distance test.
    """
    rules = _rule_columns(threshold, strict)
    return semantic.select("query_id", *[c.alias(name) for name, c in rules.items()], "similar_patterns")


# --- model answers ---------------------------------------------------------------


def _truthy(parsed: Column, field: str) -> Column:
    """A JSON value as a truth value: false, 0, "", [] and null are false."""
    raw = F.try_variant_get(parsed, f"$.{field}", "string")
    return F.coalesce(~raw.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))


def _is_object(parsed: Column) -> Column:
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def _has(parsed: Column, field: str) -> Column:
    return F.try_variant_get(parsed, f"$.{field}", "variant").isNotNull()


def parsed_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Add the fields of a JSON answer, or what a plain text answer lets one tell.

    ``answer_kind`` is json, text (no JSON object with a usable confidence) or
    missing (NULL); only a missing answer sends the query back to the rules.
    """
    parsed = answers.withColumn("_json", F.try_parse_json(column))
    json = F.col("_json")
    number = F.try_variant_get(json, "$.confidence", "double")
    confidence = F.when(_has(json, "confidence"), number).otherwise(0.5)
    usable = _is_object(json) & confidence.isNotNull()
    parsed = parsed.withColumn(
        "answer_kind", F.when(F.col(column).isNull(), "missing").when(usable, "json").otherwise("text")
    )
    by_json, by_text = F.col("answer_kind") == "json", F.col("answer_kind") == "text"

    def listed(field: str) -> Column:
        return F.try_variant_get(json, f"$.{field}", "array<string>")

    def plain(field: str) -> Column:
        return F.try_variant_get(json, f"$.{field}", "string")

    fields = {
        "answer_anomaly": F.when(by_json, _truthy(json, "is_anomaly")).when(
            by_text, F.lower(column).contains("anomaly")
        ),
        "answer_confidence": F.when(by_json, confidence).when(by_text, 0.5),
        "answer_explanation": F.when(by_json, F.coalesce(plain("explanation"), F.lit(NO_EXPLANATION))).when(
            by_text, F.col(column)
        ),
        "answer_message": F.when(by_json, F.coalesce(plain("user_friendly_message"), F.lit(""))),
    }
    for f in ("notable_deviations", "recommended_actions"):
        fields[f"answer_{f}"] = F.when(by_json, listed(f))
        fields[f"answer_{f}_text"] = F.when(by_json & listed(f).isNull(), plain(f))
    return parsed.withColumns(fields).drop("_json")


def _without_answer(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("answer_")])


def contextual_score(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Add the model's confidence in an anomaly, 0 when it sees none; plain text gives 0.5 or 0."""
    score = F.when(F.col("answer_anomaly"), F.col("answer_confidence")).otherwise(0.0)
    parsed = parsed_answers(answers, column).withColumns(
        {
            "contextual_score": F.when(F.col("answer_kind") != "missing", clamp(score, 0.0, 1.0)),
            "contextual_explanation": F.col("answer_explanation"),
        }
    )
    return _without_answer(parsed)


def coherence_parts(text: Column, names: Column, values: Column) -> dict[str, Column]:
    """Three shares in [0, 1]: readings named, numbers that match a reading, comparisons made."""
    low = F.lower(text)
    refs = F.size(F.filter(names, lambda n: F.contains(low, n)))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)"), 1), lambda n: n.cast("double"))
    matched = F.size(
        F.filter(numbers, lambda n: F.exists(values, lambda v: F.abs(n - v) < 0.5))
    )
    terms = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in COMPARISON_TERMS), F.lit(0))
    return {
        "named_share": F.least(F.lit(1.0), refs / 3.0),
        "matched_share": F.when(F.size(numbers) > 0, matched / F.size(numbers)).otherwise(0.0),
        "compared_share": F.least(F.lit(1.0), terms / 3.0),
    }


def coherence(df: DataFrame, text: str = "explanation", readings: str = "readings") -> DataFrame:
    """How well an explanation agrees with the readings it is about."""
    known = F.coalesce(F.col(readings), F.create_map().cast("map<string,double>"))
    parts = coherence_parts(F.coalesce(text, F.lit("")), F.map_keys(known), F.map_values(known))
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return df.withColumns(parts).withColumn("coherence", total / 3.0)


def _section(title: str, items: Column, plain: Column) -> Column:
    bullets = F.when(F.size(items) > 0, F.concat(F.lit(f"{title}\n- "), F.array_join(items, "\n- ")))
    return F.coalesce(bullets, F.when(plain != "", F.concat(F.lit(f"{title} "), plain)))


def assembled_explanation(parsed: DataFrame) -> Column:
    """Explanation, message, deviations and actions as sections with blank lines between."""
    message = F.when(
        F.col("answer_message") != "",
        F.concat(F.lit(SECTIONS["user_friendly_message"] + " "), F.col("answer_message")),
    )
    extra = [
        _section(SECTIONS[f], F.col(f"answer_{f}"), F.col(f"answer_{f}_text"))
        for f in ("notable_deviations", "recommended_actions")
    ]
    return F.when(
        F.col("answer_explanation").isNotNull(),
        F.concat_ws("\n\n", F.col("answer_explanation"), message, *extra),
    )


def explanation_verdict(
    answers: DataFrame, threshold: float = COHERENCE_THRESHOLD, column: str = "answer"
) -> DataFrame:
    """Add the model's verdict, turned down when its explanation does not fit the ``readings``."""
    parsed = parsed_answers(answers, column)
    scored = coherence(parsed.withColumn("explanation", assembled_explanation(parsed)))
    held = F.col("coherence") >= threshold
    answered = F.col("answer_kind") != "missing"
    judged = scored.withColumns(
        {
            "explanation_anomaly": F.when(answered, held & F.col("answer_anomaly")),
            "explanation_confidence": F.when(held, F.col("answer_confidence")).otherwise(
                F.col("answer_confidence") * F.col("coherence")
            ),
        }
    )
    return _without_answer(judged.withColumn("coherence", F.when(answered, F.col("coherence"))))


def explanation_sections(df: DataFrame, column: str = "explanation") -> DataFrame:
    """Take the three titled sections out of an explanation again."""
    blocks = F.split(F.coalesce(column, F.lit("")), "\n\n")

    def body(title: str) -> Column:
        found = F.filter(blocks, lambda b: F.startswith(b, F.lit(title)))
        # The last section of a title counts.
        return F.trim(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(title), F.lit("")), F.lit(" \n\t"))

    def items(title: str) -> Column:
        listed = F.transform(F.split(body(title), "\n"), lambda i: F.trim(i, F.lit("- ")))
        return F.coalesce(listed, F.array().cast("array<string>"))

    return df.withColumns(
        {
            "user_friendly_message": F.coalesce(body(SECTIONS["user_friendly_message"]), F.lit("")),
            "notable_deviations": items(SECTIONS["notable_deviations"]),
            "recommended_actions": items(SECTIONS["recommended_actions"]),
        }
    )


# --- ensemble -----------------------------------------------------------------------


def ensemble(
    joined: DataFrame,
    threshold: float = SEMANTIC_THRESHOLD,
    weights: dict[str, float] = ENSEMBLE_WEIGHTS,
) -> DataFrame:
    """Weigh the three detectors; scores are NULL where an answer is missing.

    ``joined`` has the columns of ``semantic_match``, ``contextual_score`` and
    ``explanation_verdict``.
    """
    near = F.col("semantic_anomaly")
    deviates = F.col("contextual_score") > 0.5
    told = F.col("explanation_anomaly")
    both = near & deviates

    def weight(name: str, flag: Column) -> Column:
        return F.when(flag, weights[name]).when(~flag, 0.0)

    # The parts are summed in hundredths: 0.3 + 0.2 must not pass 0.5 by rounding.
    score = F.round(
        weight("semantic", near) + weight("contextual", deviates) + weight("multi_modal", both)
        + weight("explanation", told), 2,
    )
    # No normal pattern at all gives no confidence of its own.
    away = F.coalesce(F.col("min_normal_distance") / (2 * threshold), F.lit(1.0))
    by_distance = 1.0 - F.least(F.lit(1.0), away)
    base = F.col("explanation_confidence")
    anomaly = F.col("anomaly_score") > 0.5
    kind = F.coalesce("closest_anomaly.anomaly_type", F.lit("unknown"))
    return joined.withColumn("multi_modal", both).withColumn("anomaly_score", score).withColumns(
        {
            "is_anomaly": anomaly,
            "confidence": F.when(near, (base + by_distance) / 2).otherwise(base),
            "anomaly_type": F.when(anomaly, kind),
        }
    )


def answers_by_query(answers: DataFrame) -> DataFrame:
    """(query_id, prompt_kind, answer) rows as one row per query."""
    kinds = {"contextual": "contextual_answer", "explanation": "explanation_answer"}
    return answers.groupBy("query_id").agg(
        *[F.max(F.when(F.col("prompt_kind") == kind, F.col("answer"))).alias(name) for kind, name in kinds.items()]
    )


def _weighed(
    found: DataFrame, answers: DataFrame, threshold: float, coherence_threshold: float
) -> DataFrame:
    """Semantic match, both model answers and their ensemble in one row per query."""
    semantic = semantic_match(found, threshold=threshold)
    asked = semantic.join(answers_by_query(answers), "query_id", "left")
    scored = contextual_score(asked, "contextual_answer")
    told = explanation_verdict(scored, coherence_threshold, "explanation_answer")
    return ensemble(told, threshold)


def detect(
    samples: DataFrame,
    patterns: DataFrame,
    answers: DataFrame | None = None,
    k: int = 5,
    threshold: float = SEMANTIC_THRESHOLD,
    coherence_threshold: float = COHERENCE_THRESHOLD,
    **options,
) -> DataFrame:
    """The whole detection for every sample.

    ``answers`` holds (query_id, prompt_kind, answer) with the kinds
    ``contextual`` and ``explanation``. Without it, or where one of the two is
    missing, the distance rules decide; ``method`` says which way it went.
    """
    found = samples if "hits" in samples.columns else retrieve(samples, patterns, k, **options)
    rules = _rule_columns(threshold)
    no_items = F.array().cast("array<string>")
    if answers is None:
        return semantic_match(found, threshold=threshold).select(
            "query_id", *[c.alias(name) for name, c in rules.items()],
            F.lit("").alias("user_friendly_message"), no_items.alias("notable_deviations"),
            no_items.alias("recommended_actions"), "similar_patterns", F.lit("rules").alias("method"),
        )
    both = explanation_sections(_weighed(found, answers, threshold, coherence_threshold))
    by_model = F.col("contextual_score").isNotNull() & F.col("explanation_anomaly").isNotNull()

    def choose(name: str, otherwise: Column) -> Column:
        return F.when(by_model, F.col(name)).otherwise(otherwise).alias(name)

    return both.select(
        "query_id",
        *[choose(name, c) for name, c in rules.items()],
        choose("user_friendly_message", F.lit("")),
        choose("notable_deviations", no_items),
        choose("recommended_actions", no_items),
        "similar_patterns",
        F.when(by_model, "ensemble").otherwise("rules").alias("method"),
    )


def detect_detail(
    samples: DataFrame,
    patterns: DataFrame,
    answers: DataFrame,
    k: int = 5,
    threshold: float = SEMANTIC_THRESHOLD,
    coherence_threshold: float = COHERENCE_THRESHOLD,
    **options,
) -> DataFrame:
    """The intermediate results of ``detect``, one row per sample; filter it for a report."""
    found = retrieve(samples, patterns, k, **options)
    return _weighed(found, answers, threshold, coherence_threshold).select(
        "query_id", "n_hits", "normal_hits", "anomaly_hits", "min_normal_distance", "min_anomaly_distance",
        "semantic_anomaly", "anomaly_reason", "contextual_score", "multi_modal",
        "explanation_anomaly", "explanation_confidence", "coherence",
        "anomaly_score", "is_anomaly", "confidence", "anomaly_type",
    )


def ask_model(prompts: DataFrame, generate) -> DataFrame:
    """Answers from ``generate(list of prompts) -> list of texts``, batch by batch.

    If the call fails, or gives another number of texts, its prompts are asked
    one by one. A prompt that fails on its own gets a NULL answer, which the
    rules then decide, and the reason in ``error``.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            (text,) = generate([prompt])
        except Exception as error:  # noqa: BLE001 - any failure of the service means no answer
            return None, f"{type(error).__name__}: {error}"
        return text, None

    def run(batches):
        for batch in batches:
            asked = batch["prompt"].tolist()
            try:
                texts = list(generate(asked))
            except Exception:  # noqa: BLE001
                texts = []
            told = [(text, None) for text in texts] if len(texts) == len(asked) else [one(prompt) for prompt in asked]
            batch["answer"] = [text for text, _ in told]
            batch["error"] = [error for _, error in told]
            yield batch[["query_id", "prompt_kind", "answer", "error"]]

    return prompts.select("query_id", "prompt_kind", "prompt").mapInPandas(
        run, "query_id bigint, prompt_kind string, answer string, error string"
    )
