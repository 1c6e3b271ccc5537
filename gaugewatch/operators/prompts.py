"""Texts and prompts for a language model, made as columns.

Samples carry ``query_id, host_id, activity, ts, readings`` and, from
``retrieve``, ``hits``; each text is a projection over that one row. Functions
that take ``(samples, hits)`` also accept hits as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewatch.constants import (
    EXPLAIN_GROUPS,
    KEY_SENSOR_TERMS,
    MOTION_READINGS,
    PROMPT_GROUPS,
    SEMANTIC_THRESHOLD,
)
from gaugewatch.functions import texts
from gaugewatch.functions.columns import fixed_text, sensor_group
from gaugewatch.operators.clean import describe_readings, flag_range
from gaugewatch.operators.detect import _found, _story, closest_hits, hit_summary


def _or(c: Column | str, default: str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def _entries(readings: Column | str) -> Column:
    known = F.coalesce(F.col(readings) if isinstance(readings, str) else readings,
                       F.create_map().cast("map<string,double>"))
    return F.map_entries(known)


def _bullet(entry: Column) -> Column:
    return F.concat(F.lit("- "), entry["key"], F.lit(": "), fixed_text(entry["value"], 4), F.lit("\n"))


def _bullets(entries: Column) -> Column:
    return F.array_join(F.transform(entries, _bullet), "")


def _grouped(entries: Column, rules: dict[str, list[str]], ending: str) -> Column:
    def block(group: str) -> Column:
        mine = F.filter(entries, lambda e: sensor_group(e["key"], rules) == group)
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"\n{group.upper()}{ending}:\n"), _bullets(mine)))

    return F.concat_ws("", *[block(group) for group in [*rules, "other"]])


# --- samples and hits as text ----------------------------------------------------


def sample_text(df: DataFrame, style: str = "augmented") -> DataFrame:
    """A sample in words: header line, then its readings; ``style`` is
    augmented (by sensor kind), contextual (plain list) or explanation (motion kinds)."""
    where = F.concat(
        F.lit("Host "), _or("host_id", "unknown"), F.lit(" performing "), _or("activity", "unknown"), F.lit(" at ")
    )
    entries = _entries("readings")
    if style == "augmented":
        head = F.concat(where, _or("ts", ""), F.lit(".\n\n" + texts.READINGS_HEAD))
        body = _grouped(entries, PROMPT_GROUPS, " SENSORS")
    elif style == "contextual":
        head = F.concat(where, _or("ts", "unknown"), F.lit("\n" + texts.READINGS_HEAD))
        body = _bullets(entries)
    elif style == "explanation":
        head = F.concat(where, _or("ts", "unknown"), F.lit("\n\n" + texts.READINGS_HEAD))
        body = _grouped(entries, EXPLAIN_GROUPS, "")
    else:
        raise ValueError("style must be augmented, contextual or explanation")
    return df.withColumn("sample_text", F.concat(head, body))


def reading_text(df: DataFrame, sensors: DataFrame) -> DataFrame:
    """A city reading in words: what measured it, then time and value."""
    told = describe_readings(df, sensors)
    parts = F.concat(
        F.col("reading_text"), F.lit(texts.READINGS_HEAD),
        F.lit("\nTIMESTAMP SENSORS:\n- timestamp: "), _or("timestamp", "unknown"), F.lit("\n\n"),
        F.upper("parameter"), F.lit(" SENSORS:\n- "), F.col("parameter"), F.lit(": "), F.col("value"), F.lit("\n"),
    )
    return told.withColumn("sample_text", parts)


def _by_distance() -> Column:
    """The hits ordered by (distance, pattern_id); host-first ranks may differ from that."""

    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(a["distance"] < b["distance"], -1).when(a["distance"] > b["distance"], 1)
            .when(a["pattern_id"] < b["pattern_id"], -1).when(a["pattern_id"] > b["pattern_id"], 1).otherwise(0)
        )

    return F.array_sort("hits", compare)


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def _labelled(label: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"- {label}: "), text, F.lit("\n"))).otherwise("")


# Fixed values below: the labels of hit lines.
def _hit_block(h: Column, i: Column, word: str, with_readings: bool) -> Column:
    return F.concat(
        F.lit(f"{word} "), (i + 1).cast("string"), F.lit(" (Distance: "), fixed_text(h["distance"], 4), F.lit("):\n"),
        F.lit("- Activity: "), F.coalesce(h["activity"], F.lit("unknown")),
        F.lit("\n- Is Anomaly: "), _yes_no(h["is_anomaly"]), F.lit("\n"),
        _bullets(_entries(h["readings"])) if with_readings else F.lit(""),
        _labelled("Description", _story(h)), F.lit("\n"),
    )


def hits_text(samples: DataFrame, hits: DataFrame | None = None, style: str = "augmented") -> DataFrame:
    """Add the retrieved patterns in words; a fixed sentence where there are none.

    ``style`` is augmented (five hits), contextual (three, with readings) or
    explanation (the closest normal pattern and the closest anomaly).
    """
    found = _found(samples, hits)
    none = F.size("hits") == 0
    if style == "explanation":
        facts = closest_hits(found)
        text = F.when(none, texts.EMPTY_HITS).otherwise(_closest_text())
        return facts.withColumn("hits_text", text).select(*found.columns, "hits_text")
    n, word, full = {"augmented": (5, "PATTERN", False), "contextual": (3, "Pattern", True)}[style]
    first = F.slice(_by_distance(), 1, n)
    blocks = F.array_join(F.transform(first, lambda h, i: _hit_block(h, i, word, full)), "")
    if style == "augmented":
        head = F.lit(texts.HITS_HEAD)
    else:
        head = F.concat(F.lit("Retrieved "), F.size("hits").cast("string"), F.lit(" similar patterns:\n\n"))
    return found.withColumn("hits_text", F.when(none, texts.EMPTY_HITS).otherwise(F.concat(head, blocks)))


def _closest_text() -> Column:
    # Titles and labels of the two blocks.
    def block(name: str, title: str, extra: Column, story: Column) -> Column:
        h = F.col(name)
        motion = F.filter(_entries(h["readings"]), lambda e: e["key"].isin(MOTION_READINGS))
        return F.when(
            h.isNotNull(),
            F.concat(
                F.lit(f"{title}:\n- Distance: "), fixed_text(h["distance"], 4),
                F.lit("\n- Activity: "), F.coalesce(h["activity"], F.lit("unknown")), F.lit("\n"),
                extra, _bullets(motion), story,
            ),
        )

    head = F.concat(
        F.lit("Retrieved "), F.col("n_hits").cast("string"),
        F.lit(" similar patterns from the database:\n\nSummary: "),
        F.col("normal_hits").cast("string"), F.lit(" normal patterns, "),
        F.col("anomaly_hits").cast("string"), F.lit(" anomaly patterns\n\n"),
    )
    normal = block(
        "closest_normal", "CLOSEST NORMAL PATTERN", F.lit(""),
        F.concat(_labelled("Description", F.col("closest_normal.description")), F.lit("\n")),
    )
    kind = F.concat(F.lit("- Anomaly Type: "), _or("closest_anomaly.anomaly_type", "unknown"), F.lit("\n"))
    anomaly = block(
        "closest_anomaly", "CLOSEST ANOMALY PATTERN", kind,
        _labelled("Explanation", F.col("closest_anomaly.explanation")),
    )
    return F.concat_ws("", head, normal, anomaly)


# --- guidance and deviations ---------------------------------------------------------


def _anomaly_advice() -> Column:
    return F.when(
        F.col("anomaly_hits") > 0, F.format_string(texts.SOME_ANOMALIES, F.col("anomaly_hits").cast("string"))
    ).otherwise(texts.NO_ANOMALIES)


def guidance_text(samples: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Add advice for wide samples: activity, known anomalies, kinds of sensors present."""
    found = _found(samples, hits)
    names = F.map_keys(F.coalesce("readings", F.create_map().cast("map<string,double>")))

    def advice(kind: str, text: str) -> Column:
        axes = [f"{kind}_{axis}" for axis in "xyz"]
        return F.when(F.size(F.array_intersect(names, F.array(*map(F.lit, axes)))) == 3, text).otherwise("")

    text = F.concat(
        F.lit(texts.GUIDANCE_HEAD + "When analyzing this data, consider that the user is performing '"),
        _or("activity", "unknown activity"), F.lit("'.\n"), _anomaly_advice(),
        advice("acc", texts.ACCELEROMETER_ADVICE), advice("gyro", texts.GYROSCOPE_ADVICE),
    )
    return hit_summary(found).withColumn("guidance_text", text).select(*found.columns, "guidance_text")


def reading_guidance(readings: DataFrame, sensors: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Add advice for city readings: place, known anomalies, possible range, parameter."""
    found = _found(readings, hits)
    known = flag_range(hit_summary(found), sensors)
    labels = F.array_join(F.array(_or("parameter", "unknown"), _or("sensor", "unknown"), _or("subsystem", "unknown")), ", ")
    span = F.when(
        F.col("hrf_minval").isNotNull() & F.col("hrf_maxval").isNotNull(),
        F.format_string(texts.RANGE_ADVICE, F.col("hrf_minval").cast("string"), F.col("hrf_maxval").cast("string")),
    ).otherwise("")
    special = F.coalesce(
        *[F.when(F.col("parameter") == p, text) for p, text in texts.PARAMETER_ADVICE.items()], F.lit("")
    )
    text = F.concat(
        F.lit(texts.GUIDANCE_HEAD + "When analyzing this data, consider that the node "), _or("node_id", "unknown"),
        F.lit(" is defined by the following labels: "), labels, F.lit(".\n"), _anomaly_advice(),
        F.lit(texts.PLACE_ADVICE), span, special,
    )
    return known.withColumn("guidance_text", text).select(*found.columns, "guidance_text")


def _compared(hi: float, mid: float) -> Column:
    """Readings beside those of the closest normal pattern, in the sample's order.

    Both sides are maps in one row, so no join is needed. A normal reading of 0
    has no percentage and counts as significant.
    """
    normal = F.col("closest_normal.readings")

    def one(e: Column) -> Column:
        usual = F.try_element_at(normal, e["key"])
        change = F.try_divide(e["value"] - usual, usual) * 100
        away = F.coalesce(F.abs(change), F.lit(float("inf")))
        level = F.when(usual.isNotNull() & (away > hi), "SIGNIFICANT").when(
            usual.isNotNull() & (away > mid), "MODERATE"
        )
        return F.struct(
            e["key"].alias("name"), e["value"].alias("current"), usual.alias("normal"),
            change.alias("change_pct"), level.alias("level"),
        )

    return F.filter(F.transform(_entries("readings"), one), lambda d: d["level"].isNotNull())


def deviations(
    samples: DataFrame, hits: DataFrame | None = None, hi: float = 50.0, mid: float = 20.0
) -> DataFrame:
    """One row per reading that differs from the closest normal pattern by more than ``mid`` percent."""
    facts = closest_hits(samples, hits)
    return facts.select("query_id", F.inline(_compared(hi, mid)))


def deviation_text(
    samples: DataFrame, hits: DataFrame | None = None, hi: float = 50.0, mid: float = 20.0
) -> DataFrame:
    """Add the highlights paragraph: deviations, then the closest anomaly."""
    found = _found(samples, hits)

    def line(d: Column) -> Column:
        signed = F.concat(F.when(d["change_pct"] >= 0, "+").otherwise(""), fixed_text(d["change_pct"], 1))
        return F.concat(
            F.lit("- "), d["name"], F.lit(": Current "), fixed_text(d["current"], 4), F.lit(" vs Normal "),
            fixed_text(d["normal"], 4), F.lit(" ("), F.coalesce(signed, F.lit("+inf")), F.lit("%) ["), d["level"],
            F.lit(" DEVIATION]\n"),
        )

    compared = F.when(
        F.col("closest_normal").isNotNull(),
        F.concat(F.lit(texts.COMPARISON_HEAD), F.array_join(F.transform(_compared(hi, mid), line), "")),
    ).otherwise(texts.NO_COMPARISON)
    a = F.col("closest_anomaly")
    story = F.coalesce(F.when(a["explanation"] != "", a["explanation"]), a["description"], F.lit(""))
    known = F.when(
        a.isNotNull(),
        F.concat(
            F.lit(texts.KNOWN_ANOMALY_HEAD + "- Distance: "), fixed_text(a["distance"], 4),
            F.lit("\n- Type: "), F.coalesce(a["anomaly_type"], F.lit("unknown")), F.lit("\n"),
            _labelled("Description", story),
        ),
    ).otherwise("")
    told = closest_hits(found).withColumn("deviation_text", F.concat(F.lit(texts.HIGHLIGHTS_HEAD), compared, known))
    return told.select(*found.columns, "deviation_text")


# --- prompts ---------------------------------------------------------------------------


def _prompt(df: DataFrame, kind: str, task: str, sections: dict[str, str]) -> DataFrame:
    parts = [F.concat(F.lit(f"{title}:\n"), F.col(c)) if title else F.col(c) for c, title in sections.items()]
    text = F.concat_ws("\n\n", *parts, F.lit(f"TASK:\n{task}"))
    return df.select("query_id", F.lit(kind).alias("prompt_kind"), text.alias("prompt"))


def augmented_prompts(
    samples: DataFrame, hits: DataFrame | None = None, task: str = texts.AUGMENTED_TASK
) -> DataFrame:
    df = deviation_text(guidance_text(hits_text(sample_text(_found(samples, hits)))))
    sections = {
        "sample_text": "SENSOR DATA", "hits_text": "RETRIEVED CONTEXT", "guidance_text": "", "deviation_text": "",
    }
    return _prompt(df, "augmented", task, sections)


def contextual_prompts(
    samples: DataFrame, hits: DataFrame | None = None, task: str = texts.CONTEXTUAL_TASK
) -> DataFrame:
    context = F.concat(
        F.lit("Context: Host "), _or("host_id", "unknown"), F.lit(" performing "), _or("activity", "unknown"),
        F.lit("\n"),
    )
    df = hits_text(sample_text(_found(samples, hits), "contextual"), style="contextual")
    sections = {
        "sample_text": "CURRENT PATTERN", "context_text": "CONTEXT INFORMATION",
        "hits_text": "SIMILAR PATTERNS FROM DATABASE",
    }
    return _prompt(df.withColumn("context_text", context), "contextual", task, sections)


def explanation_prompts(
    samples: DataFrame, hits: DataFrame | None = None, task: str = texts.EXPLANATION_TASK
) -> DataFrame:
    df = hits_text(sample_text(_found(samples, hits), "explanation"), style="explanation")
    return _prompt(
        df, "explanation", task, {"sample_text": "CURRENT PATTERN", "hits_text": "CONTEXT FROM DATABASE"}
    )


def anomaly_prompts(
    samples: DataFrame,
    hits: DataFrame | None = None,
    threshold: float = SEMANTIC_THRESHOLD,
    task: str = texts.ONE_SHOT_TASK,
    max_sensors: int | None = None,
) -> DataFrame:
    """One prompt with sample and hits as JSON, the motion sensors (at most ``max_sensors``) and the threshold."""
    names = F.map_keys(F.coalesce("readings", F.create_map().cast("map<string,double>")))

    def is_key(n: Column) -> Column:
        hit = F.contains(F.lower(n), F.lit(KEY_SENSOR_TERMS[0]))
        for term in KEY_SENSOR_TERMS[1:]:
            hit = hit | F.contains(F.lower(n), F.lit(term))
        return hit

    found = F.filter(names, is_key)
    key_sensors = F.array_join(found if max_sensors is None else F.slice(found, 1, max_sensors), ", ")
    df = _found(samples, hits).select(
        "query_id",
        F.to_json(F.struct("host_id", "activity", "ts", "readings")).alias("sample_json"),
        F.to_json("hits").alias("hits_json"),
        F.concat(
            F.lit('The readings are from "'), _or("host_id", "unknown user"), F.lit('" doing "'),
            _or("activity", "unknown activity"), F.lit('".\nKey sensors: '), key_sensors,
            F.lit(f"\nSimilarity threshold: {threshold}"),
        ).alias("context"),
    )
    sections = {
        "sample_json": "CURRENT SENSOR DATA", "hits_json": "RETRIEVED SIMILAR PATTERNS", "context": "CONTEXT",
    }
    return _prompt(df, "one_shot", task, sections)


# What an unreadable one-shot answer turns into.
INCOMPLETE_ANSWER = "Failed to parse LLM response properly. Raw response: "
UNREADABLE_ANSWER = "Failed to parse LLM response as JSON. Raw response: "


def parse_answers(answers: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One-shot answers as columns.

    An unreadable answer is quoted whole, or cut after ``max_chars`` with dots.

    A JSON object without one of is_anomaly, confidence, explanation gives a
    default record; text that is no JSON is searched for the word anomaly.
    """
    json = F.try_parse_json("answer")
    parsed = answers.withColumn("_json", json)
    j = F.col("_json")

    def has(name: str) -> Column:
        # JSON null counts as present.
        return F.try_variant_get(j, f"$.{name}", "variant").isNotNull()

    def quoted(note: str) -> Column:
        cut_off = F.when(F.length("answer") > max_chars, F.concat(F.substring("answer", 1, max_chars), F.lit("..."))) if max_chars else F.lit(None)
        return F.concat(F.lit(note), F.coalesce(cut_off, F.col("answer")))

    complete = has("is_anomaly") & has("confidence") & has("explanation")
    text = F.col("answer")
    is_json = j.isNotNull()
    out = {
        "is_anomaly": F.when(complete, F.try_variant_get(j, "$.is_anomaly", "boolean"))
        .when(is_json, F.lit(False)).otherwise(F.lower(text).contains("anomaly")),
        "confidence": F.when(complete, F.try_variant_get(j, "$.confidence", "double"))
        .when(is_json, 0.0).otherwise(0.5),
        "anomaly_type": F.when(complete, F.try_variant_get(j, "$.anomaly_type", "string"))
        .when(~is_json, "unknown"),
        "explanation": F.when(complete, F.try_variant_get(j, "$.explanation", "string"))
        .when(is_json, quoted(INCOMPLETE_ANSWER))
        .otherwise(quoted(UNREADABLE_ANSWER)),
    }
    return parsed.select("query_id", *[c.alias(name) for name, c in out.items()])
