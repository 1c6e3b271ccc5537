"""Wording of prompts. Line formats are fixed values; the instructions are defaults."""

# Lines that describe samples, hits and deviations.
EMPTY_HITS = "No similar patterns found in the database."
READINGS_HEAD = "Sensor readings:\n"
HITS_HEAD = "Similar patterns found in the database:\n\n"
GUIDANCE_HEAD = "ANALYSIS GUIDANCE:\n\n"
SOME_ANOMALIES = (
    "There are %s similar anomalous patterns in the database.\n"
    "Pay special attention to these patterns when making your assessment.\n"
)
NO_ANOMALIES = (
    "No similar anomalies found in the database.\n"
    "Focus on detecting deviations from the normal patterns.\n"
)
ACCELEROMETER_ADVICE = (
    "\nFor accelerometer data:\n"
    "- Normal walking typically shows y-axis values around 9.8 (gravity)\n"
    "- Sudden changes in x or z axis may indicate unusual movements\n"
)
GYROSCOPE_ADVICE = (
    "\nFor gyroscope data:\n"
    "- High values indicate rapid rotation\n"
    "- Normal activities have consistent patterns in gyroscope readings\n"
)
HIGHLIGHTS_HEAD = "KEY PATTERNS AND POTENTIAL ANOMALIES:\n\n"
COMPARISON_HEAD = "Comparison with closest normal pattern:\n"
NO_COMPARISON = "No normal patterns found for comparison.\n"
KNOWN_ANOMALY_HEAD = "\nSimilarity to known anomaly:\n"
RANGE_ADVICE = (
    "for the given sensor, the minimal value possible to be measured should be %s"
    " and the maximum value possible to be measured should be %s.\n"
)

# Defaults: advice on a city's stations. Pass other texts for another place.
PLACE_ADVICE = (
    "The readings come from street stations in one city; take its climate into account.\n"
    "A reading has a subsystem, a sensor and a parameter, and the parameter says what is measured.\n"
    "Do not compare with a retrieved pattern of another parameter.\n"
)
PARAMETER_ADVICE = {
    "temperature": "\nFor temperature data:\n- Street temperatures mostly lie between 0 C in winter and 30 C in summer.\n",
    "pressure": "\nFor pressure data:\n- Air pressure changes with weather and height; about 1000 hPa is usual at sea level.\n",
    "humidity": "\nFor humidity data:\n- Relative humidity lies between 0 and 100 % and is mostly lower in cold weather.\n",
}

# Defaults: what the model is asked to do.
AUGMENTED_TASK = (
    "Decide from the above whether the current readings are an anomaly. Answer with one JSON object:\n"
    '- "is_anomaly": true or false\n'
    '- "confidence": 0.0 to 1.0\n'
    '- "anomaly_type": "behavioral", "technical" or "unknown" for an anomaly\n'
    '- "explanation": what the decision rests on\n'
    '- "user_friendly_message": the same in plain words\n'
    '- "notable_deviations": list of sensors with unusual readings\n'
    '- "recommended_actions": list of next steps\n'
)
CONTEXTUAL_TASK = (
    "Say whether the current readings deviate from what the context and the similar patterns suggest."
    " Answer with one JSON object:\n"
    '1. "is_anomaly": true or false\n'
    '2. "confidence": 0.0 to 1.0\n'
    '3. "explanation": what deviates, and by how much\n'
)
EXPLANATION_TASK = (
    "Say whether the current readings are an anomaly in this context. The decision only counts if the"
    " explanation names the readings and fits the data. Answer with one JSON object:\n"
    '1. "is_anomaly": true or false\n'
    '2. "confidence": 0.0 to 1.0\n'
    '3. "explanation": readings that are unusual or normal, and why\n'
    '4. "user_friendly_message": the same in plain words\n'
    '5. "notable_deviations": list of sensors with unusual readings\n'
    '6. "recommended_actions": list of next steps\n'
)
ONE_SHOT_TASK = (
    "Compare the current readings with the retrieved patterns. Distances above the threshold, closeness"
    " to known anomalies and large deviations all point to an anomaly. Answer with one JSON object:\n"
    '- "is_anomaly": true or false\n'
    '- "confidence": 0.0 to 1.0\n'
    '- "anomaly_type": "behavioral", "technical" or "unknown" for an anomaly\n'
    '- "explanation": what the decision rests on\n'
    '- "user_friendly_message": the same without technical terms\n'
    '- "notable_deviations": sensors with unusual readings and how they differ\n'
    '- "recommended_actions": what to do next\n'
)
