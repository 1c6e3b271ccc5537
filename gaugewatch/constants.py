"""Values that results depend on. Kept as plain tables in their natural order."""

# Sensors that report on the station itself, not on its surroundings.
HOUSEKEEPING_SENSORS = [
    "chemsense", "metsense", "loadavg", "mem", "time", "device", "net_rx", "net_tx", "ping",
    "media", "modem", "disk_used", "disk_size", "disk_used_ratio", "service_active", "plugins",
    "wagman_fc", "wagman_cu", "wagman_enabled", "wagman_vdc", "wagman_hb", "wagman_stopping",
    "wagman_starting", "wagman_killing", "wagman_th", "wagman_comm", "wagman_uptime",
    "image_detector",
]

# Short codes used in stored readings.
SUBSYSTEM_CODES = {
    "chemsense": "cs", "metsense": "ms", "lightsense": "ls", "alphasense": "as",
    "plantower": "pt", "audio": "aud", "wagman": "wg", "microphone": "mic", "image": "img",
}
PARAMETER_CODES = {"pressure": "pres", "temperature": "temp", "humidity": "hum"}

# Codes that are written out again on load.
SUBSYSTEM_NAMES = {"cs": "chemsense", "ls": "lightsense", "ms": "metsense", "pt": "plantower"}
PARAMETER_NAMES = {"hum": "humidity", "temp": "temperature", "pres": "pressure"}

# The part that all node ids share, and the time formats.
NODE_PREFIX = "001e061"
READING_TIME = "yyyy/MM/dd HH:mm:ss"
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss"

# Columns of a wide row that are never sensors.
WIDE_ID_COLUMNS = ["hostID", "user_id", "uuid", "activity", "timestamp"]

# Substring rules, first match wins, "other" takes the rest.
LOADER_GROUPS = {
    "accelerometer": ["acc", "accel"],
    "gyroscope": ["gyro", "rotation"],
    "magnetic": ["mag", "magnetic"],
    "location": ["loc", "gps", "lat", "lng"],
    "audio": ["audio", "sound", "mic"],
    "phone_state": ["phone", "call", "screen"],
}
PROMPT_GROUPS = {
    "accelerometer": ["acc"],
    "gyroscope": ["gyro", "rot"],
    "magnetometer": ["mag"],
    "location": ["lat", "lon", "gps"],
}
EXPLAIN_GROUPS = {"accelerometer": ["acc"], "gyroscope": ["gyro"]}
PARAMETER_GROUPS = {
    "temperature": ["temp", "temperature"],
    "pressure": ["pres", "pressure"],
    "humidity": ["hum", "humidity"],
    "ir_intensity": ["ir", "ir_intensity"],
    "uv_intensity": ["uv", "uv_intensity"],
    "visible_light_intensity": ["light", "light_intensity", "visible_light_intensity"],
    "concentration": ["concentration"],
    "intensity": ["intensity"],
}

# Readings named in the explanation prompt, sensors named in the one-shot prompt.
MOTION_READINGS = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
KEY_SENSOR_TERMS = ["acc", "gyro", "mag", "rotation"]

# Detection settings.
SEMANTIC_THRESHOLD = 0.7
COHERENCE_THRESHOLD = 0.6
ENSEMBLE_WEIGHTS = {"semantic": 0.4, "contextual": 0.3, "multi_modal": 0.1, "explanation": 0.2}
COMPARISON_TERMS = [
    "normal", "typical", "usual", "average", "expected",
    "similar", "pattern", "comparable", "previous", "historical",
]
