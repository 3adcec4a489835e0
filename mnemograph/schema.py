"""Record types, fixed vocabularies and per-type metadata rules."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
STRINGS = T.ArrayType(S)

ENTRY_LOG = T.StructType(
    [
        T.StructField("id", S, False),
        T.StructField("node_type", S),
        T.StructField("content", S),
        T.StructField("source", S),
        T.StructField("metadata", S),
        T.StructField("timestamp", S),
        T.StructField("domain", S),
        T.StructField("name_key", S),
        T.StructField("subject_id", S),
        T.StructField("predicate", S),
        T.StructField("object_id", S),
        T.StructField("object_value", S),
        T.StructField("source_entry_id", S),
        T.StructField("entity_links", STRINGS),
        T.StructField("source_entry_ids", STRINGS),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("significance_weight", T.DoubleType()),
        T.StructField("relevance_score", T.DoubleType()),
        T.StructField("hot_edges", STRINGS),
        T.StructField("logic_trace", S),
        T.StructField("image_url", S),
        T.StructField("parsed_image_description", S),
        T.StructField("audio_url", S),
        T.StructField("transcription", S),
        T.StructField("entry_analysis", S),
        T.StructField("archive_summary", S),
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("summary", S),
        T.StructField("mood", S),
        T.StructField("category", S),
        T.StructField("tags", STRINGS),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType([T.StructField(n, S) for n in ("name", "type", "status", "source_id")])
            ),
        ),
        T.StructField(
            "open_loops",
            T.ArrayType(T.StructType([T.StructField(n, S) for n in ("task", "priority", "source_id")])),
        ),
    ]
)

MANIFEST = T.StructType(
    [T.StructField(n, S) for n in ("uuid", "content", "source", "timestamp", "image_file", "audio_file")]
)

LOG_LINE = T.StructType(
    [
        T.StructField("timestamp", S),
        T.StructField("jsonPayload", T.StructType([T.StructField(n, S) for n in ("level", "severity", "msg", "message", "event", "trace_id", "path")])),
        T.StructField("textPayload", S),
        T.StructField("_bad", S),
    ]
)

_ID = T.StructType([T.StructField("id", T.LongType())])
_FILE = T.StructType([T.StructField("file_id", S)])
MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("chat", _ID),
        T.StructField("from", _ID),
        T.StructField("text", S),
        T.StructField("caption", S),
        T.StructField("photo", T.ArrayType(_FILE)),
        T.StructField("voice", _FILE),
        T.StructField(
            "location",
            T.StructType(
                [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
            ),
        ),
    ]
)
CHAT_UPDATE = T.StructType(
    [
        T.StructField("update_id", T.LongType()),
        T.StructField("message", MESSAGE),
        T.StructField("edited_message", MESSAGE),
    ]
)

# The relationship vocabulary and its aliases.
PREDICATES = [
    "works_at", "prefers", "owns", "lives_in", "located_in",
    "collaborates_with", "reports_to", "manages",
]
PREDICATE_ALIASES = {
    "work_at": "works_at", "works_for": "works_at", "employed_by": "works_at",
    "moved_to": "lives_in", "relocated_to": "lives_in", "resides_in": "lives_in",
    "live_in": "lives_in", "lives_at": "lives_in",
    "located_at": "located_in", "based_in": "located_in",
    "collaborates": "collaborates_with", "collaboratesw_with": "collaborates_with",
    "manage": "manages", "reports": "reports_to",
}

# Entity types and the words accepted for each.
ENTITY_TYPES = {
    "person": ["person", "people", "human"],
    "place": ["place", "location", "city", "country", "building", "venue", "hotel", "restaurant", "room"],
    "project": ["project", "work"],
    "goal": ["goal"],
    "preference": ["preference"],
    "event": ["event", "meeting", "occasion", "celebration", "trip"],
    "milestone": ["milestone"],
    "asset": ["asset", "object", "item", "thing", "structure", "deck", "furniture"],
    "tool": ["tool"],
    "generic": ["generic"],
}

# First and second person pronouns.
PRONOUNS = [
    "i", "me", "my", "myself", "mine", "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
]

# Statuses.
PROJECT_STATUSES = ["active", "archived", "blocked", "done", "planning", "pending", "completed"]
TASK_STATUSES = ["pending", "active", "completed", "abandoned"]
ENTITY_STATUSES = {
    "Planned": ["planned", "planning", "pending", "scheduled"],
    "In-Progress": ["in-progress", "in progress", "ongoing", "active", "started"],
    "Stalled": ["stalled", "blocked", "on hold", "paused"],
    "Completed": ["completed", "done", "finished", "resolved"],
}

# Default significance weights.
WEIGHTS = {
    "log": 0.3, "query": 0.1, "question": 0.1, "fact": 0.5, "user_identity": 0.95,
    "entity": 0.55, "task": 0.7, "summary": 0.8, "relationship": 0.8,
}

# Distances and scores that decide a match.
FACT_DISTANCE = 0.25
ENTITY_DISTANCE = 0.15
TASK_DISTANCE = 0.15
QUESTION_SIMILARITY = 0.85
SIGNIFICANCE_FLOOR = 0.5
MIN_MATCH = 0.52
RRF_K = 60
HALF_LIFE_DAYS = 180.0
HOT_EDGE_SLOTS = 20
ANSWER_SOURCE = "dreamer"

# Model prices, USD per million tokens (input, output).
MODEL_PRICES = {
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-flash-8b": (0.0375, 0.15),
    "gemini-1.5-pro": (1.25, 5.00),
}
DEFAULT_MODEL = "gemini-2.5-flash"

# Weather code ranges (low, high, label).
WEATHER_CODES = [
    (0, 0, "Clear sky"), (1, 1, "Mainly clear"), (2, 2, "Partly cloudy"), (3, 3, "Overcast"),
    (45, 48, "Foggy"), (51, 55, "Drizzle"), (56, 57, "Freezing drizzle"), (61, 65, "Rain"),
    (66, 67, "Freezing rain"), (71, 77, "Snow"), (80, 82, "Rain showers"), (85, 86, "Snow showers"),
    (95, 95, "Thunderstorm"), (96, 99, "Thunderstorm with hail"),
]

# Time zone alias -> zone.
ZONES = {
    "pst": "America/Los_Angeles", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles", "pdt": "America/Los_Angeles", "los angeles": "America/Los_Angeles", "la": "America/Los_Angeles",
    "mst": "America/Denver", "mt": "America/Denver", "mountain": "America/Denver", "mdt": "America/Denver", "denver": "America/Denver",
    "cst": "America/Chicago", "ct": "America/Chicago", "central": "America/Chicago", "cdt": "America/Chicago", "chicago": "America/Chicago",
    "est": "America/New_York", "et": "America/New_York", "eastern": "America/New_York", "edt": "America/New_York", "new york": "America/New_York", "nyc": "America/New_York",
    "utc": "UTC", "gmt": "UTC", "z": "UTC",
    "jst": "Asia/Tokyo", "tokyo": "Asia/Tokyo", "japan": "Asia/Tokyo",
    "kst": "Asia/Seoul", "seoul": "Asia/Seoul", "korea": "Asia/Seoul",
    "cet": "Europe/Paris", "paris": "Europe/Paris",
    "bst": "Europe/London", "london": "Europe/London", "uk": "Europe/London",
    "ist": "Asia/Kolkata", "india": "Asia/Kolkata",
    "aest": "Australia/Sydney", "sydney": "Australia/Sydney", "aedt": "Australia/Sydney",
    "cst_china": "Asia/Shanghai", "shanghai": "Asia/Shanghai", "beijing": "Asia/Shanghai", "china": "Asia/Shanghai",
    "hkt": "Asia/Hong_Kong", "hong kong": "Asia/Hong_Kong",
    "sgt": "Asia/Singapore", "singapore": "Asia/Singapore",
}

# Unit -> (dimension, factor to the base unit, offset), base = value * factor + offset.
UNITS = {
    ("c", "celsius"): ("temperature", 1.0, 273.15),
    ("f", "fahrenheit"): ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    ("k", "kelvin"): ("temperature", 1.0, 0.0),
    ("m", "meter", "meters"): ("length", 1.0, 0.0),
    ("cm", "centimeter", "centimeters"): ("length", 0.01, 0.0),
    ("mm", "millimeter", "millimeters"): ("length", 0.001, 0.0),
    ("km", "kilometer", "kilometers"): ("length", 1000.0, 0.0),
    ("in", "inch", "inches"): ("length", 0.0254, 0.0),
    ("ft", "foot", "feet"): ("length", 0.3048, 0.0),
    ("yd", "yard", "yards"): ("length", 0.9144, 0.0),
    ("mi", "mile", "miles"): ("length", 1609.344, 0.0),
    ("g", "gram", "grams"): ("mass", 1.0, 0.0),
    ("kg", "kilogram", "kilograms"): ("mass", 1000.0, 0.0),
    ("mg", "milligram", "milligrams"): ("mass", 0.001, 0.0),
    ("lb", "pound", "pounds"): ("mass", 453.59237, 0.0),
    ("oz", "ounce", "ounces"): ("mass", 28.349523125, 0.0),
    ("b", "byte", "bytes"): ("data", 1.0, 0.0),
    ("kb", "kilobyte", "kilobytes"): ("data", 1024.0, 0.0),
    ("mb", "megabyte", "megabytes"): ("data", 1048576.0, 0.0),
    ("gb", "gigabyte", "gigabytes"): ("data", 1073741824.0, 0.0),
    ("tb", "terabyte", "terabytes"): ("data", 1099511627776.0, 0.0),
}

# Phrases that mark an explicit correction or "remember this".
OVERRIDE_MARKERS = [
    "remember that", "remember this", "store that", "store this", "save that", "save this",
    "make sure you remember", "please remember", "correct this", "correction:", "actually,",
    "actually ", "update this fact", "that's wrong", "that is wrong", "fix that",
]
OVERRIDE_PREFIXES = ["remember:", "store:", "save:", "correct:", "update:"]

# Words that mean yes.
AFFIRMATIVES = [
    "yes", "y", "yeah", "yep", "yup", "sure", "ok", "okay", "do it", "create it", "go ahead",
    "please", "absolutely",
]

# What a thought or a search result says when nothing is missing / found.
NO_GAP_WORDS = ["none", "n/a", "na", "nothing", "-", "no", "no gaps", "unknown"]
NOT_FOUND_PHRASES = [
    "no results found", "no information found", "no semantic matches found", "no entries found",
    "no queries found", "no entity found", "no wikipedia", "no definition found for",
]

# Markers of decision lines in a run log.
DECISION_MARKERS = [
    "foh: iteration decision", "foh: tool call", "foh: query completed", "foh: query started",
    "knowledge gap", "loop detected", "backoff", "forced conclusion",
]

# Argument names that hold a tool's search text.
TOOL_QUERY_KEYS = ["query", "topic", "q", "search", "entity_name"]

GAP_NOTE = "(I looked for this but found nothing.)"
GAP_NOTE_MARK = "looked for this but found nothing"
