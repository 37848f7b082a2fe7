"""Table schemas, enumerations and default values of the data model."""

from pyspark.sql import types as T

# ---- fixed values: enumerations -------------------------------------------------------------
PII_TYPES = [
    "phone", "email", "person", "address", "credit_card", "ssn", "account_id",
    "employee_id", "postal_code", "username", "face", "custom", "manual", "unknown",
]
TRACKING_METHODS = ["csrt", "sam2", "manual", "none"]
STYLE_TYPES = ["blur", "pixelate", "solid_box"]
STATUSES = ["pending", "accepted", "rejected"]
EVENT_SOURCES = ["auto", "manual"]
RULE_TYPES = ["regex", "context", "allowlist", "denylist", "field_label"]
MEDIA_EXTENSIONS = [".mp4", ".mov", ".mkv", ".avi", ".webm"]

# ---- fixed values: defaults -----------------------------------------------------------------
DEFAULT_STYLE = {"type": "solid_box", "strength": 15, "color": "#000000"}
DEFAULT_THRESHOLD = 0.35
DEFAULT_OVERRIDES = {
    "phone": 0.35, "email": 0.35, "person": 0.50, "ssn": 0.35,
    "credit_card": 0.35, "account_id": 0.35, "face": 0.40,
}
DEFAULT_FPS = 30.0
MIN_BOX_CONFIDENCE = 0.25
SPARSE_FRAME_BOXES = 5
MIN_SIDE_PX = 10
LINK_GAP_MS = 4000
LINK_TOLERANCE_PX = 80
SCENE_THRESHOLD = 0.35
MOTION_THRESHOLD = 8.0
BURST_SAMPLES = 8
BOUNDARY_FRAMES = 30
REFINE_BUDGET = 300
REFINE_MINIMUM = 5
BOX_PAD = 0.20
OVERLAY_PAD = 0.15
TEMPORAL_PAD_MS = 750
MERGE_GAP_PX = 15
DRIFT_THRESHOLD = 0.82
DRIFT_FRAMES = 6
HOLD_FRAMES = 20
BLEND_EVERY = 15
BLEND_ALPHA = 0.4
CONTEXT_PX = 200
REGEX_CONFIDENCE = 0.9
CONTEXT_CONFIDENCE = 0.8
PERSON_MIN_CHARS = 4
MAX_PATTERN_CHARS = 500
MAX_SAMPLE_CHARS = 10_000
UNDO_DEPTH = 50

# ---- nested types ---------------------------------------------------------------------------
BBOX = T.StructType([T.StructField(n, T.IntegerType()) for n in "xywh"])
POLYGON = T.ArrayType(T.ArrayType(T.IntegerType()))
STYLE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("strength", T.IntegerType()),
    T.StructField("color", T.StringType()),
])
TIME_RANGE = T.StructType([
    T.StructField("start_ms", T.IntegerType()),
    T.StructField("end_ms", T.IntegerType()),
])
KEYFRAME = T.StructType([
    T.StructField("time_ms", T.IntegerType()),
    T.StructField("bbox", BBOX),
    T.StructField("polygon", POLYGON),
])
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("pii_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("extracted_text", T.StringType()),
    T.StructField("time_ranges", T.ArrayType(TIME_RANGE)),
    T.StructField("keyframes", T.ArrayType(KEYFRAME)),
    T.StructField("tracking_method", T.StringType()),
    T.StructField("redaction_style", STYLE),
    T.StructField("status", T.StringType()),
])

# ---- document schemas -----------------------------------------------------------------------
VIDEO = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("codec", T.StringType()),
    T.StructField("format", T.StringType()),
])
OUTPUT_SETTINGS = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("custom_width", T.IntegerType()),
    T.StructField("custom_height", T.IntegerType()),
    T.StructField("quality_mode", T.StringType()),
    T.StructField("crf", T.IntegerType()),
    T.StructField("bitrate_kbps", T.IntegerType()),
    T.StructField("use_hw_encoder", T.BooleanType()),
    T.StructField("use_nvenc", T.BooleanType()),
    T.StructField("container_format", T.StringType()),
    T.StructField("watermark", T.BooleanType()),
])
SCAN_SETTINGS = T.StructType([
    T.StructField("preset", T.StringType()),
    T.StructField("ocr_sample_interval", T.IntegerType()),
    T.StructField("ocr_resolution_scale", T.DoubleType()),
    T.StructField("confidence_threshold", T.DoubleType()),
    T.StructField("entity_confidence_overrides", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("detect_faces", T.BooleanType()),
    T.StructField("secure_mode", T.BooleanType()),
    T.StructField("default_redaction_style", STYLE),
])
PROJECT = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("video", VIDEO),
    T.StructField("proxy_path", T.StringType()),
    T.StructField("scan_settings", SCAN_SETTINGS),
    T.StructField("output_settings", OUTPUT_SETTINGS),
    T.StructField("events", T.ArrayType(EVENT)),
])
RULE = T.StructType([
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("context_pixels", T.IntegerType()),
    T.StructField("description", T.StringType()),
])
PRESET = T.StructType([
    T.StructField("preset_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("scan_settings", SCAN_SETTINGS),
])
PROBE = T.StructType([
    T.StructField("streams", T.ArrayType(T.StructType([
        T.StructField("codec_type", T.StringType()),
        T.StructField("r_frame_rate", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("codec_name", T.StringType()),
    ]))),
    T.StructField("format", T.StructType([
        T.StructField("duration", T.StringType()),
        T.StructField("format_name", T.StringType()),
    ])),
])
BOX = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("frame_idx", T.IntegerType()),
    T.StructField("time_ms", T.IntegerType()),
    T.StructField("box_ord", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", BBOX),
])
PROGRESS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("progress_pct", T.IntegerType()),
    T.StructField("findings", T.IntegerType()),
    T.StructField("message", T.StringType()),
])
