"""Thresholds, dimension lists and the fixed vocabulary of the telemetry model.

Everything that decides a number lives here so that the batch build, the
serving layer, the streaming processor and the SQL oracle read one source.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the telemetry contract exactly; they are the
# event vocabulary, the dimension names and the "no filter" spellings.
# ---------------------------------------------------------------------------

# event_type values that classify an event on their own
EVENT_TYPE_START = "VideoSessionStart"
EVENT_TYPE_PLAY = "VideoPlay"
EVENT_TYPE_BACKGROUND = "AppBackgrounded"
EVENT_TYPE_FOREGROUND = "AppForegrounded"
EVENT_TYPES_STOP = ("VideoError", "VideoSessionEnd")
EVENT_TYPE_HEARTBEAT = "VideoHeartbeat"

# lower-cased `event` tokens
EVENT_TOKENS_PLAY = ("resume", "speed-resume", "adresume")
EVENT_TOKENS_PAUSE = ("pause", "speed-pause", "adpause")

# event kinds, in the order they apply inside one millisecond
KIND_OTHER = 0
KIND_START = 1
KIND_PLAY = 2
KIND_FOREGROUND = 3
KIND_PAUSE = 4
KIND_BACKGROUND = 5
KIND_STOP = 6

# tokens a healthy extract is expected to contain (preflight vocabulary)
EXPECTED_EVENT_TYPES = (
    "VideoSessionStart", "VideoPlay", "AppBackgrounded", "AppForegrounded",
    "VideoError", "VideoSessionEnd",
)
EXPECTED_EVENTS = (
    "adpause", "adresume", "pause", "resume", "speed-pause", "speed-resume",
)

# the eight dimensions carried by every event, then the three from content
EVENT_DIMS = (
    "platform", "app_version", "country", "audio_language", "subtitle_language",
    "player_version", "content_id", "video_resolution",
)
CONTENT_DIMS = ("video_type", "category", "show_name")
DIMS = EVENT_DIMS + CONTENT_DIMS
# every dimension that is a string (content_id is numeric)
STRING_DIMS = tuple(d for d in DIMS if d != "content_id")
# column order of the served rollup
ROLLUP_DIMS = (
    "country", "platform", "video_type", "category", "app_version",
    "player_version", "audio_language", "subtitle_language", "content_id",
    "video_resolution", "show_name",
)

# values that mean "no filter on this dimension" (trimmed, any case)
NO_FILTER_SENTINELS = ("", "all", "any", "none", "null", "*", "%")

# raw event columns: required, then optional with '' default
RAW_REQUIRED = (
    "content_id", "video_session_id", "user_id", "event_type", "event",
    "event_timestamp", "platform", "app_version", "country", "audio_language",
    "subtitle_language", "player_version", "session_start_epoch",
)
RAW_OPTIONAL = ("video_resolution",)
CONTENT_REQUIRED = ("content_id", "title", "video_type", "category")
CONTENT_OPTIONAL = ("show_name",)

# plausible epoch-millisecond range for event_timestamp
MIN_EPOCH_MS = 1_000_000_000_000
MAX_EPOCH_MS = 20_000_000_000_000

# delimiters tried when a CSV header is sniffed
CSV_DELIMITERS = (",", "\t", ";", "|")

# result caps of the question surface
MAX_SERIES_POINTS = 40
TITLE_MATCHES = 10

# The eight benchmark questions (label, grain in minutes, filters)
BENCHMARKS = (
    ("day_peak_no_filter", 1440, {}),
    ("hour_peak_no_filter", 60, {}),
    ("minute_peak_no_filter", 1, {}),
    ("day_peak_platform_android_phone", 1440, {"platform": "ANDROID_PHONE"}),
    ("day_peak_platform_sony_android_tv", 1440, {"platform": "SONY_ANDROID_TV"}),
    ("day_peak_video_type_live", 1440, {"video_type": "live"}),
    ("day_peak_iphone_india", 1440, {"country": "india", "platform": "IPHONE"}),
    ("day_peak_vod_mweb", 1440, {"platform": "Mweb", "video_type": "vod"}),
)

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Thresholds:
    """Sessionization thresholds and the width of one `minute` bucket.

    ``bucket_ms`` is the width of the time bucket stored in the `minute`
    column. The telemetry profile uses real minutes; the driver-table
    profile, whose events are hours apart, uses hour buckets.
    ``chunk_ms`` is the time slice a session is split into for the
    two-level sessionizer, so one long or hot session never lands whole in
    one task. It must be a multiple of ``bucket_ms``.
    """

    gap_ms: int = 90_000
    grace_ms: int = 40_000
    bucket_ms: int = MINUTE_MS
    chunk_ms: int = DAY_MS

    def __post_init__(self) -> None:
        if self.grace_ms > self.gap_ms:
            raise ValueError("grace must not exceed gap: segments of one session would overlap")
        if self.gap_ms <= 0 or self.grace_ms <= 0 or self.bucket_ms <= 0:
            raise ValueError("thresholds must be positive")
        if self.chunk_ms % self.bucket_ms:
            raise ValueError("chunk_ms must be a multiple of bucket_ms")
        if self.chunk_ms < self.gap_ms:
            raise ValueError("chunk_ms must be at least gap_ms, so a piece crosses one chunk edge at most")

    def grain_buckets(self, grain_minutes: int) -> int:
        """Buckets per reporting grain given in minutes (at least one)."""
        return max(1, (grain_minutes * MINUTE_MS) // self.bucket_ms)

    def with_(self, **kw) -> "Thresholds":
        return replace(self, **kw)


# reference telemetry profile: 40 s heartbeats, minute buckets
TELEMETRY = Thresholds(gap_ms=90_000, grace_ms=40_000, bucket_ms=MINUTE_MS, chunk_ms=DAY_MS)
# driver tables: events hours apart, so hours play the role of minutes
DRIVER = Thresholds(gap_ms=12 * HOUR_MS, grace_ms=4 * HOUR_MS, bucket_ms=HOUR_MS, chunk_ms=2 * DAY_MS)

# threshold sweep grid (gap seconds x grace seconds) of the telemetry profile
SWEEP_GAPS_S = (60, 90, 120)
SWEEP_GRACES_S = (20, 40, 60)
