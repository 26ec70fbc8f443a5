"""Small hand-worked telemetry used by the tests (times in seconds from BASE)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from peakview import config as C

BASE_MS = 1_785_693_600_000  # minute aligned

EV = {
    "START": ("VideoSessionStart", "Play"),
    "PLAY": ("VideoPlay", "Play"),
    "beat": ("VideoHeartbeat", "network-activity"),
    "pause": ("VideoHeartbeat", "pause"),
    "resume": ("VideoHeartbeat", "resume"),
    "BG": ("AppBackgrounded", ""),
    "FG": ("AppForegrounded", ""),
    "END": ("VideoSessionEnd", ""),
    "ERROR": ("VideoError", ""),
}

# (events, expected intervals in seconds)
CASES = {
    1: ([("START", 0), ("beat", 40), ("beat", 80), ("pause", 90)], [(0, 90)]),
    2: ([("START", 0), ("beat", 40), ("beat", 200), ("END", 210)], [(0, 80), (200, 210)]),
    3: ([("START", 0), ("beat", 40)], [(0, 80)]),
    4: ([("START", 0), ("BG", 30), ("beat", 70), ("beat", 110)], [(0, 30)]),
    5: ([("START", 0), ("BG", 30), ("resume", 50), ("FG", 60), ("END", 70)], [(0, 30), (60, 70)]),
    6: ([("beat", 0), ("beat", 40), ("pause", 50)], [(0, 50)]),
    7: ([("START", 0), ("pause", 0), ("beat", 40)], []),
    8: ([("START", 0), ("START", 0), ("beat", 40), ("beat", 40), ("END", 44)], [(0, 44)]),
    9: ([("START", 0), ("pause", 20), ("beat", 60), ("resume", 100), ("END", 130)], [(0, 20), (100, 130)]),
    10: ([("START", 0), ("ERROR", 30), ("beat", 70), ("PLAY", 80), ("END", 100)], [(0, 30), (80, 100)]),
    11: ([("START", 0), ("beat", 90)], [(0, 130)]),
    12: ([("START", 0), ("beat", 91)], [(0, 40), (91, 131)]),
    13: ([("START", 0), ("pause", 200)], [(0, 40)]),
    14: ([("pause", 10), ("START", 20), ("END", 30)], [(20, 30)]),
    15: ([("START", 0), ("pause", 10), ("resume", 30), ("END", 50)], [(0, 10), (30, 50)]),
}

RAW_SCHEMA = (
    "video_session_id string, user_id string, event_type string, event string, t_ms bigint, "
    "session_start_ms bigint, platform string, app_version string, country string, "
    "audio_language string, subtitle_language string, player_version string, content_id bigint, "
    "video_resolution string"
)


def row(session, name, sec, content_id=1, platform="IPHONE", user="u1", audio="hin", ms=0):
    et, ev = EV[name]
    t = BASE_MS + int(sec * 1000) + ms
    return (session, user, et, ev, t, BASE_MS, platform, "4.1.0", "india", audio, "OFF", "2.0.1",
            content_id, "")


def raw_df(spark: SparkSession, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def case_rows():
    out = []
    for n, (events, _) in CASES.items():
        out += [row(f"s{n:02d}", name, sec) for name, sec in events]
    return out


def content_df(spark: SparkSession):
    return spark.createDataFrame(
        [(1, "Alpha", "live", "sport", "Show A"), (2, "Beta", "vod", "drama", "Show B"),
         (3, "Gamma", "vod", "drama", "Show C"), (4, "alpha", "live", "news", "Show D")],
        "content_id bigint, title string, video_type string, category string, show_name string")


def minute(sec) -> int:
    return (BASE_MS + int(sec * 1000)) // C.MINUTE_MS
