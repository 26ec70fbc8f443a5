"""peakview: foreground viewer concurrency on Spark.

Raw player telemetry becomes active playback intervals, then one row per
(session, minute bucket) with one dimension tuple, then a rollup of sessions
per (minute, dimension tuple). Every answer is a filter, a sum over the
unfiltered dimensions and a max over minutes.
"""

__version__ = "0.1.0"
