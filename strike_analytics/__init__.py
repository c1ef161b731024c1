"""strike_analytics: geolocated strike events on Spark.

Public entry points (all DataFrame -> DataFrame unless noted):

* decode:     ``decode_frames``, ``accepted_strikes``, ``outcomes``, ``reject_counts``
* queries:    ``list_strikes``, ``recent_strikes``, ``nearby_strikes``,
              ``latest_strikes``, ``nearest_strikes_miles``, ``nearest_strikes``, ``page_of_strikes``
* roll-ups:   ``strike_stats``, ``strike_count``, ``hemisphere_activity``, ``hourly_activity``
* reports:    ``ingestion_stats``, ``ingest_progress``, ``decode_report``
* I/O:        ``read_frames``, ``frames_from_kafka``, ``read_kafka``, ``read_strikes``,
              ``read_outcomes``, ``write_strikes``, ``ingest_batch``, ``compact``, ``retire``,
              ``read_hourly``, ``read_counters``, ``runs_of``
* streaming:  ``start_ingest``, ``decode_report_stream``; roll-ups of the written tables
              ``hourly_rollup_stream``, ``ingestion_rollup_stream``, ``progress_rollup_stream``
              with ``hourly_activity_of``, ``ingestion_stats_of``, ``progress_of``, ``settled``;
              the progress log's lines as they come: ``streaming.progress.progress_line_stream``
* columns:    ``haversine_km``, ``equirect_miles``, ``search_box``, ``pct``, ``py_round``
"""

from .functions.geo import equirect_miles, haversine_km, search_box
from .functions.numeric import pct, py_round
from .operators.aggregates import hemisphere_activity, hourly_activity, strike_count, strike_stats
from .operators.decode import accepted_strikes, decode_frames, outcomes, reject_counts
from .operators.ingest_stats import decode_report, ingest_progress, ingestion_stats
from .operators.queries import (latest_strikes, list_strikes, nearby_strikes, nearest_strikes,
                                nearest_strikes_miles, page_of_strikes, recent_strikes)
from .sources.commits import runs_of
from .sources.tables import (compact, frames_from_kafka, ingest_batch, read_counters, read_frames, read_hourly,
                             read_kafka, read_outcomes, read_strikes, retire, write_strikes)
from .streaming.continuous import (decode_report_stream, hourly_activity_of, hourly_rollup_stream,
                                   ingestion_rollup_stream, ingestion_stats_of, progress_of,
                                   progress_rollup_stream, settled, start_ingest)

__all__ = [
    "accepted_strikes", "compact", "decode_frames", "decode_report", "decode_report_stream", "equirect_miles",
    "frames_from_kafka",
    "haversine_km", "hemisphere_activity", "hourly_activity", "hourly_activity_of", "hourly_rollup_stream",
    "ingest_batch", "ingest_progress", "ingestion_rollup_stream", "ingestion_stats", "ingestion_stats_of",
    "latest_strikes", "list_strikes", "nearby_strikes", "nearest_strikes", "nearest_strikes_miles", "outcomes",
    "page_of_strikes", "pct", "progress_of", "progress_rollup_stream", "py_round", "read_counters", "read_frames", "read_hourly",
    "read_kafka", "read_outcomes", "read_strikes", "recent_strikes", "reject_counts", "retire", "runs_of",
    "search_box", "settled", "start_ingest", "strike_count", "strike_stats", "write_strikes",
]
