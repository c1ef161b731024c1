"""The command-line front end over a written table."""

from conftest import SF_SMALL
from strike_analytics.__main__ import run
from strike_analytics.session import fresh_dir
from strike_analytics.sources.events import read_frames_from_events


def test_cli_endpoints(spark):
    landed = fresh_dir(spark, "cli-frames")
    read_frames_from_events(spark, SF_SMALL).write.parquet(landed)
    root = fresh_dir(spark, "cli")
    assert run(["ingest", "--frames", landed, "--root", root, "--batch-id", "1"])[0]["ingested_batch"] == "1"
    s = f"{root}/strikes"
    assert run(["health", "--strikes", s]) == [{"total_strikes": 800}]
    rows = run(["nearby", "--strikes", s, "--lat", "32.7157", "--lon", "-117.1611", "--radius", "500",
                "--minutes", "1440", "--now", "2024-01-31T00:00:00"])
    # 19 = the same query in DuckDB over the decode oracle (accepted frames only)
    assert len(rows) == 19 and all(r["distance_km"] <= 500 for r in rows)
    assert len(run(["recent", "--strikes", s, "--minutes", "1440", "--limit", "7",
                    "--now", "2024-01-31T00:00:00"])) == 7
    assert len(run(["list", "--strikes", s, "--limit", "3", "--min-lat", "30"])) == 3
    late = ["--strikes", s, "--now", "2024-01-31T12:00:00+12:00"]
    assert len(run(["latest", "--strikes", s])) == 5 and len(run(["miles", *late, "--minutes", "1440"])) == 10
    assert len(run(["hemisphere", *late, "--hours", "744"])) == 2 and len(run(["hourly", *late])) > 10
    assert run(["report", "--frames", landed])[0]["samples_processed"] == 1000
    assert run(["stats", "--strikes", s])[0]["total_strikes"] == 800
    r = run(["ingestion", "--outcomes", f"{root}/decoded"])[0]
    assert (r["total_received"], r["total_stored"], r["success_rate"]) == (1000, 800, 80.0)
