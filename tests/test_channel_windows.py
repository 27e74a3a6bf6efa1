from datetime import datetime, timedelta

from phaseloom.plans import catalog


def test_single_channel_queries_keep_windows_that_other_channels_lack(spark, tmp_path):
    at = datetime(2024, 1, 1)
    users = [0] * 40 + [1] * 17  # six channels have no samples at all
    rows = [(i, at + timedelta(minutes=i), u, "view", float(i * i % 7)) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {(0, 0), (1, 0), (0, 1)}
    for name in ("q14_lempel_ziv", "q1_analytic_signal", "v1_phase_randomize", "v2_adjusted_surrogates"):
        got = catalog.queries()[name](spark, str(tmp_path)).select("w", "channel").distinct().collect()
        assert {tuple(r) for r in got} == want, name
