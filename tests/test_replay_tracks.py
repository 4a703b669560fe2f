"""Replays hold the positions of their tracks, in the order of frames."""

from touchline.operators import tracking as TR


def test_positions_by_track_and_frame(spark):
    points = spark.createDataFrame(
        [("c", "c:1", 7, 0.7, 0.3, 0.4), ("c", "c:1", 2, None, 0.1, 0.2), ("c", "c:2", 9, 0.9, None, 0.5), ("c", "c:2", 4, 0.4, 0.5, 0.6), ("c", "c:3", 12, 1.2, 0.5, None), ("d", "d:1", 0, 0.0, 1.0, 0.0)],
        "clip_id string, track_id string, frame_index int, time_seconds double, x double, y double")
    classes = spark.createDataFrame([("c", "c:1", "ball")], "clip_id string, track_id string, class string")
    got = sorted((r.track_id, r.track_class, r.points, r.last_frame, r.frame_count, r.frames, r.times, r.xs, r.ys) for r in TR.replay_tracks(points, classes).collect())
    assert got == [("c:1", "ball", 2, 7, 8, [2, 7], [None, 0.7], [0.1, 0.3], [0.2, 0.4]), ("c:2", "player", 1, 4, 8, [4], [0.4], [0.5], [0.6]),
                   ("d:1", "player", 1, 0, 1, [0], [0.0], [1.0], [0.0])]
