"""A tracking document reads alike at any size."""

import json

from touchline.sources import tracking_files as TF


def written(folder, name, frames, more):
    """A pretty-printed document whose points follow ``more`` bytes of a field that is not read."""
    doc = {"metadata": {"input_video": f"{name}.mp4", "width": 200, "height": 100}, "note": ["x" * 1_000_000] * (more // 1_000_000),
           "tracks": [{"track_id": 1, "trajectory": [{"frame_index": i, "time_seconds": i / 10, "center": {"x": 50, "y": 50}} for i in range(frames)]}]}
    (folder / f"{name}.json").write_text(json.dumps(doc, indent=1))


def test_a_document_over_128_mb(spark, tmp_path):
    written(tmp_path, "big", 3, 140_000_000)
    written(tmp_path, "small", 2, 0)
    points, failed = TF.read_tracks(spark, str(tmp_path))
    assert sorted((r.clip_id, r.frame_index, r.x, r.y) for r in points.collect()) == [
        ("cv:big", 0, 0.25, 0.5), ("cv:big", 1, 0.25, 0.5), ("cv:big", 2, 0.25, 0.5), ("cv:small", 0, 0.25, 0.5), ("cv:small", 1, 0.25, 0.5)]
    assert failed.count() == 0
