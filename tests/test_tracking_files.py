"""Tracking files by hand: sizes by clip, units by track, files that fail by name."""

import json

import pytest

from touchline.sources import tracking_files as TF


def track(i, *points):
    return {"track_id": i, "trajectory": [{"frame_index": f, "time_seconds": f / 10, "center": {"x": x, "y": y}} for f, x, y in points]}


def put(folder, docs):
    for name, doc in docs.items():
        (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))
    return str(folder)


def test_tracks(spark, tmp_path):
    src = put(tmp_path, {
        "a.json": {"metadata": {"input_video": "/v/Big clip.v2.mp4", "width": 200, "height": 100}, "tracks": [track(1, (0, 50, 50), (1, 100, 25)), track("b", (0, 1, 1), (0, 2, 3))]},
        "b.json": json.dumps({"metadata": {"width": 10.0, "height": 20}, "tracks": [track(1, (0, 5, 5)), {"track_id": 2}]}),
        "c.json": {"metadata": {"input_video": "small.mp4", "width": 0, "height": 100}, "tracks": [track(1, (0, 1, 1))]},
        "d.json": {"metadata": {"input_video": "none.mp4"}, "tracks": []}, "e.json": "{\"metadata\": {", "f.json": {"tracks": []}})
    points, failed = TF.read_tracks(spark, src)
    assert sorted((r.clip_id, r.track_id, r.frame_index, r.x, r.y) for r in points.collect()) == [
        ("cv:Big clip.v2", "cv:Big clip.v2:1", 0, 0.25, 0.5), ("cv:Big clip.v2", "cv:Big clip.v2:1", 1, 0.5, 0.25), ("cv:Big clip.v2", "cv:Big clip.v2:b", 0, 0.01, 0.03),
        ("cv:clip", "cv:clip:1", 0, 0.5, 0.25)]
    assert sorted((r.path.rsplit("/", 1)[1], r.clip_name, r.reason) for r in failed.collect()) == [
        ("c.json", "small", "no frame size"), ("d.json", "none", "no frame size"), ("e.json", None, "not JSON"), ("f.json", None, "no metadata")]
    with pytest.raises(ValueError, match=r"4 files do not load: small \(no frame size\), none"):
        TF.require(failed)
    TF.require(failed.limit(0))


def test_metrics(spark, tmp_path):
    src = put(tmp_path, {
        "a.json": {"metadata": {"clip_name": "x", "license": "", "author": "me", "fps": 25, "width": 4, "height": 3, "frame_count": 9, "rights_confirmed": True, "distance_units": "yards"},
                   "tracks": [{"track_id": 1, "class": "ball", "frame_count": 3, "first_frame": 2, "last_frame": 8, "top_speed": 2.5, "distance_units": "meters"}, {"track_id": "k"}]},
        "b.json": {"metadata": {"clip_name": "y", "rights_confirmed": False}, "tracks": [{"track_id": 1}]}, "c.json": {"metadata": {}, "tracks": []}})
    clips, tracks, failed = TF.read_metrics(spark, src)
    c = clips.first()
    assert clips.count() == 1 and (c.clip_id, c.license, c.author, c.fps, c.frame_count, c.width, c.height, c.calibrated, c.distance_units, c.speed_units) == (
        "cv:x", None, "me", 25.0, 9, 4, 3, False, "yards", "pixels_per_second")
    assert sorted((r.track_id, r["class"], r.frame_count, r.first_frame, r.last_frame, r.top_speed, r.distance_units, r.speed_units) for r in tracks.collect()) == [
        ("cv:x:1", "ball", 3, 2, 8, 2.5, "meters", "pixels_per_second"), ("cv:x:k", "unknown", 0, None, None, None, "yards", "pixels_per_second")]
    assert sorted((r.clip_name, r.reason) for r in failed.collect()) == [("clip", "rights not confirmed"), ("y", "rights not confirmed")]
