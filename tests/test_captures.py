import io
import json
import random

import pytest

from gaitworks.sources import captures

FRAME = "states struct<arm_state: array<double>>, torso_height double, note string"


def frame(rnd, i):
    return {"idx": i, "note": rnd.choice(['a "quoted" ] text', "ünï ✓ }", "", "{[", "\\"]), "torso_height": rnd.choice([0.5, -3e-7, None]),
            "states": {"arm_state": [rnd.random() for _ in range(rnd.randint(0, 5))]}}


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 16])
def test_items_whatever_the_buffer(step):
    rnd = random.Random(1)
    for _ in range(15):
        frames = [rnd.choice([frame(rnd, i), rnd.randint(0, 10**12), "x]", [], None, -1.5]) for i in range(rnd.randint(0, 6))]
        for doc in (frames, {"data": frames}, {"info": {"data": [1]}, "n": 12345, "data": frames, "end": [1, {"a": 2}]}):
            for indent in (None, 4):
                assert list(captures.frames_of(io.StringIO(json.dumps(doc, indent=indent)), "data", step)) == frames


def test_documents_without_frames_or_with_a_fault():
    for text in ("{}", '{"info": {}}', '{"data": null}', '{"data": []}', "[]"):
        assert list(captures.frames_of(io.StringIO(text))) == []
    for text in ("", '{"data": [1, 2', '{"data": [1 2]}', '{"data": [{"a": 1}, {"b"', "3"):
        with pytest.raises(ValueError):
            list(captures.frames_of(io.StringIO(text)))


def test_scan_of_folders(spark, tmp_path):
    rnd = random.Random(2)
    want = []
    for episode, n in ((3, 40_000), (12, 0), (7, 1), (20, 5)):  # the first is larger than a batch of rows and than the buffer
        folder = tmp_path / "task one" / f"episode_{episode:04d}"
        folder.mkdir(parents=True)
        frames = [frame(rnd, i) for i in range(n)]
        (folder / "data.json").write_text(json.dumps({"info": {"fps": 30}, "data": frames}, indent=4))
        (folder / "notes.txt").write_text("not a capture")
        want += [(episode, i, i == n - 1, f["states"]["arm_state"], f["torso_height"], f["note"]) for i, f in enumerate(frames)]
    t = captures.scan_captures(spark, str(tmp_path), FRAME, 30.0, task_bytes="1000")
    assert t.rdd.getNumPartitions() == 4
    got = [(r.episode_index, r.frame_index, r.done, r.states.arm_state, r.torso_height, r.note) for r in t.collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert t.where("abs(timestamp - frame_index / 30) > 1e-12").count() == 0


def test_fields_that_are_missing_and_empty_folders(spark, tmp_path):
    assert captures.scan_captures(spark, str(tmp_path), FRAME, 30.0).collect() == []
    (tmp_path / "other.json").write_text('[{"torso_height": "tall"}, {"states": {}}]')
    got = captures.scan_captures(spark, str(tmp_path), FRAME, 30.0).orderBy("frame_index").collect()
    assert [(r.episode_index, r.done, r.torso_height) for r in got] == [(None, False, None), (None, True, None)]
