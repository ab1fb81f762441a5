"""The stream of worker events over files that grow."""

import json

from helix.sources.events import BLOCK, after_last_line, lines
from helix.sources.vcf import read_events


def event(n, job="j", **more):
    return json.dumps({"protocol_version": 1, "type": "heartbeat", "job_id": job, "job_revision": 1, "sequence": n, **more})


def test_lines_of_any_stretch(tmp_path):
    path = tmp_path / "x.ndjson"
    text = b"a\n\nbc\r\n" + b"x" * (3 * BLOCK) + b"\nlast"
    path.write_bytes(text)
    p = str(path)
    assert after_last_line(p, 0, len(text)) == len(text) - 4 and after_last_line(p, 7, 7 + BLOCK) == 7 and after_last_line(p, 0, 0) == 0
    got = list(lines(p, 0, len(text), 10))
    assert got == [(0, b"a", 1), (2, b"", 0), (3, b"bc\r", 3), (7, b"x" * 11, 3 * BLOCK), (8 + 3 * BLOCK, b"last", 4)]
    assert list(lines(p, 2, 7)) == [(2, b"", 0), (3, b"bc\r", 3)]


def test_a_growing_file_loses_and_repeats_nothing(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    a, b = folder / "a.ndjson", folder / "b.ndjson"
    a.write_text(event(1) + "\n" + event(2)[:20])
    seen = []

    def start():
        stream = read_events(spark, str(folder)).select("job_id", "sequence", "_error").writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect())))
        return stream.option("checkpointLocation", str(tmp_path / "checkpoint")).start()

    q = start()
    try:
        q.processAllAvailable()
        assert seen == [("j", 1, None)]
        with a.open("a") as f:
            f.write(event(2)[20:] + "\r\n" + event(3) + "\nnot json\n" + event(4, message="m" * 70_000) + "\n" + event(5)[:-1])
        b.write_text(event(1, "k") + "\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen, key=repr) == sorted([("j", 1, None), ("j", 2, None), ("j", 3, None), (None, None, "not_json"), (None, None, "too_long"), ("k", 1, None)], key=repr)
    with a.open("a") as f:
        f.write("}\n")
    q = start()  # goes on from its checkpoint
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert len(seen) == 7 and seen[-1] == ("j", 5, None)
