"""The streaming ingest: same filters, the first copy of each review, restartable."""

import json
import os
import time
from datetime import timedelta

from revmill.schema import CUTOFF_MS
from revmill.sources import reviews as source
from revmill.streaming.ingest import first_arrivals, ingest_stream

DAY = 86_400_000
TEXT = " ".join(["w"] * 25)


def line(user, day, text=TEXT):
    return json.dumps({"timestamp": CUTOFF_MS - day * DAY, "text": text, "user_id": user})


def run(spark, root):
    query = ingest_stream(
        spark, str(root / "in"), str(root / "out"), str(root / "state"), files_per_trigger=1
    )
    query.awaitTermination()
    return sorted(r.review_id for r in source.scan_reviews(spark, str(root / "out")).collect())


def test_ingest_across_files_and_restarts(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    # "old" is years before what earlier files hold and must still arrive.
    one = [line("a", 9)] * 200 + [line("b", 8), line("short", 8, "w"), "{bad", "", line("late", -1)]
    (landing / "Books.jsonl").write_text("\n".join(one))
    (landing / "Pet_Supplies.jsonl").write_text("\n".join([line("a", 9)] * 3))
    ids = lambda *names: sorted(f"{c}_{u}_{CUTOFF_MS - d * DAY}" for c, u, d in names)
    first = ids(("Books", "a", 9), ("Books", "b", 8), ("Pet_Supplies", "a", 9))
    assert run(spark, tmp_path) == first
    assert run(spark, tmp_path) == first
    (landing / "Books.jsonl.gz").write_bytes(
        __import__("gzip").compress("\n".join([line("a", 9), line("c", 7), line("c", 7), line("old", 4000)]).encode())
    )
    assert run(spark, tmp_path) == sorted(first + ids(("Books", "c", 7), ("Books", "old", 4000)))


def put(folder, name, written, *lines):
    path = folder / name
    path.write_text("\n".join(lines))
    os.utime(path, (written, written))


def texts(df):
    return {r.review_id.split("_")[1]: r.text.split()[0] for r in df.collect()}


def test_the_first_copy_by_arrival_stays_in_stream_and_batch(spark, tmp_path):
    landing = tmp_path / "in"
    (landing / "Books").mkdir(parents=True)
    copy = lambda user, word: line(user, 9, f"{word} {TEXT}")
    # Names and texts are in the opposite order of arrival.
    put(landing / "Books", "part-3", 1000, copy("a", "z"), copy("c", "m"), copy("c", "k"))
    put(landing / "Books", "part-2", 2000, copy("a", "y"), copy("b", "y"))
    put(landing / "Books", "part-1", 3000, *[copy("a", "x")] * 20_000, copy("b", "x"), copy("d", "x"))
    want = {"a": "z", "b": "y", "c": "k", "d": "x"}
    assert texts(first_arrivals(spark, str(landing))) == want
    for files in (1, 2, 3):
        out = str(tmp_path / f"out-{files}")
        query = ingest_stream(spark, str(landing), out, str(tmp_path / f"state-{files}"), files_per_trigger=files)
        query.awaitTermination()
        assert texts(source.scan_reviews(spark, out)) == want


def test_a_review_is_forgotten_after_the_delay(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    kept = lambda: source.scan_reviews(spark, str(tmp_path / "out")).count()

    def run_once(delay):
        query = ingest_stream(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "state"), delay=delay)
        query.awaitTermination()

    (landing / "Books.jsonl").write_text(line("a", 9))
    run_once(timedelta(seconds=1))
    time.sleep(2)
    # Timers run in the batch that finds them due; the copy of that same batch is still known.
    (landing / "Pet_Supplies.jsonl").write_text(line("b", 9))
    run_once(timedelta(seconds=1))
    assert kept() == 2
    (landing / "Books.jsonl.gz").write_bytes(__import__("gzip").compress(line("a", 9).encode()))
    run_once(timedelta(days=1))
    assert kept() == 3
    (landing / "Books.json").write_text(line("a", 9))
    run_once(timedelta(days=1))
    assert kept() == 3
