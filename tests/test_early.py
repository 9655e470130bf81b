"""The pool in file order stops reading when its quotas are full."""

import gzip
import json

from revmill.schema import CUTOFF_MS
from revmill.sources import early

TEXT = " ".join(["w"] * 25)


def line(user, text=TEXT):
    return json.dumps({"timestamp": CUTOFF_MS - 1000, "text": text, "user_id": user, "parent_asin": "p"})


def write(folder, number, lines):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"part-{number:05d}.gz", "wt") as out:
        out.write("\n".join(lines))


def broken(folder, number):
    """A file that ends the job if it is opened."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"part-{number:05d}.gz").write_bytes(b"\x1f\x8b\x08 this is no archive")


def users(rows):
    return sorted(r.review_id.split("_")[1] for r in rows.collect())


def test_files_after_the_quota_are_not_read(spark, tmp_path):
    a, b = tmp_path / "Books", tmp_path / "Toys"
    for k in range(4):
        write(a, k, [line(f"a{k}{i}") for i in range(5)] + [line("short", "w"), "{bad", ""])
    broken(a, 7)  # waves of one, two and four files: this one would be the eighth
    write(b, 0, [line(f"b{i}") for i in range(9)])
    broken(b, 1)
    broken(tmp_path / "Unlisted", 0)
    found = early.build_pool_from_files(spark, str(tmp_path), {"Books": 12, "Toys": 4, "None": 3, "Nil": 0})
    got = users(found)
    assert len(got) == 16
    assert [u for u in got if u < "a2"] == [f"a{k}{i}" for k in range(2) for i in range(5)]
    assert sum(u.startswith("a2") for u in got) == 2 and sum(u.startswith("b") for u in got) == 4


def test_short_files_and_copies(spark, tmp_path):
    write(tmp_path / "Books", 0, [line("x"), line("x", TEXT + " again"), line("y", TEXT + " z")])
    write(tmp_path / "Books", 1, [line("y", TEXT), line("v")])
    whole = early.build_pool_from_files(spark, str(tmp_path), ["Books"], 100)
    # Of copies the one of the first file stays, and in a file the smallest row.
    assert {r.review_id.split("_")[1]: r.text for r in whole.collect()} == {"x": TEXT, "y": TEXT + " z", "v": TEXT}
    assert early.build_pool_from_files(spark, str(tmp_path), {"Toys": 3}).collect() == []
    assert users(early.build_pool_from_files(spark, str(tmp_path), {"Books": 3})) == ["x", "y"]
