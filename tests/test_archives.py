"""WARC files over many byte ranges against a reader that follows the lengths from the first byte."""

import random
import subprocess
import sys

import pytest

from webloom.sources.archives import scan_warc


def record(version, body, kind="resource", extra=""):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def bodies(seed, n):
    draw = random.Random(seed)
    inner = record("1.1", b"inner \xff body") + record("1.0", b"")
    plain = [b"", b"line one\r\n\r\nline two", b"\xff\xfe\x00binary", b"WARC/1.0\r\n", b"x\r\n\r\nWARC/1.0\r\ny", b"\r\n\r\nWARC/1.", b"\r\n\r\n", inner, inner * 3, "é\r\n\r\nWARC/1.1 ü".encode()]
    return [draw.choice(plain) + bytes(draw.randrange(256) for _ in range(draw.randrange(60))) * draw.choice([0, 1, 4]) for _ in range(n)]


@pytest.mark.parametrize("split", [150, 1000, 1 << 27])
def test_bodies_come_back_byte_for_byte(spark, tmp_path, split):
    wanted = []
    for name in range(3):
        found = bodies(name, 60)
        with open(tmp_path / f"{name}.warc", "wb") as f:
            for k, body in enumerate(found):
                f.write(record("1.0" if k % 2 else "1.1", body, extra=f"X-Name: {name}-{k}\r\nX-Folded: a\r\n  b\r\n"))
        wanted += [(f"{name}-{k}", body) for k, body in enumerate(found)]
    before, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = scan_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted((r["headers"]["x-name"], bytes(r["body"])) for r in rows) == sorted(wanted)
    assert all(r["complete"] and r["headers"]["x-folded"] == "a b" and r["headers"]["warc-type"] == "resource" for r in rows)


def test_wrong_lengths_do_not_swallow_neighbours(spark, tmp_path):
    short = b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: 40\r\n\r\nonly this\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: b\r\n\r\n\r\n\r\n"
    with open(tmp_path / "a.warc", "wb") as f:
        f.write(record("1.1", b"first") + short + none + record("1.0", b"last") + b"WARC/1.1\r\nWARC-Type: cut\r\nContent-Length: 9\r\n\r\nfour")
    rows = {r["headers"]["warc-type"]: r for r in scan_warc(spark, str(tmp_path)).collect() if r["headers"]["warc-type"] != "resource"}
    assert len(scan_warc(spark, str(tmp_path)).collect()) == 5
    assert bytes(rows["a"]["body"]) == b"only this" and not rows["a"]["complete"]
    assert rows["b"]["body"] is None and not rows["b"]["complete"]
    assert bytes(rows["cut"]["body"]) == b"four" and not rows["cut"]["complete"]


def test_an_empty_folder_of_records(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"")
    assert scan_warc(spark, str(tmp_path)).count() == 0


def test_first_example_runs_from_another_folder(tmp_path):
    """The package reaches the workers although they start elsewhere."""
    import os

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {home!r})\n"
            "from webloom.session import local_session\nfrom webloom.operators import nodes\n"
            "spark = local_session(2)\npages = spark.createDataFrame([(1, 'http://a/', '<p>x</p>')], 'page_id long, url string, html string')\n"
            "print('rows', nodes.page_nodes(pages).count(), len(nodes.page_nodes(pages).collect()))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240, env=env)
    assert "rows 1 1" in done.stdout, done.stderr[-2000:]
