"""What became of every file."""

import gzip

from headroom.sources.trace import read_report

COLUMNS = ["machine_id", "time", "average_usage"]


def test_every_file_is_told(spark, tmp_path):
    head = "machine_id,time,average_usage\n"
    (tmp_path / "good.csv").write_text(head + "m1,100,\"{'cpus': 0.1, 'memory': 2}\"\nm2,,0.5\nm3,7\nm4,300,0.2\n")
    (tmp_path / "other.csv").write_text("machine_id,time\nm1,1\n")
    (tmp_path / "only_header.csv").write_text(head)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "broken.csv.gz").write_bytes(gzip.compress(b"x" * 10_000)[:25])
    rows = {r["file"].rsplit("/", 1)[1]: r for r in read_report(spark, str(tmp_path), COLUMNS).collect()}
    assert {n: tuple(r[2:]) for n, r in rows.items()} == {
        "good.csv": ("read", 2, 1, 1),
        "only_header.csv": ("read", 0, 0, 0),
        "other.csv": ("other header", 0, 0, 0),
        "broken.csv.gz": ("unreadable", 0, 0, 0),
    }
    assert rows["broken.csv.gz"]["bytes"] == 25
