"""Scans of folder trees, and files written without parts or loss."""

from pyspark.sql import functions as F

from segloom.sources import files


def test_scan(spark, tmp_path):
    root = tmp_path / "a.b (c)+[d]"
    for path, body in {"x.txt": b"one", "sub/y.srt": b"two", "sub/y.bilingual.srt": b"made", "z.bin": b"no", "bad.md": b"\xff"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    got = {r.path: (r.format, r.source, r.error) for r in files.texts(files.scan(spark, str(root))).collect()}
    assert got == {"x.txt": ("txt", "one", None), "sub/y.srt": ("srt", "two", None), "bad.md": ("md", None, "not valid UTF-8")}


def test_save(spark, tmp_path):
    (tmp_path / "there.txt").write_bytes(b"old")
    (tmp_path / "same.txt").write_bytes(b"new")
    rows = [("deep/er/a.txt", False), ("there.txt", False), ("same.txt", False), ("../out.txt", False), ("gone.txt", True)]
    df = spark.createDataFrame(rows, "path string, overwrite boolean").withColumn("content", F.lit("new"))
    got = {r.path: r.outcome for r in files.save(df, str(tmp_path)).collect()}
    assert got == {"deep/er/a.txt": "written", "there.txt": "exists", "same.txt": "identical", "../out.txt": "unsafe", "gone.txt": "gone"}
    assert (tmp_path / "deep/er/a.txt").read_bytes() == b"new" and (tmp_path / "there.txt").read_bytes() == b"old" and not (tmp_path.parent / "out.txt").exists()
    over = {r.path: r.outcome for r in files.save(df.filter("path = 'there.txt'").withColumn("overwrite", F.lit(True)), tmp_path.as_uri()).collect()}
    assert over == {"there.txt": "written"} and (tmp_path / "there.txt").read_bytes() == b"new"
    assert not [p for p in tmp_path.rglob("*.tmp")]


def test_command_line(spark, tmp_path, capsys):
    from segloom.__main__ import arguments, main

    root = tmp_path / "in"
    for path, body in {"a.txt": "one\ntwo\n", "sub/b.srt": "1\n00:00:01,000 --> 00:00:02,000\none\n", "c.md": "# one\n\nthree"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    argv = [str(root), "--cache", str(tmp_path / "cache"), "--translator", "fake", "--out", str(tmp_path / "out"), "--mode", "replace"]
    assert main(argv) == 0
    assert (tmp_path / "out/a.translated.txt").read_text().split("\n")[:2] == ["translated 1", "translated 2"]
    assert "translated 1" in (tmp_path / "out/sub/b.translated.srt").read_text()
    assert sorted(line.split("\t")[0] for line in capsys.readouterr().out.splitlines()) == ["written"] * 3
    assert main(argv) == 0 and {line.split("\t")[0] for line in capsys.readouterr().out.splitlines()} == {"identical"}
    assert arguments([str(root), "--cache", "x"]).batch_size == 25
