"""Folders are listed and files read in tasks; the driver holds no list of them."""

import os

from tidemark.sources import files


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    names = ["a.md", "deep/er/b.md", "deep/c d%20e.md", "deep/ü.md", ".git/x.md", "_tmp/x.md", "_k=1/x.md", "node_modules/x.md", "in/__pycache__/x.md", "_x.md", ".x.md", "y.MD", "z.txt"]
    for name in names:
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.documents(spark, str(tmp_path), ("md",))
    assert "binaryFile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.text for r in got.collect()) == sorted(r.content.decode() for r in files.scan(spark, str(tmp_path), ("md",)).select("content").collect())
    (tmp_path / "empty").mkdir()
    assert files.documents(spark, str(tmp_path / "empty")).count() == 0
