"""Files of any name, from directories, patterns and single paths."""

import os

import pytest

from brindle.sources import files


@pytest.fixture
def folder(tmp_path):
    os.makedirs(tmp_path / "sub[1]" / "_x")
    os.makedirs(tmp_path / "s p")
    for n in ("a[b].txt", "a{b,c}.md", "a*.txt", "ab.txt", "q?.txt", "ü %20 x.txt", "_h.txt", ".dot.md", "sub[1]/in.txt", "sub[1]/_x/deep.txt", "s p/c.txt", "no.log", "back\\slash.txt"):
        (tmp_path / n).write_text(f"text of {n}\r\nend")
    (tmp_path / "empty.txt").touch()
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def names(df, folder):
    return sorted(os.path.relpath(r.filepath, folder) for r in df.collect())


def test_names_hold_any_character(spark, folder):
    got = {os.path.relpath(r.filepath, folder): r for r in files.read_documents(spark, folder).collect()}
    assert sorted(got) == sorted(
        [".dot.md", "_h.txt", "a*.txt", "a[b].txt", "ab.txt", "a{b,c}.md", "back\\slash.txt", "empty.txt", "q?.txt", "s p/c.txt", "sub[1]/_x/deep.txt", "sub[1]/in.txt", "ü %20 x.txt"]
    )
    assert all(r.content == f"text of {n}\nend" for n, r in got.items() if n != "empty.txt")
    # a file without content is told by its path and time
    assert got["empty.txt"].content == "" and len(got["empty.txt"].content_hash) == 16
    again = files.read_documents(spark, folder + "/empty.txt").first()
    assert again.content_hash == got["empty.txt"].content_hash
    os.utime(folder + "/empty.txt", (1, 1))
    assert files.read_documents(spark, folder + "/empty.txt").first().content_hash != again.content_hash


def test_patterns_and_single_paths(spark, folder):
    assert names(files.read_documents(spark, folder + "/sub[1]"), folder) == ["sub[1]/_x/deep.txt", "sub[1]/in.txt"]
    assert names(files.read_documents(spark, folder + "/a[[]b].txt"), folder) == ["a[b].txt"]
    assert names(files.read_documents(spark, folder + "/a*.txt"), folder) == ["a*.txt", "a[b].txt", "ab.txt"]
    assert names(files.read_documents(spark, f"file://{folder}/s p"), folder) == ["s p/c.txt"]
    assert files.read_documents(spark, folder + "/none*").count() == 0


def test_a_directory_is_one_listing(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k}.txt").write_text(f"line {k}")
    docs = files.read_documents(spark, str(tmp_path))
    # Spark lists explicit paths by jobs of their own; a root is one
    assert len(docs.inputFiles()) == 300 and docs.rdd.getNumPartitions() < 100 and docs.count() == 300
