"""A folder tree as a data source."""

import os

import pytest

from lodestone.session import ship_package
from lodestone.sources.tree import TreeSource


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "inbox"
    (root / "a" / "deep" / "er").mkdir(parents=True)
    (root / "b").mkdir()
    (root / ".hidden").mkdir()
    for path, text in (("a/x.txt", "one"), ("a/deep/er/é y.txt", ""), ("b/z", "three"), ("top", "four"), (".hidden/h", "five"), (".dot", "six")):
        (root / path).write_text(text)
    os.symlink("/etc", root / "a" / "out")
    os.symlink("nowhere", root / "b" / "broken")
    os.mkfifo(root / "b" / "pipe")
    (root / "empty").mkdir()
    return root


def rows(spark, root, **options):
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    return sorted((r.path, r.entry, r.kind, r["size"], r.target) for r in spark.read.format("tree").options(**options).load(str(root)).collect())


WANT = [
    ("a/deep/er/é y.txt", "a", "file", 0, None), ("a/out", "a", "link", None, "/etc"), ("a/x.txt", "a", "file", 3, None), ("b/broken", "b", "link", None, "nowhere"), ("b/pipe", "b", "special", None, None),
    ("b/z", "b", "file", 5, None), ("top", "top", "file", 4, None),
]


@pytest.mark.parametrize("tasks", [1, 2, 50])
def test_kinds_are_told_apart_and_links_not_followed(spark, tree, tasks):
    assert rows(spark, tree, tasks=str(tasks)) == WANT


def test_only_ready_names_and_hidden_ones_if_asked(spark, tree):
    assert rows(spark, tree, ready=" b , top,unknown") == [r for r in WANT if r[1] in ("b", "top")]
    assert rows(spark, tree, ready="") == []
    assert {r[1] for r in rows(spark, tree, hidden="true")} == {".hidden", ".dot", "a", "b", "top"}
    assert rows(spark, tree / "empty") == []


def test_times_and_a_folder_that_is_gone(spark, tree):
    from lodestone.sources.tree import listed

    found = spark.read.format("tree").load(str(tree)).where("path = 'top'").first()
    assert found.mtime_ns == os.lstat(tree / "top").st_mtime_ns
    assert list(listed(str(tree), "gone")) == [("gone", "gone", "unreadable", None, None, "FileNotFoundError")]
