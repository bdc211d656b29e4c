import os

import pytest

from curato.sources import scan
from curato.sources.scan import ScanLimits, scan_inputs


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for name, size in (("b.PNG", 3), ("a.jpg", 5), ("notes.txt", 4), ("C.webp", 2), ("sub/d.jpeg", 7), ("sub/deep/e.png", 1), ("Sub2/f.png", 9), ("sub/readme.md", 1)):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "z.png").write_bytes(b"zz")
    (root / "link.png").symlink_to(root / "a.jpg")
    (root / "broken.png").symlink_to(root / "nothing")
    (root / "folder_link").symlink_to(tmp_path / "other")
    os.mkfifo(tmp_path / "pipe")
    return root


def _scan(spark, root, inputs, **options):
    files, issues = scan_inputs(spark, [str(i) for i in inputs], **options)
    short = lambda p: os.path.relpath(p, root.parent)
    return [short(r.path) for r in files.collect()], [(short(r.path), r.code) for r in issues.collect()]


def test_a_folder_is_listed_shallow(spark, tree):
    files, issues = _scan(spark, tree, [tree])
    assert files == ["in/a.jpg", "in/b.PNG", "in/C.webp"]
    assert issues == [("in/broken.png", "filesystem_link"), ("in/folder_link", "filesystem_link"), ("in/link.png", "filesystem_link")]


def test_a_tree_is_listed_by_its_folders(spark, tree):
    files, issues = _scan(spark, tree, [tree], recursive=True)
    assert files == ["in/a.jpg", "in/b.PNG", "in/C.webp", "in/sub/d.jpeg", "in/sub/deep/e.png", "in/Sub2/f.png"]
    assert issues == [("in/broken.png", "filesystem_link"), ("in/link.png", "filesystem_link")]
    parts = scan._Reader([str(tree)], True, ScanLimits()).partitions()
    assert [os.path.basename(p.folder) for p in parts] == ["in", "sub", "Sub2"]


def test_issues_of_inputs(spark, tree):
    inputs = [tree / "gone", tree / "notes.txt", tree.parent / "pipe", tree / "link.png", tree / "folder_link" / "z.png", tree / "a.jpg", tree / "a.jpg", tree]
    files, issues = _scan(spark, tree, inputs)
    assert files == ["in/a.jpg", "in/b.PNG", "in/C.webp"]
    assert sorted(issues) == sorted(
        [
            ("in/gone", "missing"), ("in/notes.txt", "unsupported_extension"), ("pipe", "not_a_file_or_directory"), ("in/link.png", "filesystem_link"),
            ("in/folder_link/z.png", "filesystem_link"), ("in/broken.png", "filesystem_link"), ("in/folder_link", "filesystem_link"), ("in/link.png", "filesystem_link"),
        ]
    )


def test_limits_end_the_scan(spark, tree):
    other = tree.parent / "other"
    assert _scan(spark, tree, [tree, other], limits=ScanLimits(files=2))[0] == ["in/a.jpg", "in/b.PNG"]
    files, issues = _scan(spark, tree, [other, tree], limits=ScanLimits(files=2))
    assert files == ["in/a.jpg", "other/z.png"] and ("in", "too_many_images") in issues
    files, issues = _scan(spark, tree, [tree], limits=ScanLimits(bytes=9))
    assert files == ["in/a.jpg", "in/b.PNG"] and ("in", "total_size_exceeded") in issues
    files, issues = _scan(spark, tree, [tree], limits=ScanLimits(entries=2))
    assert files == ["in/a.jpg", "in/b.PNG"] and ("in", "too_many_entries") in issues
    files, issues = _scan(spark, tree, [tree], limits=ScanLimits(file_bytes=4))
    assert files == ["in/b.PNG", "in/C.webp"] and ("in/a.jpg", "file_too_large") in issues
    with pytest.raises(ValueError, match="limits"):
        ScanLimits(files=2001)


def test_after_a_limit_inputs_are_looked_at_until_one_is_there(spark, tree):
    gone = [tree.parent / f"gone{i}" for i in range(3)]
    _, issues = _scan(spark, tree, [gone[0], tree, gone[1], tree.parent / "other", gone[2]], limits=ScanLimits(files=1))
    assert [i for i in issues if i[1] == "missing"] == [("gone0", "missing"), ("gone1", "missing")]


def test_limits_hold_over_folders_of_a_tree(spark, tmp_path):
    root = tmp_path / "many"
    for f in range(7):
        for i in range(9):
            path = root / f"f{f}" / f"{i}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x" * (i + 1))
    want = [f"many/f{f}/{i}.png" for f in range(7) for i in range(9)]
    for limits, n in ((ScanLimits(files=31), 31), (ScanLimits(entries=40), 40), (ScanLimits(bytes=100), 22), (ScanLimits(), 63)):
        files, issues = _scan(spark, root, [root], recursive=True, limits=limits)
        assert files == want[:n] and len(issues) == (n < 63)


def test_paths_that_differ_in_case_count_once(spark, tmp_path):
    for name in ("A.png", "a.PNG", "b.png"):
        (tmp_path / name).write_bytes(b"x")
    assert _scan(spark, tmp_path / "x", [tmp_path]) == (["A.png", "b.png"], [])


def test_a_folder_that_cannot_be_listed_ends_its_input(monkeypatch):
    def refuse(path):
        if path.endswith("/bad"):
            raise PermissionError(path)
        return ["1.png"], ["bad", "worse"] if path == "/r" else []

    monkeypatch.setattr(scan, "_listed", refuse)
    monkeypatch.setattr(scan, "has_link", lambda p: False)
    monkeypatch.setattr(scan.os.path, "exists", lambda p: True)
    monkeypatch.setattr(scan.os.path, "isdir", lambda p: True)
    reader = scan._Reader(["/r"], True, ScanLimits())
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[1], r[3], r[7]) for r in rows] == [(0, "there", None), (0, "entry", "unreadable"), (1, "there", None), (1, "end", "unreadable"), (2, "there", None), (2, "entry", "unreadable")]


def test_no_inputs(spark):
    files, issues = scan_inputs(spark, [])
    assert files.count() == 0 and issues.count() == 0
