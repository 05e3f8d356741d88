"""The listing source: kinds, patterns, errors, completeness, and what a broken listing may not do."""

import os
import tempfile

from tarn.operators import changes
from tarn.sources.listing import listing, summary


def tree():
    root = tempfile.mkdtemp(prefix="spark-")
    for path in ("top.txt", "Docs/a.txt", "Docs/deep/B.MD", "Docs/deep/~$lock.docx", "Docs/.git/x", "Trash/old.txt", "Other/c1.csv", "Other/c2.csv", "Other/x/.hidden"):
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(path)
    return root


def kinds(df):
    return sorted((r.kind, r.norm_path) for r in df.collect())


def test_files_and_what_is_left_out(spark):
    root = tree()
    rows = listing(spark, root, excluded_directories=("trash",), excluded_globs=("c[2-9].csv",))
    assert kinds(rows) == [
        ("excluded", "docs/.git"), ("excluded", "docs/deep/~$lock.docx"), ("excluded", "other/c2.csv"), ("excluded", "other/x/.hidden"), ("excluded", "trash"),
        ("file", "docs/a.txt"), ("file", "docs/deep/b.md"), ("file", "other/c1.csv"), ("file", "top.txt"),
    ]
    one = rows.where("norm_path = 'docs/deep/b.md'").first()
    assert (one.relative, one.area, one.name, one.size) == ("Docs/deep/B.MD", "docs", "b.md", 14) and one.modified is not None
    assert rows.rdd.getNumPartitions() == 4  # the root's own files, and three directories
    (s,) = summary(rows).collect()
    assert (s.files, s.excluded, s.errors, s.complete) == (4, 5, 0, True)
    assert not summary(rows, limit=4).first().complete and summary(rows, limit=5).first().complete


def test_area_and_includes(spark):
    root = tree()
    assert kinds(listing(spark, root, area="OTHER", excluded_globs=("*.hidden",))) == [("excluded", "other/x/.hidden"), ("file", "other/c1.csv"), ("file", "other/c2.csv")]
    assert [p for _, p in kinds(listing(spark, root, includes=("docs/deep", "*.csv")).where("kind = 'file'"))] == ["docs/deep/b.md", "other/c1.csv", "other/c2.csv"]


def test_a_broken_listing_retires_nothing(spark):
    root, gone = tree(), tempfile.mkdtemp(prefix="spark-") + "/unmounted"
    before = listing(spark, root).where("kind = 'file'")
    stored = spark.createDataFrame([*before.collect(), (gone, "file", "z", "z", None, "z", 1, None, None, None)], before.schema)
    os.remove(os.path.join(root, "Docs/a.txt"))
    now = listing(spark, root, gone)
    diff = lambda: {(r.norm_path, r.change_type) for r in changes.listed_diff(stored, now.where("kind = 'file'"), summary(now)).where("change_type <> 'unchanged'").collect()}
    assert diff() == {("docs/a.txt", "missing"), ("z", "unknown")}  # the second root cannot be read: nothing of it is missing
    assert {r.error_type for r in now.where("kind = 'error'").collect()} == {"FileNotFoundError"}
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "Docs/link.txt"))  # a file that cannot be looked at
    assert diff() == {("docs/a.txt", "unknown"), ("z", "unknown")}
    assert [r.norm_path for r in now.where("kind = 'error' and root = '" + root + "'").collect()] == ["docs/link.txt"]


def test_a_root_that_was_not_listed(spark):
    rows = spark.createDataFrame([("r", "a", 1)], "root string, norm_path string, size long")
    none = rows.limit(0)
    flags = spark.createDataFrame([], "root string, complete boolean")
    assert changes.listed_diff(rows, none, flags, fields=("size",)).first().change_type == "unknown"
