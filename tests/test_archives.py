"""Archives as tables."""

import zipfile

from millrace.sources import archives as A


def test_members(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("top/", "")
            for i in range(20):
                z.writestr(f"top/{'x' if i % 2 else 'y'}{i}.html", f"{k}:{i} " * 500)
    (tmp_path / "other.txt").write_text("no archive")
    want = {(f"a{k}.zip", f"top/{'x' if i % 2 else 'y'}{i}.html", f"{k}:{i} " * 500) for k in range(3) for i in range(20)}
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = A.read_archives(spark, path, partition_bytes=9000)
        assert {(r.archive.rsplit("/", 1)[-1], r["name"], bytes(r.content).decode()) for r in found.collect()} == want
        assert found.rdd.getNumPartitions() > 6
    some = found.filter("name like 'top/x%'").select("name")
    assert {r["name"] for r in some.collect()} == {n for _, n, _ in want if "/x" in n} and some.rdd.getNumPartitions() < found.rdd.getNumPartitions()
    assert found.filter("name = 'top/y4.html'").count() == 3 and found.filter("name in ('top/y4.html', 'no') and size > 1").count() == 3
    assert A.read_archives(spark, str(tmp_path / "a1.zip")).count() == 20


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{i}", None if i == 3 else "é" * i) for i in range(25)] + [(None, "lost")], "n string, c string")
    made = A.write_archives(rows, "n", "c", f"file://{tmp_path}/z", members=6)
    assert sum(r.members for r in made.collect()) == 25 and made.count() > 1
    back = A.read_archives(spark, f"file://{tmp_path}/z")
    assert {(r["name"], bytes(r.content).decode(), r.size) for r in back.collect()} == {(f"d/{i}", "" if i == 3 else "é" * i, 0 if i == 3 else 2 * i) for i in range(25)}
    assert A.write_archives(rows.limit(0), "n", "c", f"file://{tmp_path}/none").count() == 0


def test_bundle_titles():
    assert A.bundle_title(["2020 Acme Car X/a.html", "2020 Acme Car X/b/c.html"]) == ("2020", "Acme", "Car X")
    assert A.bundle_title(["2020 Acme Car/a", "other/b"]) is A.bundle_title(["a"]) is A.bundle_title([]) is A.bundle_title(["20 A B/x"]) is None
