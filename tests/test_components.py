"""Connected components against a plain union-find, and how their tables shrink."""

import random

import pytest

from quillmine.operators.components import connected_components, fewer_links
from quillmine.scratch import Scratch, clean, shared_dir


def plain(links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


class Counted(Scratch):
    def __init__(self, *args):
        super().__init__(*args)
        self.rows = {}

    def save(self, df, name=None):
        out = super().save(df, name)
        self.rows[name] = out.count()
        return out


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_shapes(spark, kind):
    rng = random.Random(5)
    n = 400
    links = {
        "path": [(i, i + 1) for i in range(n)], "star": [(n // 2, i) for i in range(n) if i != n // 2], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)], "none": [],
    }[kind]
    scratch = Counted(spark, "test")
    df = spark.createDataFrame([*links, *links[:20], (None, 1), (5, None), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(df, scratch, "c").collect()}
    assert got == plain([p for p in links if p[0] != p[1]])
    passed = [v for k, v in scratch.rows.items() if k.startswith("c-links")]
    assert sum(passed) <= 4 * passed[0] and len(passed) <= 10  # links shrink geometrically on paths too


def test_fewer_links_keep_the_components(spark):
    rng = random.Random(6)
    links = [(i, 1_000 + rng.randrange(6) + 10 * (i % 7)) for i in range(700) for _ in range(6)]
    out = fewer_links(spark.createDataFrame([*links, (3, 3), (None, 2)], "a bigint, b bigint"))
    rows = [(r.a, r.b) for r in out.collect()]
    assert plain(rows) == plain(links) and len(rows) <= 700 + 7 * 15


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Unset:
        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return self

        def isDefined(self):  # noqa: N802
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = Unset()
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Context.master = "local[4]"
    assert shared_dir(Session).startswith("file://")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_clean_deletes_all_folders(spark):
    from pathlib import Path

    scratch = Scratch(spark, "test")
    scratch.save(spark.range(3).toDF("x"), "t")
    assert Path(scratch.root.removeprefix("file://")).exists()
    clean()
    assert not Path(scratch.root.removeprefix("file://")).exists()
