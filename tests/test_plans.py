import pytest

from kinweave.plans import lineage, skew


class FakeConf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class FakeSession:
    def __init__(self, master, **conf):
        self.conf = FakeConf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_folder():
    """A cluster must name it; a local master may do without."""
    named = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert lineage.shared_dir(FakeSession("spark://host:7077", **named)) == lineage.shared_dir(FakeSession("local[4]", **named)) == "hdfs://x/y"
    assert lineage.shared_dir(FakeSession("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            lineage.shared_dir(FakeSession(master))


def test_joins_under_heavy_and_missing_keys(spark):
    """Heavy keys and rows without one give what a plain left join gives, repeated rows included."""
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [(None, i) for i in range(7)] + [("b", 1), ("b", 1), ("z", 2)], "k string, n long")
    facts = spark.createDataFrame([("a", 1.5, ["x"]), ("b", None, None), ("c", 2.0, [])], "k string, v double, w array<string>")
    plain = sorted(rows.join(facts, "k", "left").collect(), key=str)
    for least in (3, 6, 100):
        heavy = skew.heavy_or_none(rows, "k", rows.count(), least)
        assert (heavy is None) == (least == 100)
        assert sorted(skew.lookup_join(rows, "k", facts, heavy).select("k", "n", "v", "w").collect(), key=str) == plain
