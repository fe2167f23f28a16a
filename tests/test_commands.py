import importlib

from kinweave import commands
from kinweave.sources import files


def test_every_command_names_queries(spark, tmp_path):
    known = {k for m in commands.MODULES for k in importlib.import_module(f"kinweave.queries.{m}").QUERIES}
    assert {q for names in commands.COMMANDS.values() for q in names} <= known
    commands.main(["one-way", "/root/testdata/sf0.001", f"{tmp_path}/r"])
    rows = spark.read.json(f"{tmp_path}/r/one_way_contacts/rows")
    assert rows.count() == commands.run(spark, "/root/testdata/sf0.001", "one-way")["one_way_contacts"].count() > 0


def test_sources_by_interface(spark):
    class Two:
        def __init__(self, name, who):
            self.name, self.who = name, who

        def interactions(self, spark, since, until):
            shape = "contact string, date string, channel string, interaction_type string, summary string, source string, context string, metadata map<string,string>, extra int"
            return spark.createDataFrame([(self.who, d, self.name, "call", "s", "x", None, {}, 1) for d in ("2025-01-01", "2025-02-01")], shape).where(f"date BETWEEN '{since}' AND '{until}'")

        def contact(self, identifier):
            return identifier.title()

    both = commands.scan_sources(spark, [Two("a", "Ann"), Two("b", "Bo")], "2025-01-15", "2025-03-01")
    assert both.columns == files.INTERACTION and sorted(r.contact for r in both.collect()) == ["Ann", "Bo"]
