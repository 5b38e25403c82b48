import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from relops.plans import releases
from relops.plans.releases import Target
from relops.sinks.tables import Layout, save_table, whole_table
from relops.streaming.changefiles import apply_arriving_changefiles
from relops.versions import table_properties

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])


def test_change_files_are_taken_once_and_in_order(spark, schema, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    target = Target(table=f"{schema}.main", registry=f"{schema}.releases", dag_id="d", entity_id="main")
    save_table(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), target.table)

    def arrive(number, rows):
        lines = "".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows)
        (folder / f"changes-2024-{number:04d}.jsonl").write_text(lines)

    def run():
        query = apply_arriving_changefiles(spark, str(folder), SCHEMA, target, "k", str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return sorted(map(tuple, spark.table(target.table).collect()))

    arrive(1, [(1, "old"), (3, "c")])
    arrive(2, [(1, "new")])
    assert run() == [(1, "new"), (2, "b"), (3, "c")]
    assert run() == [(1, "new"), (2, "b"), (3, "c")]
    arrive(3, [(2, "B")])
    assert run() == [(1, "new"), (2, "B"), (3, "c")]
    releases = [(int(r["sequence_start"]), int(r["sequence_end"])) for r in spark.table(target.registry).collect()]
    assert sorted(releases) == [(1, 2), (3, 3)]
    arrive(2, [(1, "late")])
    (folder / "changes-2024-0002.jsonl").rename(folder / "changes-2024-00002.jsonl")
    with pytest.raises(StreamingQueryException, match="arrived after"):
        run()


@pytest.mark.parametrize("layout", [{}, {"group_by": ("k",), "groups": 3}])
def test_a_batch_cut_off_before_its_registration(spark, schema, tmp_path, monkeypatch, layout):
    """Run again it starts from the table as it was, so an update without a key comes in once."""

    folder = tmp_path / "in"
    folder.mkdir()
    target = Target(table=f"{schema}.main", registry=f"{schema}.releases", dag_id="d", entity_id="main")
    save_table(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), target.table, layout=Layout(**layout))
    (folder / "changes-1.jsonl").write_text('{"k": 1, "v": "new"}\n{"k": null, "v": "once"}\n')

    def run():
        query = apply_arriving_changefiles(spark, str(folder), SCHEMA, target, "k", str(tmp_path / "checkpoint"))
        query.awaitTermination()

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(releases, "add_release", lost)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
        assert whole_table(spark, target.table).filter("v = 'once'").count() == 1
    monkeypatch.undo()
    run()
    assert sorted(map(str, map(tuple, whole_table(spark, target.table).collect()))) == ["(1, 'new')", "(2, 'b')", "(None, 'once')"]
    assert [int(r["sequence_start"]) for r in spark.table(target.registry).collect()] == [1]
    assert not spark.catalog.tableExists(f"{target.table}__before_release")
    save_table(spark.createDataFrame([(5, "e")], SCHEMA), target.table, "WRITE_APPEND")
    assert whole_table(spark, target.table).count() == 4 and "relops.shared" not in table_properties(spark, target.table)
