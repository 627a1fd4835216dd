from pathlib import Path

import pytest

from tidewire.plans import materialize


def test_tables_are_stored_and_cleared(spark):
    t = materialize.Stored(spark.range(5), "t")
    assert t.df.count() == 5 and Path(t.path).exists()
    t.drop()
    assert not Path(t.path).exists()
    assert materialize.cut(spark.range(0)).count() == 0
    materialize.clear(spark)
    assert not Path(materialize.own_dir(spark)).exists()


def test_only_the_result_of_a_step_stays(spark):
    made = []

    def build():
        made.append(materialize.Stored(spark.range(3), "inner"))
        return made[0].df.where("id > 0")

    assert materialize.settled(build, "step").count() == 2
    assert not Path(made[0].path).exists()


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError):
        materialize.shared_dir(Session())


def test_arrow_batches_are_small_while_a_table_is_written(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def seen():
        return spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")

    was = spark.conf.get(materialize.ARROW_ROWS)
    assert sorted(r.n for r in materialize.cut(seen(), "t", 1000).collect()) == [500, 1000, 1000]
    assert spark.conf.get(materialize.ARROW_ROWS) == was
    assert materialize.cut(seen()).count() == 1


def test_texts_of_a_batch_are_taken_a_few_at_a_time():
    import pyarrow as pa

    from tidewire.llm.batches import few

    b = pa.RecordBatch.from_arrays([pa.array(range(600))], ["n"])
    parts = list(few([b, b.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [250, 250, 100] and pa.Table.from_batches(parts) == pa.Table.from_batches([b]).slice(0)
