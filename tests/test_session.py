"""The shared folder: read from the session, made only for a local master."""

import pytest

from scour.session import Stages, checkpoint_dir, discard, scratch_path


class FakeSession:
    class conf:
        @staticmethod
        def get(key, default):
            return default

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}",
                                           "getCheckpointDir": lambda self: None})()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        checkpoint_dir(FakeSession(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_one_folder_for_a_local_master(master):
    session = FakeSession(master)
    assert checkpoint_dir(session) == checkpoint_dir(session)


def test_stages_are_deleted_and_only_they(spark):
    stages = Stages(spark)
    df = stages.write(spark.range(5), "numbers")
    assert df.count() == 5
    path = stages.paths[0]
    assert path.startswith(checkpoint_dir(spark))
    stages.clear()
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        discard(spark, "/somewhere/else")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
