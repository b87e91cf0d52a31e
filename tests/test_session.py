import pytest

from seika.session import refuse_local_folder


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[8]", "local[*]"):
        refuse_local_folder(master)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            refuse_local_folder(master)
