import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from caseledger.session import build_session
    s = build_session("local[2]", app="caseledger-tests", shuffle_partitions=4)
    ckpt = str(tmp_path_factory.mktemp("ckpt"))
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(ckpt)
    yield s


def listing_rows(spark, entries, root="r"):
    """Listing from (path, is_folder) pairs; ids are the paths."""
    from caseledger.schema import FOLDER_MIME, LISTING
    rows = []
    for path, is_folder in entries:
        name = path.rsplit("/", 1)[-1]
        parent = path.rsplit("/", 1)[0] if "/" in path else root
        rows.append((root, path, name, parent, path, is_folder,
                     FOLDER_MIME if is_folder else "", None if is_folder else 1, "", "", False,
                     "local"))
    return spark.createDataFrame(rows, LISTING)
