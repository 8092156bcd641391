import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with columns an operator has no use for."""

    def make(rows, **more):
        fields = ["doc_id long", "text string", "size long", "component_id string", "n long", "a string"]
        full = [(i, t, -1, "x", 7, None) for i, t in rows]
        return spark.createDataFrame(full, ", ".join(fields))

    return make
