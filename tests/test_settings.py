import pytest

import __spark_entry__ as entry
from wayloom.plans import extraction


@pytest.mark.parametrize("name, call, at", [("extracted_graph", "extract_graph", 3), ("image_adjacency", "image_graph", 4)])
def test_true_radii(spark, monkeypatch, name, call, at):
    class Seen(Exception):
        pass

    def stop(*args, **_):
        raise Seen(args[at])

    monkeypatch.setattr(extraction, call, stop)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == extraction.Options()
