import threading

import pytest

from eventsift.storage import discard, materialise, scratch, settled


def test_scopes_belong_to_their_thread(spark):
    listed, written = threading.Event(), threading.Event()
    seen = {}

    def background():
        with scratch() as paths:
            listed.set()
            written.wait(60)
            materialise(spark.range(2), "inner")
            seen["paths"] = list(paths)
        discard(spark, paths)

    thread = threading.Thread(target=background)
    thread.start()
    listed.wait(60)
    table = materialise(spark.range(3), "outer")
    written.set()
    thread.join()
    assert len(seen["paths"]) == 1 and "/inner-" in seen["paths"][0]
    assert table.count() == 3


def test_nested_empty_scopes_keep_the_outer_one(spark):
    with scratch() as outer:
        with scratch() as inner:
            pass
        materialise(spark.range(1), "late")
    assert len(outer) == 1 and inner == []
    materialise(spark.range(1), "after")
    assert len(outer) == 1
    discard(spark, outer)


def test_settled_leaves_the_result_only(spark):
    kept = {}

    def build():
        kept["table"] = materialise(spark.range(5), "step")
        return kept["table"].where("id > 1")

    with scratch() as paths:
        assert settled(spark, build).count() == 3
    assert len(paths) == 1 and "/result-" in paths[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        kept["table"].count()

    def failing():
        kept["table"] = materialise(spark.range(5), "step")
        raise ValueError("no")

    with pytest.raises(ValueError):
        settled(spark, failing)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        kept["table"].count()
