"""operator 7 keeps no tables that it is done with, and each round deals its own groups only."""

import os

import numpy as np

from roadloom.llm import common, suffixdedup


def test_rounds_share_the_groups():
    lead = np.arange(0, 1 << 63, 1 << 56, dtype=np.uint64) * np.uint64(2)
    turns = [suffixdedup._mine(lead, 7, t) for t in range(suffixdedup.ROUNDS)]
    assert (np.sum(turns, axis=0) == 1).all() and all(t.any() for t in turns)


def test_only_the_last_table_stays(spark):
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, f"{i} " + "a passage of more than fifty bytes that all documents share, word by word") for i in range(5)], "doc_id long, text string")
    assert [len(r.spans) for r in suffixdedup.removed(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1, 1]
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"spans"}
