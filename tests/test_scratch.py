"""Tables that are written between the steps of a query."""

import os
import time

from rulequarry.session import CLEANUP, Scratch


def test_shuffle_files_go_when_a_table_is_written(spark):
    dirs = [str(x) for x in spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    scratch, before, asked = Scratch(spark, "shuffle"), files(), spark.conf.get(CLEANUP, None)
    held = spark.range(10_000).repartition(7, "id")  # as long as a plan is held no garbage collection takes its files
    kept = scratch.keep(held)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP, None) == asked
    assert kept.count() == held.count() == 10_000
