import os
import subprocess
import sys
import threading
import time

from pyspark.sql import functions as F

from lexhound.llm.common import Scratch, materialise, row_hash


def _folder(df):
    return df.inputFiles()[0].split(":", 1)[1].replace("///", "/").rsplit("/", 1)[0]


def test_scratch_owns_what_its_context_writes(spark):
    df = spark.range(10)
    outside = materialise(df, "outside")
    with Scratch(spark) as own:
        first, second = materialise(df, "first"), materialise(df, "second")
        others = []

        def elsewhere():
            with Scratch(spark) as theirs:
                others.append(materialise(df, "theirs"))
            assert len(theirs.paths) == 1

        thread = threading.Thread(target=elsewhere)
        thread.start()
        thread.join()
        with Scratch(spark) as inner:
            third = materialise(df, "third")
            gone = _folder(third)
            assert os.path.exists(gone)
        inner.remove()
    folders = {t: _folder(t) for t in (outside, first, second, others[0])}
    own.remove(but=second)
    assert [os.path.exists(folders[t]) for t in (outside, first, second, others[0])] == [True, False, True, True]
    assert not os.path.exists(gone) and second.count() == 10
    own.remove()
    assert not os.path.exists(folders[second]) and own.paths == []


def test_row_hash_tells_nulls_from_what_is_beside_them(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, "a", "a"), (1, "a", "a")], "a long, b string, c string").withColumn("m", F.create_map(F.lit("k"), F.col("b")))
    assert df.select(row_hash(df).alias("h")).distinct().count() == 3


def test_what_no_scratch_removes_goes_with_the_session(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        f"spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "from lexhound.llm.common import materialise\n"
        "assert materialise(spark.range(3), 'left').count() == 3\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    for _ in range(50):
        if not list(tmp_path.glob("left-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("left-*"))
