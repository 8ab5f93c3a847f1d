import os

from airseries.llm import exact_dedup, simhash_bk
from airseries.llm.common import run_folder, shared_folder
from airseries.session import checkpoint_dir
from tests.llm import cases


def test_a_run_leaves_no_folder_behind(spark, tmp_path):
    top = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    with run_folder(spark) as folder:
        kept = exact_dedup.drop_exact_duplicates(cases.documents(spark))
        simhash_bk.drop_near_duplicates(kept).write.parquet(f"{tmp_path}/out")
        assert os.listdir(folder.removeprefix("file:"))
    assert set(os.listdir(top)) <= before | {n for n in os.listdir(top) if not n.startswith("llm-")}
    assert not os.path.exists(folder.removeprefix("file:"))
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert not shared_folder(spark, "x").startswith(folder)
