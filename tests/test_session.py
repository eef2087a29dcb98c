import pytest

from ledgerloom.session import _CUTS, checkpoint_root, cut, release_cuts


def test_cut_and_release(spark):
    release_cuts(spark)
    df = cut(spark.range(5).withColumnRenamed("id", "key"))
    assert df.count() == 5 and df.columns == ["key"] and len(_CUTS) == 1
    assert _CUTS[0].startswith(checkpoint_root(spark))
    assert cut(df.limit(0)).count() == 0
    assert release_cuts(spark) == 2 and not _CUTS
    with pytest.raises(Exception, match="exist|found|NOT_FOUND|FAILED_READ"):
        df.count()
