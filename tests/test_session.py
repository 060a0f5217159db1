from __future__ import annotations


def test_checkpoint_dir_prefers_session_setting(spark, tmp_path):
    from sparkmarts.session import checkpoint_dir

    sc = spark.sparkContext
    preset = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    first = checkpoint_dir(spark, fallback=str(tmp_path / "ck"))
    if preset:
        assert first == preset
    else:
        assert str(tmp_path / "ck") in first
    # once set, the session's folder wins over any later fallback
    assert checkpoint_dir(spark, fallback=str(tmp_path / "other")) == first
