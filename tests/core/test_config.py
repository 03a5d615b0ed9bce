import pytest

from voxmill.config import EngineConfig


def test_overrides_go_before_the_file_before_defaults(tmp_path, monkeypatch):
    path = str(tmp_path / "c.toml")
    EngineConfig(master="local[2]", shuffle_partitions=7, spark={"spark.ui.enabled": "false"}).write(path)
    c = EngineConfig.load(path, shuffle_partitions=9)
    assert (c.master, c.shuffle_partitions, c.adaptive, c.spark) == ("local[2]", 9, True, {"spark.ui.enabled": "false"})
    monkeypatch.setenv("VOXMILL_CONFIG", path)
    assert EngineConfig.load().settings()["spark.sql.shuffle.partitions"] == "7"
    with pytest.raises(ValueError, match="unknown"):
        EngineConfig.load(path, nonsense=1)
