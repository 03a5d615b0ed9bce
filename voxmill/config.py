"""Engine settings: overrides before a TOML file before defaults, applied as Spark settings."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """``master`` picks the backend; ``spark`` holds further settings as they are."""

    master: str = "local[*]"
    app_name: str = "voxmill"
    shuffle_partitions: int = 200
    max_partition_bytes: str = "128m"
    adaptive: bool = True
    checkpoint_dir: str | None = None
    spark: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, **overrides) -> EngineConfig:
        """From the file at ``path`` (or $VOXMILL_CONFIG, if there is one) and ``overrides``; unknown keys are errors."""
        path, found = path or os.environ.get("VOXMILL_CONFIG"), {}
        if path:
            with open(path, "rb") as f:
                found = tomllib.load(f)
        found |= {k: v for k, v in overrides.items() if v is not None}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(found) - known):
            raise ValueError(f"unknown settings {unknown}; known: {sorted(known)}")
        return cls(**found)

    def write(self, path: str) -> None:
        """As TOML, one setting a line."""
        lines, tail = [], []
        for k, v in asdict(self).items():
            if isinstance(v, dict):
                tail += [f"[{k}]", *[f'"{a}" = "{b}"' for a, b in v.items()]] if v else []
            elif v is not None:
                lines.append(f"{k} = {str(v).lower() if isinstance(v, bool) else v if isinstance(v, int) else chr(34) + v + chr(34)}")
        with open(path, "w") as f:
            f.write("\n".join([*lines, *tail]) + "\n")

    def settings(self) -> dict[str, str]:
        out = {
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.files.maxPartitionBytes": self.max_partition_bytes,
            "spark.sql.adaptive.enabled": str(self.adaptive).lower(),
            "spark.sql.session.timeZone": "UTC",
            "spark.executorEnv.OMP_NUM_THREADS": "1",
        }
        return out | ({"spark.checkpoint.dir": self.checkpoint_dir} if self.checkpoint_dir else {}) | {k: str(v) for k, v in self.spark.items()}


def get_session(config: EngineConfig | None = None) -> SparkSession:
    """A session with the settings of ``config``."""
    config = config or EngineConfig.load()
    return SparkSession.builder.master(config.master).appName(config.app_name).config(map=config.settings()).getOrCreate()
