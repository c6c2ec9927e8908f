"""Settings of a repository scan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# fixed values: folders that a scan skips unless told otherwise
IGNORED_FOLDERS = (
    ".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", ".next",
    ".cache", ".idea", ".vscode", "bin", "obj", "target", "coverage", "Pods", "DerivedData",
)


# fixed values: names and defaults of settings; ``workerCount``, ``maxSearchFiles`` and ``theme`` are kept in the text and used by nothing here
@dataclass(frozen=True)
class Settings:
    ignoreFolders: list[str] = field(default_factory=lambda: list(IGNORED_FOLDERS))
    ignoreExtensions: list[str] = field(default_factory=list)
    maxFileSize: int = 4 * 2**20
    maxFileDepth: int = 0
    workerCount: int = 4
    maxSearchFiles: int = 20_000
    dupMinLines: int = 6
    dupMinSimilarity: float = 0.6
    theme: str = "dark"

    def validate(self) -> Settings:
        if not 1 <= self.workerCount <= 64:
            raise ValueError("workerCount must be between 1 and 64")
        if self.maxFileSize < 0 or self.maxFileDepth < 0 or self.maxSearchFiles < 0:
            raise ValueError("limits must not be negative")
        if self.dupMinLines < 1:
            raise ValueError("dupMinLines must be at least 1")
        if not 0 < self.dupMinSimilarity <= 1:
            raise ValueError("dupMinSimilarity must be above 0 and at most 1")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Missing and zero values take their defaults; unknown keys are ignored."""
        given = json.loads(text) if text else {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known and (v or k in ("maxFileDepth", "ignoreExtensions"))}).validate()

    def save(self, spark: SparkSession, path: str, key: str = "settings") -> None:
        """Writes the settings under a key of a table (``key``, ``value``); other keys stay."""
        row = spark.createDataFrame([(key, self.validate().to_json())], "key string, value string")
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "settings") -> Settings:
        """The settings under a key of a table that ``save`` wrote; the defaults if it has none."""
        found = spark.read.schema("value string, key string").parquet(path).where(F.col("key") == key).select("value").head(1)
        return cls.from_json(found[0].value if found else "")
