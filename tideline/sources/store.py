"""Models, metadata and bandit state on any file system that Spark reaches."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandit
from ..operators.models import Classifier


def home(path: str | None = None) -> str:
    return path or os.environ.get("TIDELINE_HOME") or os.path.join(os.path.expanduser("~"), ".tideline")


def plain(value: Any) -> Any:
    """As JSON can hold it: numbers of numpy as Python's, arrays and series as lists, at any depth; NaN and infinity as text."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


class Store:
    """Directories of models with a metadata file each, under a root of any file system of Hadoop's."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, home(root).rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/models/{name}/metadata.json")
        return bool(fs.exists(p))

    def save(self, model: Classifier, name: str, metadata: Mapping | None = None, *, config: Mapping | None = None, metrics: Mapping | None = None) -> str:
        path = f"{self.root}/models/{name}"
        if model.model is not None:
            model.model.write().overwrite().save(f"{path}/model")
        own = {k: getattr(model, k) for k in ("features", "label", "kind", "trees", "depth", "least", "rate", "weight", "seed", "classes")}
        said = {"name": name, "saved_at": datetime.now(timezone.utc).isoformat(), "model_type": type(model).__name__, "model_path": path, "settings": own, "fitted": model.model is not None, **(metadata or {})}
        said |= {"config": config} if config is not None else {}
        said |= {"metrics": metrics} if metrics is not None else {}
        self._write(f"{path}/metadata.json", json.dumps(plain(said)))
        return path

    def metadata(self, name: str) -> dict:
        return json.loads(self._read(f"{self.root}/models/{name}/metadata.json"))

    def load(self, name: str) -> Classifier:
        said = self.metadata(name)
        own = dict(said["settings"])
        classes = own.pop("classes")
        model = Classifier(own.pop("features"), **own)
        model.classes = [int(c) for c in classes]
        model.model = PipelineModel.load(f"{self.root}/models/{name}/model") if said["fitted"] else None
        return model

    def names(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/models")
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if s.isDirectory() and self.exists(n := s.getPath().getName()))

    def delete(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/models/{name}")
        return bool(fs.delete(p, True))

    def info(self, name: str) -> dict:
        fs, p = self._fs(f"{self.root}/models/{name}")
        return {**self.metadata(name), "size_mb": fs.getContentSummary(p).getLength() / 1e6}

    # Ensembles: (strategy, regime) to primary and meta model -----------------------------

    def save_ensemble(self, symbol: str, models: Mapping[tuple[str, str], Mapping[str, Classifier]], metadata: Mapping | None = None) -> None:
        """One directory for each strategy, regime and role; the table of them is written last."""
        listed = []
        for (strategy, regime), roles in models.items():
            for role, model in roles.items():
                name = f"{symbol}/strategy={strategy}/regime={regime}/role={role}"
                self.save(model, name)
                listed.append({"strategy": strategy, "regime": regime, "role": role, "name": name})
        self._write(f"{self.root}/ensembles/{symbol}.json", json.dumps(plain({"symbol": symbol, "saved_at": datetime.now(timezone.utc).isoformat(), "models": listed, **(metadata or {})})))

    def load_ensemble(self, symbol: str) -> dict[tuple[str, str], dict[str, Classifier]] | None:
        """None if there is none; models that are gone are passed over."""
        try:
            said = json.loads(self._read(f"{self.root}/ensembles/{symbol}.json"))
        except FileNotFoundError:
            return None
        out: dict[tuple[str, str], dict[str, Classifier]] = {}
        for m in said["models"]:
            if self.exists(m["name"]):
                out.setdefault((m["strategy"], m["regime"]), {})[m["role"]] = self.load(m["name"])
        return out

    def trained_symbols(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/ensembles")
        return sorted(s.getPath().getName().removesuffix(".json") for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def delete_ensemble(self, symbol: str) -> bool:
        fs, p = self._fs(f"{self.root}/ensembles/{symbol}.json")
        self.delete(symbol)
        return bool(fs.delete(p, False))

    # Bandit arms -------------------------------------------------------------------------

    def _versions(self, symbol: str) -> list[int]:
        """Numbers of the tables of arms that were written whole."""
        fs, p = self._fs(f"{self.root}/arms/{symbol}/version=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in fs.globStatus(p) or ())

    def save_arms(self, symbol: str, arms: DataFrame) -> None:
        """As a new version, so that arms read from the last one can be written; the one before stays, older ones go."""
        before = self._versions(symbol)
        arms.coalesce(1).write.parquet(f"{self.root}/arms/{symbol}/version={max(before, default=-1) + 1}")
        for old in before[:-1]:
            fs, p = self._fs(f"{self.root}/arms/{symbol}/version={old}")
            fs.delete(p, True)

    def load_arms(self, symbol: str) -> DataFrame | None:
        found = self._versions(symbol)
        return self.spark.read.parquet(f"{self.root}/arms/{symbol}/version={found[-1]}") if found else None

    def update_arms(self, symbol: str, outcomes: DataFrame, **how) -> DataFrame:
        """The symbol's arms after outcomes (strategy, regime, reward, ts), kept; the outcomes go to the history."""
        arms = self.load_arms(symbol)
        self.save_arms(symbol, bandit.batch_update(bandit.fresh(outcomes) if arms is None else arms, outcomes, **how))
        outcomes.select("strategy", "regime", "reward", "ts").withColumn("update", F.lit(self._versions(symbol)[-1])).write.mode("append").parquet(f"{self.root}/rewards/{symbol}")
        return self.load_arms(symbol)

    def rewards(self, symbol: str) -> DataFrame | None:
        """strategy, regime, reward, ts, update of every outcome that update_arms() took."""
        fs, p = self._fs(f"{self.root}/rewards/{symbol}")
        return self.spark.read.parquet(f"{self.root}/rewards/{symbol}") if fs.exists(p) else None
