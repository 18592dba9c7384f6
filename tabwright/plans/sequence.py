"""Fitted sequences of operators with an optional model, and graphs of them."""

from __future__ import annotations

import json
import os
from typing import Any, Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..core import Splits, _config, get_operator, nn, q
from ..operators.rows import strip_upstream_dropped_columns
from .merging import merge_columns, merge_rows

META = ("transformer", "name")


def _step(step) -> tuple[str, dict]:
    if isinstance(step, (tuple, list)):
        return step[0], dict(step[1] if len(step) > 1 else {})
    return step.get("transformer") or step["operator"], dict(step.get("params") or {})


class Pipeline:
    """``Pipeline(steps, model).fit(df)`` fits each step on the training rows of the previous
    steps' plan; ``transform`` replays the fitted steps as one lazy plan."""

    def __init__(self, steps: Sequence, model: dict | None = None, target: str | None = None,
                 key_columns: Sequence[str] = ()):
        self.steps = [_step(s) for s in steps]
        self.model_spec = model
        self.target = target
        self.key_columns = list(key_columns)
        self.fitted: list[dict] = []
        self.model = None
        self.metrics: dict[str, Any] = {}
        self.thresholds = None

    def _cfg(self, cfg: dict) -> dict:
        base = {"key_columns": self.key_columns}
        if self.target:
            base["target_column"] = self.target
        return {**base, **cfg}

    def fit(self, df: DataFrame, evaluate: bool = True) -> "Pipeline":
        from ..models.evaluation import evaluate as score
        from ..models.learners import fit_model
        from ..operators.splitting import TrainTestSplitter
        parts = Splits(df)
        self.fitted, held = [], []
        for name, cfg in self.steps:
            op = get_operator(name)
            full = _config(op, self._cfg(cfg))
            if isinstance(op, TrainTestSplitter):
                art = op.fit(parts.train, full)
                parts = op.split(parts.train, art)
                parts.train = parts.train.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(parts.train)
            elif op.train_only:
                art = op.fit(parts.train, full)
                parts = Splits(op.apply(parts.train, art), parts.test, parts.validation)
            else:
                art, train = op.fit_apply_train(parts.train, full)
                parts = Splits(train, *(None if p is None else op.apply(p, art) for p in (parts.test, parts.validation)))
            self.fitted.append({"op": name, **art})
        self.parts = parts
        if self.model_spec:
            spec = dict(self.model_spec)
            name = spec.pop("type", None) or spec.pop("name")
            params = {**({"key_columns": self.key_columns} if self.key_columns else {}), **spec.pop("params", {}), **spec}
            self.model = fit_model(name, parts.train, params.pop("features", None), self.target, **params)
            if evaluate:
                self.metrics = {k: score(self.model, p) for k, p in
                                (("train", parts.train), ("test", parts.test), ("validation", parts.validation)) if p is not None}
        self._held = held
        return self

    def release(self) -> None:
        for d in getattr(self, "_held", []):
            d.unpersist()

    def transform(self, df: DataFrame) -> DataFrame:
        for art in self.fitted:
            op = get_operator(art["op"])
            if op.train_only:
                continue
            if df.isStreaming and not op.stateless:
                raise ValueError(f"{art['op']} needs the whole table and cannot run on a stream")
            df = op.apply(df, art)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        if self.target and self.target in df.columns:
            raise ValueError(f"drop the target column {self.target!r} before predicting")
        return self._predict(df)

    def _predict(self, df):
        from ..models.evaluation import apply_thresholds
        out = self.model.predict(self.transform(df))
        if self.thresholds is not None and self.model.task == "classification":
            out = apply_thresholds(out, "probability", self.thresholds, self.model.classes)
        return out

    def batch_predict(self, df: DataFrame, required: Sequence[str] | None = None, label_artifact: dict | None = None) -> DataFrame:
        """Check columns, drop the target, transform, predict, decode labels: one job."""
        need = list(required or [])
        absent = [c for c in need if c not in df.columns]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        out = self._predict(df.drop(self.target) if self.target and self.target in df.columns else df)
        if label_artifact:
            from ..operators.encoding import decode_labels
            out = decode_labels(out, "prediction", label_artifact, self.target, "prediction_label")
        return out

    def save(self, path: str) -> None:
        s = SparkSession.active()
        meta = {"steps": self.steps, "model": self.model_spec, "target": self.target, "key_columns": self.key_columns,
                "fitted": self.fitted, "metrics": self.metrics, "thresholds": self.thresholds}
        s.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "sequence"))
        if self.model is not None:
            self.model.save(os.path.join(path, "model"))

    @classmethod
    def load(cls, path: str) -> "Pipeline":
        from ..models.learners import load_model
        s = SparkSession.active()
        meta = json.loads(s.read.text(os.path.join(path, "sequence")).first()[0])
        p = cls([tuple(x) for x in meta["steps"]], meta["model"], meta["target"], meta["key_columns"])
        p.fitted, p.metrics, p.thresholds = meta["fitted"], meta["metrics"], meta["thresholds"]
        if meta["model"]:
            p.model = load_model(os.path.join(path, "model"))
        return p


def step_metrics(before: DataFrame, step: Callable[[DataFrame], DataFrame],
                 action=lambda d: d.write.format("noop").mode("overwrite").save()) -> dict:
    """Rows, missing cells and columns around a lazy step, both observed on the one job that runs it.

    ``step`` reads its frame once and runs no job of its own: fit before, apply here.
    """
    def probe(df, name):
        miss = F.lit(0)
        for c in df.columns:
            miss = miss + nn(df, c).isNull().cast("int")
        o = Observation(name)
        return df.observe(o, F.count(F.lit(1)).alias("rows"), F.sum(miss).alias("missing")), o
    watched, ob = probe(before, "before")
    after, oa = probe(step(watched), "after")
    action(after)
    a, b = oa.get, ob.get
    return {"rows_in": b["rows"], "rows_out": a["rows"], "missing_in": b["missing"] or 0, "missing_out": a["missing"] or 0,
            "columns_created": [c for c in after.columns if c not in before.columns],
            "columns_dropped": [c for c in before.columns if c not in after.columns]}


def run_graph(sources: dict[str, DataFrame], nodes: Sequence[dict], key: Sequence[str] | None = None) -> dict[str, Any]:
    """Nodes in order: ``{"id", "inputs", "operator", "params"}``; several inputs are merged by
    ``key`` (columns) or stacked (rows). Every node is a lazy frame; one with several readers is
    persisted so that it is computed once."""
    uses: dict[str, int] = {}
    for n in nodes:
        for i in n.get("inputs", []):
            uses[i] = uses.get(i, 0) + 1
    frames: dict[str, DataFrame] = dict(sources)
    arts: dict[str, dict] = {}
    for n in nodes:
        ins = [frames[i] for i in n.get("inputs", [])]
        if len(ins) > 1:
            if key and n.get("merge", "columns") == "columns":
                df = merge_columns(ins, key, n.get("strategy", "last_wins"))
                if n.get("baseline"):
                    df = strip_upstream_dropped_columns(df, frames[n["baseline"]].columns, [f.columns for f in ins])
            else:
                df = merge_rows(ins)[0]
        else:
            df = ins[0]
        if n.get("operator"):
            op = get_operator(n["operator"])
            cfg = _config(op, {"key_columns": list(key or []), **(n.get("params") or {})})
            arts[n["id"]], df = op.fit_apply_train(df, cfg)
        frames[n["id"]] = df.persist(StorageLevel.MEMORY_AND_DISK) if uses.get(n["id"], 0) > 1 else df
    return {"frames": frames, "artifacts": arts}
