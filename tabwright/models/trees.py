"""Decision trees as plain data and as column expressions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F


def tree_nodes(model) -> dict:
    """Nested dict of a fitted Spark ML tree: feature, threshold or categories, children, leaf values."""
    def walk(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return {"value": float(n.prediction()), "impurity": float(n.impurity())}
        s = n.split()
        out = {"feature": int(s.featureIndex()), "left": walk(n.leftChild()), "right": walk(n.rightChild()),
               "gain": float(n.gain())}
        if s.getClass().getSimpleName() == "ContinuousSplit":
            out["threshold"] = float(s.threshold())
        else:
            out["in"] = [float(v) for v in s.leftCategories()]
        return out
    return walk(model._java_obj.rootNode())


def tree_expression(node: dict, feature: Callable[[int], Column]) -> Column:
    if "value" in node:
        return F.lit(node["value"])
    x = feature(node["feature"])
    go_left = x <= F.lit(node["threshold"]) if "threshold" in node else x.isin(node["in"])
    return F.when(go_left, tree_expression(node["left"], feature)).otherwise(tree_expression(node["right"], feature))


def tree_rules(node: dict, names: list[str], label: Callable[[float], str], path: tuple = ()) -> list[str]:
    if "value" in node:
        return [(" AND ".join(path) or "always") + f" => {label(node['value'])}"]
    n = names[node["feature"]]
    t = f"{node['threshold']:.4f}" if "threshold" in node else str(node["in"])
    a, b = ("<=", ">") if "threshold" in node else ("in", "not in")
    return (tree_rules(node["left"], names, label, path + (f"{n} {a} {t}",))
            + tree_rules(node["right"], names, label, path + (f"{n} {b} {t}",)))
