"""Tree models: the text format of gradient-boosted trees, its checks, and scores in Python and as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Malformed(ValueError):
    pass


@dataclass(frozen=True)
class Tree:
    """Children below zero are leaves: ~child is the leaf's number. A tree of one leaf has no nodes."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    leaf: tuple[float, ...]


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    features: int
    objective: str = ""
    sigmoid: float = 1.0

    def raw(self, x: list[float]) -> float:
        """Sum over trees in order, in single precision (M7)."""
        total, single = 0.0, np.float32
        x = np.asarray(x, single).tolist()
        for start, feature, threshold, left, right, leaf in self._rounded:
            k = start
            while k >= 0:
                k = left[k] if x[feature[k]] <= threshold[k] else right[k]
            total = float(single(total + leaf[~k]))  # a sum of two singles, rounded from double, is their sum in single
        return total

    @cached_property
    def _rounded(self) -> list[tuple]:
        """The trees with numbers of single precision, as Python's own."""
        single = lambda v: np.asarray(v, np.float32).tolist()
        return [(0 if t.feature else -1, t.feature, single(t.threshold), t.left, t.right, single(t.leaf)) for t in self.trees]

    def score(self, x: list[float]) -> float:
        """A probability for binary objectives, else the raw sum (M8)."""
        raw = self.raw(x)
        return 1 / (1 + math.exp(-self.sigmoid * raw)) if self.objective.startswith("binary") else raw

    def raw_column(self, columns: list[Column]) -> Column:
        """The sum as nested CASE expressions, all in single precision."""
        if len(columns) != self.features:
            raise ValueError(f"the model has {self.features} features, not {len(columns)}")

        def walk(t: Tree, k: int) -> Column:
            if k < 0:
                return F.lit(float(np.float32(t.leaf[~k]))).cast("float")
            below = columns[t.feature[k]].cast("float") <= F.lit(float(np.float32(t.threshold[k]))).cast("float")
            return F.when(below, walk(t, t.left[k])).otherwise(walk(t, t.right[k]))

        return reduce(lambda a, b: (a + b).cast("float"), [walk(t, 0 if t.feature else -1) for t in self.trees])

    def score_column(self, columns: list[Column]) -> Column:
        raw = self.raw_column(columns).cast("double")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.sigmoid * raw)) if self.objective.startswith("binary") else raw


def _numbers(text: str, kind: type) -> tuple:
    try:
        return tuple(kind(x) for x in text.split())
    except ValueError as e:
        raise Malformed(str(e)) from e


def parse(text: str) -> Model:
    """Reads a dump (M2 to M6). Only single-output numerical trees without handling of missing values are accepted."""
    head: dict[str, str] = {}
    trees: list[dict[str, str]] = []
    into = head
    for line in text.splitlines():
        line = line.strip()
        if line == "end of trees":
            break
        key, eq, value = line.partition("=")
        if not eq:
            continue
        if key == "Tree":
            into = {}
            trees.append(into)
        else:
            into[key] = value
    for key in ("num_class", "num_tree_per_iteration"):
        if head.get(key, "1") != "1":
            raise Malformed(f"{key} is {head[key]}; only 1 is supported")
    if "max_feature_idx" not in head:
        raise Malformed("max_feature_idx is missing")
    features = _numbers(head["max_feature_idx"], int)[0] + 1
    if not trees:
        raise Malformed("no trees")
    objective = head.get("objective", "")
    sigmoid = next((_numbers(w.partition(":")[2], float)[0] for w in objective.split() if w.startswith("sigmoid:")), 1.0)
    return Model(tuple(_tree(t, features) for t in trees), features, objective, sigmoid)


def _tree(t: dict[str, str], features: int) -> Tree:
    for key in ("num_cat", "is_linear"):
        if t.get(key, "0") != "0":
            raise Malformed(f"{key} is {t[key]}; only 0 is supported")
    (leaves,) = _numbers(t.get("num_leaves", ""), int) or (0,)
    n = leaves - 1
    leaf = _numbers(t.get("leaf_value", ""), float)
    if leaves < 1 or len(leaf) != leaves:
        raise Malformed(f"{len(leaf)} leaf values for {leaves} leaves")
    feature, left, right, kinds = (_numbers(t.get(k, ""), int) for k in ("split_feature", "left_child", "right_child", "decision_type"))
    threshold = _numbers(t.get("threshold", ""), float)
    if n == 0:
        return Tree((), (), (), (), leaf)
    if any(len(x) != n for x in (feature, left, right, threshold)) or kinds and len(kinds) != n:
        raise Malformed(f"arrays of a tree of {leaves} leaves must have {n} values")
    for d in kinds:
        if d & 1:
            raise Malformed("categorical splits are not supported")
        if d >> 2 & 3:
            raise Malformed("missing values are not supported")
    if any(not 0 <= f < features for f in feature):
        raise Malformed("a split's feature is out of range")
    children = [*left, *right]
    if any(not -leaves <= c < n for c in children):
        raise Malformed("a child is out of range")
    if sorted(children) != [*range(-leaves, 0), *range(1, n)]:
        raise Malformed("each node but the root, and each leaf, must have one parent")
    return Tree(feature, threshold, left, right, leaf)


def dump(model: Model) -> str:
    """The text that ``parse`` reads."""
    out = ["tree", "version=v4", "num_class=1", "num_tree_per_iteration=1", f"max_feature_idx={model.features - 1}", f"objective={model.objective}", ""]
    words = lambda xs: " ".join(repr(x) for x in xs)
    for k, t in enumerate(model.trees):
        out += [f"Tree={k}", f"num_leaves={len(t.leaf)}", "num_cat=0"]
        if t.feature:
            out += [f"split_feature={words(t.feature)}", f"threshold={words(t.threshold)}", f"decision_type={words([0] * len(t.feature))}", f"left_child={words(t.left)}", f"right_child={words(t.right)}"]
        out += [f"leaf_value={words(t.leaf)}", "is_linear=0", ""]
    return "\n".join([*out, "end of trees", ""])


def from_spark(gbt) -> Model:
    """A fitted binary GBT of Spark ML: its probability is the logistic of twice the weighted sum of its trees."""
    trees = []
    for tree, weight in zip(gbt.trees, gbt.treeWeights, strict=True):
        feature, threshold, left, right, leaf = [], [], [], [], []

        def walk(node) -> int:
            if node.getClass().getSimpleName() == "LeafNode":
                leaf.append(float(weight * node.prediction()))
                return ~(len(leaf) - 1)
            k = len(feature)
            feature.append(int(node.split().featureIndex()))
            threshold.append(float(node.split().threshold()))
            left.append(0)
            right.append(0)
            left[k] = walk(node.leftChild())
            right[k] = walk(node.rightChild())
            return k

        walk(tree._call_java("rootNode"))
        trees.append(Tree(*map(tuple, (feature, threshold, left, right, leaf))))
    return Model(tuple(trees), gbt.numFeatures, "binary sigmoid:2", 2.0)
