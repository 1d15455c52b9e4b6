"""Fitted boosted trees as one SQL expression over the model's raw input columns.

The expression needs no index columns, vectors or pipeline, so it scores tables and streams inside a
projection; a portable form of its text is plain SQL that other engines read as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel

# The three kinds of line in the printed form of a fitted tree model.
_TREE = re.compile(r"Tree \d+ \(weight (.+)\):")
_SPLIT = re.compile(r"If \(feature (\d+) (<=|in) \{?([^}]*?)\}?\)")
_LEAF = "Predict: "


def _number(text: str) -> str:
    """A literal that SQL reads as a double, not as a decimal."""
    value = repr(float(text))
    return value if "e" in value else f"{value}e0"


def _name(column: str) -> str:
    if not column.isidentifier():
        raise ValueError(f"{column!r} would need quotes, which differ between SQL dialects")
    return column


def _member(indexer: StringIndexerModel, left: set[int], escape: bool) -> str:
    """Whether a value's index is in ``left``. Null and unknown values have the index after the last."""
    if indexer.getHandleInvalid() != "keep":
        raise ValueError("only indexers that keep unknown values can be compiled")
    labels = list(indexer.labels)
    unknown = len(labels) in left
    listed = [v for i, v in enumerate(labels) if (i in left) != unknown]
    if not listed:
        return "true" if unknown else "false"
    quoted = ", ".join("'" + (v.replace("\\", "\\\\") if escape else v).replace("'", "''") + "'" for v in listed)
    value = f"CAST({_name(indexer.getInputCol())} AS string)"
    return f"coalesce({value} NOT IN ({quoted}), true)" if unknown else f"{value} IN ({quoted})"


def _walk(lines: Iterator[str], goes_left: Callable[[int, str, str], str]) -> str:
    line = next(lines)
    if line.startswith(_LEAF):
        return _number(line.removeprefix(_LEAF))
    feature, kind, value = _SPLIT.fullmatch(line).groups()
    left = _walk(lines, goes_left)
    next(lines)  # the Else of this test
    right = _walk(lines, goes_left)
    return f"CASE WHEN {goes_left(int(feature), kind, value)} THEN {left} ELSE {right} END"


def expression(model: PipelineModel, portable: bool = False) -> str:
    """The prediction of a pipeline of string indexers, an assembler and boosted trees, as SQL text.

    Missing numbers go right at every test and missing or unknown categories take the place the
    indexers keep for them, as in the pipeline. The text for Spark adds the trees up as an array: as one
    sum they would be generated as one method, too long for the JVM to compile. ``portable`` gives the
    plain sum, with backslashes in string literals as they are, for other engines.
    """
    indexers = {s.getOutputCol(): s for s in model.stages if isinstance(s, StringIndexerModel)}
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    fitted = next(s for s in model.stages if isinstance(s, GBTRegressionModel))

    def goes_left(feature: int, kind: str, value: str) -> str:
        column = inputs[feature]
        if kind == "in":
            return _member(indexers[column], {int(float(x)) for x in value.split(",")}, not portable)
        if column in indexers:
            raise ValueError(f"{column} is split as a number, not by category")
        return f"CAST({_name(column)} AS double) <= {_number(value)}"

    lines = (line.strip() for line in fitted.toDebugString.splitlines()[1:] if line.strip())
    terms = [f"{_number(_TREE.fullmatch(line).group(1))} * ({_walk(lines, goes_left)})" for line in lines]
    if portable:
        return " + ".join(terms)
    return f"aggregate(array({', '.join(terms)}), 0e0, (total, tree) -> total + tree)"
