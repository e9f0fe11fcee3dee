"""Categorical encoding: one-hot, random sign codes and feature hashing, with their inverse."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from enum import Enum, auto
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.random_hash import GOLDEN, MULT1, MULT2
from nearfield.operators.knn import matrix

U = np.uint64


class DimKind(Enum):
    CONTINUOUS = auto()
    CATEGORICAL = auto()


class CatEncoding(Enum):
    ONE_HOT = auto()
    RADEMACHER = auto()
    AUTO = auto()


def _is_a(value: object, kind: type, label: str) -> object:
    if not isinstance(value, kind):
        raise TypeError(f"{label} must be a {kind.__name__}, got {value!r}")
    return value


def _width(value: int, upper: float, name: str) -> int:
    if not 1 <= value <= upper:
        raise ValueError(f"{name} must be in 1..{upper}")
    return int(value)


def log_code_width(card: int, dim_cap: int = 48) -> int:
    """Bits that keep codes of ``card`` ids apart: about twice the logarithm, capped."""
    _width(dim_cap, 64, "dim_cap")
    if card < 1:
        raise ValueError("card must be >= 1")
    return 1 if card == 1 else min(dim_cap, math.ceil(2 * math.log2(card) + 7))


def column_plan(card: int, encoding: CatEncoding = CatEncoding.AUTO, dim_cap: int = 48) -> tuple[int, str]:
    """(width, style) of a column with ids 0..card-1."""
    _is_a(encoding, CatEncoding, "encoding")
    if card < 1:
        raise ValueError("card must be >= 1")
    if encoding is CatEncoding.ONE_HOT:
        return card, "onehot"
    wide = log_code_width(card, dim_cap)
    return (wide, "code") if encoding is CatEncoding.RADEMACHER or card > wide else (card, "onehot")


def id_hash(ids: object, variable: int, seed: int) -> np.ndarray:
    """A 64-bit mix of id, variable and seed."""
    with np.errstate(over="ignore"):
        x = np.asarray(ids, np.int64).view(np.uint64) ^ U(seed) ^ (U(variable) * GOLDEN)
        x = (x ^ (x >> U(30))) * MULT1
        x = (x ^ (x >> U(27))) * MULT2
    return x ^ (x >> U(31))


def sign_code(ids: object, variable: int, width: int, seed: int, separation: float) -> np.ndarray:
    bits = (id_hash(ids, variable, seed)[:, None] >> np.arange(width, dtype=np.uint64)) & U(1)
    return np.where(bits == 1, 1.0, -1.0) * (separation / math.sqrt(width))


# ------------------------------------------------------------------ columns


def one_hot_column(ids: Column, card: int, separation: float = 10.0) -> Column:
    """An id column as an array with ``separation`` at the id; ids outside fail the query."""
    bad = (ids < 0) | (ids >= card) | ids.isNull()
    hot = F.transform(F.sequence(F.lit(0), F.lit(card - 1)), lambda j: F.when(j == ids, float(separation)).otherwise(0.0))
    return F.when(~bad, hot).otherwise(F.raise_error(F.lit("one-hot ids must be in 0..card-1")).cast("array<double>"))


@lru_cache(64)
def _code_udf(variable: int, width: int, seed: int, separation: float):
    def code(ids: pd.Series) -> pd.Series:
        return pd.Series(list(sign_code(ids.to_numpy(np.int64), variable, width, seed, separation)))

    return F.pandas_udf(code, "array<double>")


def sign_code_column(ids: Column, variable: int, width: int, seed: int = 0, separation: float = 10.0) -> Column:
    return _code_udf(variable, width, seed, separation)(ids.cast("long"))


@lru_cache(64)
def _hash_udf(width: int, seed: int):
    def spread(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(hash_rows(np.stack(rows.to_list()).astype(np.int64), width, seed)))

    return F.pandas_udf(spread, "array<double>")


def hash_columns(ids: Sequence[Column], width: int, seed: int = 0) -> Column:
    """Several id columns added with random signs into one block."""
    return _hash_udf(width, seed)(F.array(*[c.cast("long") for c in ids]))


def hash_rows(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    out = np.zeros((len(ids), width))
    step = 1 / math.sqrt(max(1, ids.shape[1]))
    for j in range(ids.shape[1]):
        h = id_hash(ids[:, j], j, seed)
        np.add.at(out, (np.arange(len(ids)), (h % U(width)).astype(np.int64)), np.where(h >> U(63) == 1, step, -step))
    return out


def snap_table(encoded: DataFrame, codes: DataFrame) -> DataFrame:
    """``encoded(row_id, code)`` and ``codes(id, at, code)``, one row per id of the domain ->
    ``(row_id, id)``: the id with the greatest dot product, the first of equals."""
    domain = codes.select("id", "at", "code").orderBy("at").collect()  # declared by hand
    schema = T.StructType([encoded.schema["row_id"], codes.schema["id"]])
    if not domain:
        return encoded.sparkSession.createDataFrame([], schema)
    ids, table = pa.array([r["id"] for r in domain]), np.array([r["code"] for r in domain], float)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), table.shape[1])
            dot = np.zeros((len(x), len(table)))
            for j in range(table.shape[1]):
                dot += x[:, j, None] * table[None, :, j]
            yield pa.RecordBatch.from_arrays([b.column(0), ids.take(pa.array(dot.argmax(axis=1)))], names=schema.names)

    return encoded.select("row_id", F.col("code").cast("array<double>")).mapInArrow(pick, schema)


# ------------------------------------------------------------------ arrays


class TiedArray(np.ndarray):
    """Encoded rows that remember which columns belong together, through row selections."""

    tied_dims: tuple = ()

    def __array_finalize__(self, other: object) -> None:
        same = isinstance(other, TiedArray) and self.ndim == 2 and other.ndim == 2 and self.shape[1:] == other.shape[1:]
        self.tied_dims = other.tied_dims if same else ()


class CatEncoder:
    """Rows of continuous and integer-id columns as one numeric row, block by block."""

    def __init__(self, kinds, cards=None, *, encoding=CatEncoding.AUTO, code_dim=None, hash_dim=None, seed=0, dim_cap=48, separation=10.0) -> None:
        self.kinds = tuple(kinds)
        for kind in self.kinds:
            _is_a(kind, DimKind, "kind")
        self.encoding = _is_a(encoding, CatEncoding, "encoding")
        self.seed, self.separation, self.hash_dim = int(seed), float(separation), 0 if hash_dim is None else int(hash_dim)
        if not self.kinds:
            raise ValueError("kinds must list at least one column")
        if not math.isfinite(self.separation) or self.separation <= 0:
            raise ValueError("separation must be positive and finite")
        if code_dim is not None and hash_dim is not None:
            raise ValueError("pass only one of code_dim, hash_dim")
        if code_dim is not None:
            _width(code_dim, 64, "code_dim")
            if encoding is not CatEncoding.RADEMACHER:
                raise ValueError("code_dim is a Rademacher width")
        if hash_dim is not None:
            if hash_dim < 1:
                raise ValueError("hash_dim must be >= 1")
            if encoding is not CatEncoding.AUTO:
                raise ValueError("hash_dim already chooses the categorical encoding")
        categorical = [k is DimKind.CATEGORICAL for k in self.kinds]
        if code_dim is not None or hash_dim is not None:
            if cards is not None:
                raise ValueError(f"{'code_dim' if code_dim is not None else 'hash_dim'} does not use cards")
            if not any(categorical):
                raise ValueError("no categorical columns to encode")
        else:
            _width(dim_cap, 64, "dim_cap")
            if cards is None and any(categorical):
                raise ValueError("categorical columns need cards")
            if cards is not None:
                if len(cards) != len(self.kinds):
                    raise ValueError("cards has wrong length")
                for is_cat, card in zip(categorical, cards):
                    if is_cat and card is None:
                        raise ValueError("a categorical column needs a card")
                    if is_cat and card < 1:
                        raise ValueError("card must be >= 1")
                    if not is_cat and card is not None:
                        raise ValueError("a continuous column has no card")
        self.blocks: list[tuple[int, int, str, int]] = []  # source, width, style, variable
        variable = 0
        for source, is_cat in enumerate(categorical):
            if not is_cat:
                self.blocks.append((source, 1, "continuous", 0))
                continue
            if hash_dim is None:
                width, style = (int(code_dim), "code") if code_dim is not None else column_plan(cards[source], encoding, dim_cap)
                self.blocks.append((source, width, style, variable))
            variable += 1
        self._categorical = [i for i, c in enumerate(categorical) if c]

    @property
    def num_dim(self) -> int:
        return sum(b[1] for b in self.blocks) + self.hash_dim

    @property
    def styles(self) -> tuple[str, ...]:
        return tuple(b[2] for b in self.blocks if b[2] != "continuous")

    @property
    def code_dims(self) -> tuple[int, ...]:
        return tuple(b[1] for b in self.blocks if b[2] != "continuous")

    def tied_dims(self) -> tuple[tuple[int, ...], ...]:
        out, at = [], 0
        for _, width, style, _ in self.blocks:
            if style != "continuous":
                out.append(tuple(range(at, at + width)))
            at += width
        if self.hash_dim:
            out.append(tuple(range(at, at + self.hash_dim)))
        return tuple(out)

    def _ids(self, column: np.ndarray) -> np.ndarray:
        if column.dtype.kind in "iu":
            return column.astype(np.int64)
        out = []
        for v in column.tolist():
            if isinstance(v, float) and (not v.is_integer() or not -(2.0**63) <= v < 2.0**63) or not isinstance(v, (int, float)):
                raise ValueError(f"categorical ids must be integers, got {v!r}")
            out.append(int(v))
        return np.array(out, np.int64)

    def encode(self, x) -> TiedArray:
        values = np.asarray(x)
        if values.dtype.kind not in "iuO":
            values = values.astype(np.float64)
        if values.ndim != 2 or values.shape[1] != len(self.kinds):
            raise ValueError(f"x must have {len(self.kinds)} columns")
        parts = []
        for source, width, style, variable in self.blocks:
            column = values[:, source]
            if style == "continuous":
                parts.append(column.astype(np.float64)[:, None])
            elif style == "code":
                parts.append(sign_code(self._ids(column), variable, width, self.seed, self.separation))
            else:
                ids = self._ids(column)
                if ((ids < 0) | (ids >= width)).any():
                    raise ValueError("one-hot ids must be in 0..card-1")
                parts.append((ids[:, None] == np.arange(width)) * self.separation)
        if self.hash_dim:
            ids = np.stack([self._ids(values[:, i]) for i in self._categorical], axis=1)
            parts.append(hash_rows(ids, self.hash_dim, self.seed))
        out = np.concatenate(parts, axis=1).view(TiedArray)
        out.tied_dims = self.tied_dims()
        return out

    def snap(self, encoded, domains) -> np.ndarray:
        if self.hash_dim:
            raise ValueError("hashed codes are not separated by variable")
        x = np.asarray(encoded, dtype=float)
        cats = [b for b in self.blocks if b[2] != "continuous"]
        if x.ndim != 2 or x.shape[1] != self.num_dim:
            raise ValueError("encoded shape does not match layout")
        if len(domains) != len(cats):
            raise ValueError("domains has wrong length")
        out, at, cat = np.zeros((len(x), len(cats)), np.int64), 0, 0
        for _, width, style, variable in self.blocks:
            if style != "continuous":
                ids = np.asarray(domains[cat], np.int64).ravel()
                if not len(ids):
                    raise ValueError("a domain must not be empty")
                codes = (ids[:, None] == np.arange(width)) * 1.0 if style == "onehot" else sign_code(ids, variable, width, self.seed, self.separation)
                out[:, cat] = ids[np.argmax(x[:, at : at + width] @ codes.T, axis=1)]
                cat += 1
            at += width
        return out
