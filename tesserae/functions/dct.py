"""Eight-point block transforms over batches of blocks, exact in integers."""

import numpy as np

from tesserae import tables

PRODUCTION, DEFINITION = np.array(tables.llm(), np.int64), np.array(tables.basis(), np.int64)


EXACT = PRODUCTION.astype(np.float64)


def descale(x: np.ndarray, bits: int) -> np.ndarray:
    """Half up, of integers that may be held as doubles, exact below 2^53."""
    if x.dtype == np.float64:
        return np.floor((x + (1 << (bits - 1))) * 2.0**-bits)
    return (x + (1 << (bits - 1))) >> bits


def along_rows(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Every row of every (8, 8) block times m, by one matrix product of doubles: exact, as all sums are integers below 2^53."""
    return (np.ascontiguousarray(x).reshape(-1, 8) @ m).reshape(-1, 8, 8)


def forward(samples: np.ndarray, precision: int = 8) -> np.ndarray:
    """(n, 8, 8) samples to coefficients: rows, then columns."""
    rows = descale(along_rows(samples.astype(np.float64) - (1 << (precision - 1)), EXACT.T), 11)
    return descale(along_rows(rows.transpose(0, 2, 1), EXACT.T), 18).transpose(0, 2, 1).astype(np.int64)


def inverse(coefficients: np.ndarray, precision: int = 8) -> np.ndarray:
    """(n, 8, 8) dequantized coefficients to samples: columns, then rows."""
    columns = descale(along_rows(coefficients.astype(np.float64).transpose(0, 2, 1), EXACT), 11)
    rows = descale(along_rows(columns.transpose(0, 2, 1), EXACT), 18)
    return np.clip(rows + (1 << (precision - 1)), 0, (1 << precision) - 1).astype(np.int32)


def forward_definition(samples: np.ndarray, precision: int = 8) -> np.ndarray:
    x = samples.astype(np.int64) - (1 << (precision - 1))
    return descale(DEFINITION @ descale(x @ DEFINITION.T, 8), 20)


def inverse_definition(coefficients: np.ndarray, precision: int = 8, size: int = 8) -> np.ndarray:
    """Rows, then columns; at a size below 8 from the lowest frequencies alone."""
    m = np.array(tables.basis(size), np.int64)
    rows = descale(coefficients[:, :size, :size].astype(np.int64) @ m, 8)
    out = descale(m.T @ rows, 20)
    return np.clip(out + (1 << (precision - 1)), 0, (1 << precision) - 1)


def quantize(coefficients: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Half away from zero; the quotients are exact in doubles."""
    whole = np.floor((np.abs(coefficients) + table // 2) / table.astype(np.float64)).astype(np.int64)
    return np.where(coefficients < 0, -whole, whole)
