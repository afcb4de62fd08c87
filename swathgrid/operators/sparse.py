"""Footprints as compressed rows: what the inversions hold of a tile instead of a matrix of samples by cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Rows that are written out in full at a time, where a step needs them so.
STRETCH = 128


class Rows:
    """A matrix by its entries that aren't zero, row by row: how many each row has, their columns and their values.

    rows @ x and rows.T @ y go over these entries only. A row without entries is a row of zeros.
    """

    def __init__(self, count: np.ndarray, cell: np.ndarray, share: np.ndarray, width: int):
        self.count, self.cell, self.share, self.width = count, cell, share, width
        self._row = np.repeat(np.arange(len(count)), count)

    @classmethod
    def of(cls, full: Iterable[np.ndarray], width: int) -> Rows:
        """From matrices of some rows each, of which no two are held at once."""
        count, cell, share = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for a in full:
            row, col = np.nonzero(a)
            count.append(np.bincount(row, minlength=len(a)))
            cell.append(col.astype(np.int32))
            share.append(a[row, col])
        return cls(np.concatenate(count), np.concatenate(cell), np.concatenate(share), width)

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("count", "cell", "share")), parts[0].width)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.count), self.width

    @property
    def nbytes(self) -> int:
        return self.count.nbytes + self.cell.nbytes + self.share.nbytes

    @property
    def T(self) -> Transposed:
        return Transposed(self)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self._row, self.share * x[self.cell], len(self.count))

    def chosen(self, there: np.ndarray) -> Rows:
        """The rows that `there` marks."""
        held = there[self._row]
        return Rows(self.count[there], self.cell[held], self.share[held], self.width)

    def column_sums(self) -> np.ndarray:
        return np.bincount(self.cell, self.share, self.width)

    def stretches(self) -> Iterable[np.ndarray]:
        """The rows in full, STRETCH at a time."""
        ends = np.concatenate([[0], np.cumsum(self.count)])
        for i in range(0, len(self.count), STRETCH):
            j = min(i + STRETCH, len(self.count))
            own = slice(ends[i], ends[j])
            full = np.zeros((j - i, self.width))
            full[self._row[own] - i, self.cell[own]] = self.share[own]
            yield full

    def reached(self) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """STRETCH rows at a time: the columns that they have entries in, and the rows in full on these."""
        ends = np.concatenate([[0], np.cumsum(self.count)])
        for i in range(0, len(self.count), STRETCH):
            j = min(i + STRETCH, len(self.count))
            own = slice(ends[i], ends[j])
            cells, at = np.unique(self.cell[own], return_inverse=True)
            full = np.zeros((j - i, len(cells)))
            full[self._row[own] - i, at] = self.share[own]
            yield cells, full

    def square_norm(self) -> float:
        """Frobenius norm of A'A, which is that of AA': of the two the smaller one is gone through, AA' never more than two stretches at a time."""
        if len(self.count) > self.width:
            square = np.zeros((self.width, self.width))
            for cells, a in self.reached():
                square[np.ix_(cells, cells)] += a.T @ a
            return float(np.linalg.norm(square))
        total = 0.0
        for i, a in enumerate(self.stretches()):
            for j, b in enumerate(self.stretches()):
                if j > i:
                    break
                total += (1 if i == j else 2) * float(((a @ b.T) ** 2).sum())
        return total**0.5


class Transposed:
    def __init__(self, rows: Rows):
        self.rows = rows

    def __matmul__(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows.cell, self.rows.share * y[self.rows._row], self.rows.width)


def square_of(a: np.ndarray | Rows) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """x -> A'(A x), which never writes A'A, and the Frobenius norm of A'A."""
    norm = a.square_norm() if isinstance(a, Rows) else float(np.linalg.norm(a @ a.T if len(a) < a.shape[1] else a.T @ a))
    return lambda x: a.T @ (a @ x), norm
