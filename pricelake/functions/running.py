"""Running median and median deviation of a series, one value at a time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable


class Past:
    """Earlier values of a series, sorted; the oldest leave when there are more than ``keep``.

    A value costs a binary search for either median and a move inside one array.
    """

    def __init__(self, keep: int | None = None, values: Iterable[float] = ()):
        self.keep, self.sorted = keep, []
        self.arrived: deque[float] = deque()
        for v in values:
            self.add(v)

    def __len__(self) -> int:
        return len(self.sorted)

    def add(self, value: float) -> None:
        insort(self.sorted, value)
        if self.keep is not None:
            self.arrived.append(value)
            if len(self.arrived) > self.keep:
                del self.sorted[bisect_left(self.sorted, self.arrived.popleft())]

    def median(self) -> float:
        a, n = self.sorted, len(self.sorted)
        return (a[(n - 1) // 2] + a[n // 2]) / 2

    def deviation(self, middle: float) -> float:
        """The median distance from middle: distances grow to both sides of it, so the two that count are found by a binary search."""
        a, n = self.sorted, len(self.sorted)
        cut = bisect_left(a, middle)
        below, above = cut, n - cut
        left = lambda i: middle - a[cut - 1 - i]
        right = lambda i: a[cut + i] - middle
        k = (n - 1) // 2 + 1
        low, high = max(0, k - above), min(k, below)
        while low < high:
            i = (low + high) // 2
            if left(i) < right(k - i - 1):
                low = i + 1
            else:
                high = i
        i, j = low, k - low
        first = max(left(i - 1) if i else float("-inf"), right(j - 1) if j else float("-inf"))
        if n % 2:
            return first
        return (first + min(left(i) if i < below else float("inf"), right(j) if j < above else float("inf"))) / 2

    def outlier(self, value: float, z: float, least: int) -> bool:
        """Whether value lies more than z times 1.4826 median deviations from the median; a flat history allows half of its level."""
        if len(self) < least:
            return False
        middle = self.median()
        spread, gap = self.deviation(middle), abs(value - middle)
        return gap / (spread * 1.4826) > z if spread > 0 else gap > max(1e-9, abs(middle) * 0.5)
