"""A bounded set of terms that expressions can look into, without a join and without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Lexicon:
    """Terms without commas and quotes; each stands in one of two cells of a table (cuckoo hashing)."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        """``rows`` has each term with its two hashes, as `Lexicon.of` collects them."""
        self.terms = [t for t, _, _ in rows]
        self.mask, cells = (1 << max(4, len(rows).bit_length())) - 1, None
        while cells is None:
            self.mask = 2 * self.mask + 1
            cells = self._filled(rows)
        self.cells: list[str] = cells

    @classmethod
    def of(cls, terms: DataFrame, most: int) -> Lexicon:
        """From the distinct values of a column ``t``, of which there are ``most`` at most."""
        got = terms.select("t", F.hash("t").alias("a"), F.hash("t", F.lit(1)).alias("b")).limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} terms")
        return cls(sorted((r.t, r.a, r.b) for r in got))

    def _filled(self, rows: list[tuple[str, int, int]]) -> list[str] | None:
        cells: list[tuple[str, int, int] | None] = [None] * (self.mask + 1)
        for row in rows:
            at = row[1] & self.mask
            for _ in range(500):
                row, cells[at] = cells[at], row
                if row is None:
                    break
                a, b = row[1] & self.mask, row[2] & self.mask
                at = b if at == a else a
            else:
                return None
        return [c[0] if c else "" for c in cells]

    def table(self) -> str:
        """The cells as an expression: one text that is split while the plan is made."""
        return "split('" + ",".join(self.cells) + "', ',')"

    def has(self, table: str, term: str) -> str:
        return f"(get({table}, hash({term}) & {self.mask}) = {term} or get({table}, hash({term}, 1) & {self.mask}) = {term})"
