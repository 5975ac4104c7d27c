"""Patterns ``(subject, predicate, object)``, their filters, bindings and scan order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.errors import ValidationError

PARTS = ("subject_id", "predicate", "object_id")


@dataclass(frozen=True)
class Var:
    """A named wildcard."""

    name: str


def identifier(value: object, name: str) -> str:
    if not isinstance(value, str) or not value or "\0" in value:
        raise ValidationError(f"{name} must be non-empty text without NUL, not {value!r}")
    return value


@dataclass(frozen=True)
class Pattern:
    """Each part is text, a ``Var``, or ``None`` for an unnamed wildcard."""

    subject: str | Var | None = None
    predicate: str | Var | None = None
    object: str | Var | None = None

    @property
    def parts(self) -> tuple:
        return (self.subject, self.predicate, self.object)

    def literal(self, k: int) -> str | None:
        part = self.parts[k]
        return part if isinstance(part, str) else None

    def condition(self) -> Column:
        """A conjunction of equalities, so it reaches the Parquet scan."""
        wanted = F.lit(True)
        for k, column in enumerate(PARTS):
            if self.literal(k) is not None:
                wanted = wanted & (F.col(column) == F.lit(identifier(self.literal(k), column)))
        return wanted

    def filter(self, versions: DataFrame) -> DataFrame:
        return versions.where(self.condition())

    def order(self) -> list[str]:
        """Columns whose order makes LIMIT and ties well-defined."""
        if self.literal(0) is not None:
            return ["predicate", "valid_from", "version_id"]
        if self.literal(2) is not None:
            return ["predicate", "subject_id", "valid_from", "version_id"]
        return ["version_id"]

    def bindings(self) -> Column:
        """MAP of variable to value.  A name used twice keeps the later position; it does not unify."""
        named = {part.name: column for part, column in zip(self.parts, PARTS) if isinstance(part, Var)}
        if not named:
            return F.from_json(F.lit("{}"), "map<string,string>")
        return F.create_map(*(x for name, column in named.items() for x in (F.lit(name), F.col(column))))

    def reversed(self) -> bool:
        """Whether only the subject side is open."""
        return self.literal(0) is None and self.literal(2) is not None

    def require_literals(self, what: str) -> tuple[str, str, str]:
        if any(not isinstance(p, str) for p in self.parts):
            raise ValidationError(f"{what} takes no variables")
        return tuple(identifier(p, c) for p, c in zip(self.parts, PARTS))  # type: ignore[return-value]
