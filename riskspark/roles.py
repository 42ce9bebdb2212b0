"""Role-based schema: which column is the row id, the label, the date and the time.

Only these four roles have fixed meaning; every other column is picked up by
its Spark type (numeric columns are imputed with the median and clipped,
other columns are imputed with the mode, string columns are encoded).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    id: str | None = "id"
    label: str | None = "Accident_Severity"
    date: str | None = "day"
    time: str | None = "time"
    # Columns that take part in nothing (kept as they are, never features).
    passthrough: tuple[str, ...] = field(default_factory=tuple)

    def named(self) -> list[str]:
        return [c for c in (self.id, self.label, self.date, self.time) if c]
