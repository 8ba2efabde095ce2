"""All queries of the library, with their SQL twins."""

from __future__ import annotations

from marlpit.plans import forms, relational, scalars, surface, writes

QUERIES = relational.QUERIES | scalars.QUERIES | writes.QUERIES | surface.QUERIES | forms.QUERIES
ORACLES = relational.ORACLES | scalars.ORACLES | writes.ORACLES | surface.ORACLES | forms.ORACLES
