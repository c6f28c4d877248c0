"""All statements, by query name."""

from __future__ import annotations

from oracles import evaluation, features, models, segments

STATEMENTS: dict[str, str] = {**features.STATEMENTS, **segments.STATEMENTS, **evaluation.STATEMENTS, **models.STATEMENTS}
