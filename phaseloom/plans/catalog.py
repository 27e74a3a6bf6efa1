"""All registered queries outside the text-corpus package."""

from __future__ import annotations

from phaseloom.plans import q_advanced, q_complex, q_eval, q_field, q_last, q_models, q_more, q_nulls, q_reports, q_signal, q_text

_FAMILIES = [q_field, q_signal, q_eval, q_text, q_advanced, q_more, q_last, q_models, q_complex, q_reports, q_nulls]


def queries() -> dict:
    return {name: f for m in _FAMILIES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _FAMILIES for name, (_, s) in m.QUERIES.items() if s}
