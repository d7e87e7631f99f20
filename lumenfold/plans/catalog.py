"""All queries over the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from lumenfold.plans import dialogues, evaluation, shapes, stores, streams, tables, tracing

QUERIES = tables.QUERIES | evaluation.QUERIES | tracing.QUERIES | streams.QUERIES | shapes.QUERIES | dialogues.QUERIES | stores.QUERIES
ORACLES = tables.ORACLES | evaluation.ORACLES | tracing.ORACLES | streams.ORACLES | shapes.ORACLES | dialogues.ORACLES | stores.ORACLES
