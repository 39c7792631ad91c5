"""Registered queries of the library's own operators and their SQL, one module a family."""

from __future__ import annotations

from . import q_calibration, q_dataset, q_fusion, q_metrics, q_signals, q_streams

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (q_metrics, q_dataset, q_calibration, q_fusion, q_signals, q_streams):
    QUERIES |= _m.registry.queries
    ORACLES |= _m.registry.oracles
