"""Queries over the provided tables; importing this package registers them all."""

from . import corpus, drift, episodes, metrics, records, results, rollouts, sessions, small, stores, texts, trajectories  # noqa: F401
