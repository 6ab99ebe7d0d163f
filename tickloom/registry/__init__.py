"""Queries over the given tables, each with an independent SQL form where there is one."""

from tickloom.registry import common


def _load() -> None:
    from tickloom.registry import bars, files, fits, forests, grammar, models, sweeps, text  # noqa: F401


def queries():
    _load()
    return dict(common.QUERIES)


def oracles():
    _load()
    return dict(common.ORACLES)
