"""Extension points: models that the caller brings.

A plug-in is a loader that returns a function of one row (a dict) to a result
(a dict). It runs Arrow-batched; the loader is called once a worker process. A
row that fails is logged and left out, and the others go on.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Loader = Callable[..., Callable[[dict], dict]]
KINDS = ("matcher", "prompt_scorer", "segmenter", "encoder", "stripper", "strata_rule")

_registry: dict[tuple[str, str], Loader] = {}
_loaded: dict[str, Callable[[dict], dict]] = {}


def register(kind: str, name: str) -> Callable[[Loader], Loader]:
    """Decorator: make a loader known under a kind and a name."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")

    def add(loader: Loader) -> Loader:
        _registry[kind, name] = loader
        return loader

    return add


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _registry if k == kind)


def loader(kind: str, name: str) -> Loader:
    if (kind, name) not in _registry:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(names(kind)) or 'none'}")
    return _registry[kind, name]


def load_once(key: str, load: Loader, **kwargs: object) -> Callable[[dict], dict]:
    """The loaded function of this process."""
    full = f"{key}|{json.dumps(kwargs, sort_keys=True, default=str)}"
    if full not in _loaded:
        _loaded[full] = load(**kwargs)
    return _loaded[full]


def apply(df: DataFrame, kind: str, name: str, keep: list[str], schema: str, **kwargs: object) -> DataFrame:
    """Rows of ``df`` through a plug-in: the kept columns and its results.

    ``schema`` is the DDL of the kept columns and the results, in that order.
    """
    load = loader(kind, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load_once(f"{kind}|{name}", load, **kwargs)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append({**{k: row[k] for k in keep}, **call(row)})
                except Exception:
                    logging.getLogger(__name__).exception("%s %s failed on %s", kind, name, {k: row[k] for k in keep})
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)
