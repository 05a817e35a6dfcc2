"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from skysieve.session import compile_small_methods

QUERIES: dict[str, Callable] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`, with its SQL twin if there is one.

    Registered queries run in sessions that others made; these get the method limit that the rule chains need.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark, sf_dir):
            compile_small_methods(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if twin is not None:
            TWINS[name] = twin
        return fn

    return register


def with_views(views: dict[str, str], body: str) -> str:
    """SQL text with the named views that `body` needs, directly or through each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(_words(text))
        for name, sql in views.items():
            if name in words and name not in needed:
                visit(sql)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" + body


def _words(text: str):
    word = ""
    for ch in text + " ":
        if ch.isalnum() or ch == "_":
            word += ch
        elif word:
            yield word
            word = ""
