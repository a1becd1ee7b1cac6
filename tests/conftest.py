from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        # Tiny inputs: skip the JIT of generated code.
        "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Store:
    """Writes one store's files below a lake."""

    def __init__(self, base, store="alice"):
        self.base, self.store = str(base), store

    def path(self, rel):
        full = os.path.join(self.base, self.store, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        return full

    def lines(self, rel, *items, end="\n"):
        text = "\n".join(i if isinstance(i, str) else json.dumps(i) for i in items) + end
        with open(self.path(rel), "w", encoding="utf-8", newline="") as handle:
            handle.write(text)

    def doc(self, rel, item):
        with open(self.path(rel), "w", encoding="utf-8") as handle:
            handle.write(item if isinstance(item, str) else json.dumps(item))

    def database(self, rel, *statements):
        import sqlite3

        con = sqlite3.connect(self.path(rel))
        for statement in statements:
            if isinstance(statement, tuple):
                con.execute(*statement)
            else:
                con.execute(statement)
        con.commit()
        con.close()


@pytest.fixture
def store(tmp_path):
    return Store(tmp_path / "lake")


@pytest.fixture
def lake(store):
    from tallyloom.sources.lake import Lake

    os.makedirs(store.base, exist_ok=True)
    return Lake(store.base)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def warned(tables):
    return {r.code: r.n for r in tables.warnings.collect()}


def of_store(tables, store):
    """The tables of one store; every scenario is a store of one shared lake."""
    from tallyloom.schemas import Tables

    return Tables(**{n: df.where(f"store_id = '{store}'") for n, df in tables.named().items()})
