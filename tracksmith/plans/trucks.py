"""The batch job from truck sheets to stop tables, in named steps that each can be run alone; nothing is purged unasked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import fleet, stops
from ..operators.store import Store, laid_out
from ..sources import readers


def import_trucks(store: Store, path: str, delete: bool = True) -> None:
    store.save_items("truck_points", laid_out(readers.read_truck_sheets(store.spark, path), "truckId", "ts"), delete)


def compute_days(store: Store) -> None:
    store.overwrite("truck_dates", fleet.truck_dates(store.read("truck_points")))


def compute_stops(store: Store) -> None:
    made, props = stops.stop_tables(stops.merge_stops(stops.find_stops(store.read("truck_points"))))
    store.overwrite("stops", made)
    store.overwrite("stop_props", props)


STEPS: dict[str, Callable[[Store], None]] = {"compute": compute_days, "stops": compute_stops}


def run(store: Store, path: str | None = None, steps: tuple[str, ...] = ("compute", "stops")) -> None:
    if path:
        import_trucks(store, path)
    for name in steps:
        STEPS[name](store)


@dataclass
class Computed:
    """Named results, made when first asked for and kept as tables; a result may ask for others.

    A result is kept under the versions of the tables and results that it was made from, so a change of one of them
    makes it again, and one that has not changed is read.
    """

    store: Store
    makers: dict[str, Callable[[Computed], DataFrame]] = field(default_factory=dict)
    inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def add(self, name: str, maker: Callable[[Computed], DataFrame], inputs: tuple[str, ...] = ()) -> None:
        """inputs: the tables and the other results that the maker reads."""
        self.makers[name], self.inputs[name] = maker, inputs

    def _table(self, name: str) -> str:
        of = [f"{i}={self._table(i) if i in self.makers else self.store.version(i)}" for i in self.inputs.get(name, ())]
        return f"computed-{name}-{hashlib.sha256(json.dumps(of).encode()).hexdigest()[:16]}"

    def get(self, name: str) -> DataFrame:
        if name not in self.makers:
            raise KeyError(name)
        table = self._table(name)
        if not self.store.exists(table):
            self.store.overwrite(table, self.makers[name](self))
        return self.store.read(table)

    def delete(self, name: str) -> None:
        """Drops what was kept of a result, of whatever versions."""
        for table in self.store.names():
            if table.rsplit("-", 1)[0] == f"computed-{name}":
                self.store.drop(table)
