"""Declarative specs that replace the reference's three hand-copied source variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class CohortSpec:
    """Cohort and label rules for one source flavour.

    Attributes mirror the knobs that differ between the three sources: label windows,
    strictness of the stay-length labels and whether mortality also needs death before the
    unit discharge. The order of the stages is the flavour's own builder
    (``operators/cohort.py``).
    """

    gap_hours: int = 12
    pred_hours: int = 48
    obs_hours: int = 12
    min_age: int = 18
    same_unit: bool = True
    unit_type: str | None = None
    los_inclusive: bool = False          # >= 3 / >= 7 instead of > 3 / > 7
    mortality_out_bound: bool = True     # death must also be <= unit discharge
    discharge_uses_gap: bool = False     # imminent discharge window includes the gap
    death_location: str = "DEAD/EXPIRED"

    @property
    def min_los_days(self) -> float:
        return 0.5 + self.gap_hours / 24

    @property
    def min_los_minutes(self) -> int:
        return 60 * (self.obs_hours + self.gap_hours)


ABSOLUTE = CohortSpec()
RELATIVE = CohortSpec()
ANCHORED = CohortSpec(gap_hours=2, pred_hours=24, los_inclusive=True, mortality_out_bound=False,
                      discharge_uses_gap=True, death_location="DIED")


@dataclass(frozen=True)
class TableSpec:
    """One event table: time column, columns to drop, code column, value/category roles."""

    name: str
    time_column: str
    id_column: str
    time_excluded: tuple[str, ...] = ()
    id_excluded: tuple[str, ...] = ()
    code_column: str | None = None
    value_columns: tuple[str, ...] = ()
    category_columns: tuple[str, ...] = ()
    selected: tuple[str, ...] = ()
    dictionary: bool = False


@dataclass(frozen=True)
class SourceSpec:
    """One data source: its cohort flavour and rules, its event tables and how their times are written.

    ``flavour`` names the cohort builder (absolute, relative or anchored); with ``relative_time`` event times are
    minutes since admission already. The window is the cohort's observation time unless given in minutes.
    """

    name: str
    flavour: str
    cohort: CohortSpec
    tables: tuple[TableSpec, ...]
    relative_time: bool = False
    window_minutes: int | None = None
    min_events: int = 10
    row_key: str = "event_id"

    @property
    def window(self) -> int:
        return 60 * self.cohort.obs_hours if self.window_minutes is None else self.window_minutes


class SpecError(ValueError):
    """A configuration that doesn't fit its classes or its tables; the message lists every fault."""


FLAVOURS = ("absolute", "relative", "anchored")


def _build(kind: type, cfg: Mapping, where: str, faults: list[str]):
    known = {f.name for f in fields(kind)}
    faults += [f"{where}: unknown key {k}" for k in cfg if k not in known]
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in cfg.items() if k in known})
    except TypeError as e:
        faults.append(f"{where}: {e}")
        return None


def sources_from_config(config: Sequence[Mapping]) -> tuple[SourceSpec, ...]:
    """A plain configuration (as JSON gives it) -> source specs; unknown keys, missing ones, flavours and repeated
    names are faults, all of them told at once."""
    faults: list[str] = []
    out = []
    for cfg in config:
        where = str(cfg.get("name", "source"))
        tables = [_build(TableSpec, t, f"{where}.{t.get('name', 'table')}", faults) for t in cfg.get("tables", ())]
        cohort = _build(CohortSpec, cfg.get("cohort", {}), f"{where}.cohort", faults)
        source = _build(SourceSpec, {**cfg, "tables": tuple(tables), "cohort": cohort}, where, faults)
        if cfg.get("flavour") not in FLAVOURS:
            faults.append(f"{where}: unknown flavour {cfg.get('flavour')}")
        if len({t.name for t in tables if t}) < len(tables):
            faults.append(f"{where}: two tables of one name")
        out.append(source)
    if len({s.name for s in out if s}) < len(out):
        faults.append("two sources of one name")
    if faults:
        raise SpecError("; ".join(faults))
    return tuple(out)
