"""Metric providers: registered functions that make metrics of scanners' results.

A provider has a kind, the scanners that it supports (none named: all) and a function of DataFrames
that gives metrics of RUN and tool. Of the providers that support a scanner, in order of registration,
one makes its metrics; if a scalar and a findings provider are among them, the first of each does.
The choice is an expression over the tool, so no scanner needs to be known before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import scoring
from verdigris.schemas import FINDING_PROVIDER_SCANNERS, SCALAR_PROVIDER_SCANNERS

FINDINGS, SCALARS, OWN = "findings", "scalar", "own"
#: What metrics hold; a provider may leave out the last two.
METRIC = ["project", "run_id", "tool", "category", "severity", "count", "weighted_count", "score_hint", "scalar_name", "scalar_value"]


@dataclass(frozen=True)
class Provider:
    """extract is given the chosen rows: classified findings (kind FINDINGS), results with their
    scalar_metrics (SCALARS), or both (OWN)."""

    name: str
    kind: str
    extract: Callable[..., DataFrame]
    scanners: frozenset[str] | None = None

    def supports(self, tool: Column) -> Column:
        return F.lit(True) if self.scanners is None else tool.isin(sorted(self.scanners))


@dataclass
class Providers:
    """Providers in order of registration."""

    held: list[Provider] = field(default_factory=list)

    def add(self, provider: Provider, first: bool = False) -> None:
        if any(p.name == provider.name for p in self.held):
            raise ValueError(f"{provider.name} is registered already")
        self.held.insert(0 if first else len(self.held), provider)

    def chosen(self, provider: Provider, tool: Column) -> Column:
        """Whether a provider makes the metrics of a tool."""
        before = self.held[: self.held.index(provider)]
        some = lambda providers: F.array_contains(F.array(F.lit(False), *(p.supports(tool) for p in providers)), True)
        kind = lambda k, among: [p for p in among if p.kind == k]
        both = some(kind(SCALARS, self.held)) & some(kind(FINDINGS, self.held))
        first_of_all = ~some(before)
        first_of_kind = ~some(kind(provider.kind, before)) if provider.kind in (SCALARS, FINDINGS) else F.lit(False)
        return provider.supports(tool) & F.when(both, first_of_kind).otherwise(first_of_all)

    def selection(self, results: DataFrame) -> DataFrame:
        """(tool, provider): which providers make the metrics of each tool in the results."""
        names = F.array_compact(F.array(*(F.when(self.chosen(p, F.col("tool")), p.name) for p in self.held)))
        return results.select("tool").distinct().select("tool", F.explode(names).alias("provider"))

    def extract(self, results: DataFrame, findings: DataFrame) -> DataFrame:
        """Metrics of results that succeeded (project, run_id, tool, success, scalar_metrics) and of
        their findings, by the providers that are chosen."""
        sound = results.where("success")
        mine = findings.join(sound.select("project", "run_id", "tool").distinct(), ["project", "run_id", "tool"], "left_semi")
        parts = []
        for p in self.held:
            chosen = self.chosen(p, F.col("tool"))
            given = {FINDINGS: (mine.where(chosen),), SCALARS: (sound.where(chosen),)}.get(p.kind, (sound.where(chosen), mine.where(chosen)))
            made = p.extract(*given)
            parts.append(made.select(*METRIC[:8], *(F.col(c) if c in made.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("scalar_name", "string"), ("scalar_value", "double")))))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found


def builtin() -> Providers:
    """The providers that the engine brings."""
    return Providers(
        [
            Provider("known_findings", FINDINGS, scoring.finding_metrics, frozenset(FINDING_PROVIDER_SCANNERS)),
            Provider("scalars", SCALARS, scoring.named_scalars, frozenset(SCALAR_PROVIDER_SCANNERS)),
            Provider("findings", FINDINGS, scoring.finding_metrics),
        ]
    )
