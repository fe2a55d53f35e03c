"""Severity vectors and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexarium.functions.text import _c


def partial_vector(labels: Column) -> Column:
    """AV,AC,PR,UI,S,C,I,A from a set of characteristic labels.

    Attack complexity is tried before the scope change by context escape; of the three impacts at most one changes."""
    has = lambda x: F.array_contains(labels, x)
    group = ["Read", "Resource Removal", "Write", "Indirect Disclosure", "Service Interrupt", "Privilege Escalation"]
    n = F.size(F.filter(labels, lambda x: x.isin(group)))
    escalates, discloses, alters, stops = has("Privilege Escalation"), has("Read") | has("Indirect Disclosure"), has("Write") | has("Resource Removal"), has("Service Interrupt")
    av = F.when(has("Remote") | has("Limited Rmt"), "N").when(has("Local"), "L").when(has("Physical"), "P").otherwise("X")
    mitm = has("Man-in-the-Middle")
    scope = F.when((~mitm & has("Context Escape")) | has("Sandboxed"), "C").otherwise("U")
    level = F.when(escalates & ((n == 1) | discloses), "CH").when(escalates & alters, "IH").when(escalates & stops, "AH").when(discloses, "CL").when(alters, "IL").when(stops, "AL").otherwise("")
    impact = [F.when(level == f"{k}H", "H").when(level == f"{k}L", "LH").otherwise("N") for k in "CIA"]
    return F.array(av, F.when(mitm, "H").otherwise("L"), F.lit("X"), F.lit("X"), scope, *impact)


def severity_class(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s < 4, "LOW").when(s <= 6.5, "MEDIUM").when(s < 9, "HIGH").when(s.isNotNull(), "CRITICAL")


def matches(partial: Column, full: Column) -> Column:
    """Whether a full vector fits a partial one, position by position: X fits all, LH fits L and H."""
    return F.forall(F.zip_with(partial, full, lambda p, f: (p == "X") | (p == f) | ((p == "LH") & f.isin("L", "H"))), lambda ok: ok)
