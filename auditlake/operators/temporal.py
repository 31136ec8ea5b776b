"""Temporal properties over a transition table (process conformance of observed successions).

A formula is a nested tuple: ("prop", name), ("ge", balance, n), ("zero", balance), ("not", f),
("and", f, g), ("or", f, g), ("EX"|"AX"|"EF"|"AF"|"EG"|"AG", f), ("EU"|"AU", f, g). Each operator is
a set of states; least and greatest fixpoints are rounds of joins as in `graph`. A state without
successors satisfies every AX.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.graph import grow
from auditlake.session import RoundTable, write_cut


class Transitions:
    """States (keys, state, labels, balances, initial) and transitions (keys, src, dst)."""

    def __init__(self, states: DataFrame, transitions: DataFrame, keys=()):
        self.keys = list(keys)
        self.ids = [*self.keys, "state"]
        self.states = write_cut(states)
        self.edges = write_cut(transitions.select(*self.keys, "src", "dst").distinct())
        self.degree = write_cut(self.edges.groupBy(*self.keys, "src").agg(F.count(F.lit(1)).alias("n_next")))

    def every(self) -> DataFrame:
        return self.states.select(*self.ids)

    def before(self, target: DataFrame) -> DataFrame:
        """(pre-state, target state) for transitions into the target."""
        return target.select(*self.keys, F.col("state").alias("dst")).join(self.edges, [*self.keys, "dst"])

    def some_next(self, target: DataFrame) -> DataFrame:
        return self.before(target).select(*self.keys, F.col("src").alias("state")).distinct()

    def all_next(self, target: DataFrame) -> DataFrame:
        hits = self.before(target).groupBy(*self.keys, "src").agg(F.count(F.lit(1)).alias("n"))
        full = hits.join(self.degree, [*self.keys, "src"]).filter("n = n_next").select(*self.keys, F.col("src").alias("state"))
        ends = self.every().join(self.degree.select(*self.keys, F.col("src").alias("state")), self.ids, "left_anti")
        return full.unionByName(ends)

    def least(self, seed: DataFrame, within: DataFrame | None, universal: bool) -> DataFrame:
        """Least Z with Z = seed or (within and next(Z))."""
        if not universal:
            def step(new):
                pre = self.some_next(new)
                return pre if within is None else pre.join(within, self.ids, "left_semi")

            return grow(seed.select(*self.ids), step, self.ids).select(*self.ids)
        table = RoundTable(self.states.sparkSession)
        new = table.append(seed.select(*self.ids).distinct())
        first = True
        while new or first:
            known = table.all()
            nxt = self.all_next(known)
            if within is not None:
                nxt = nxt.join(within, self.ids, "left_semi")
            new, first = table.append(nxt.distinct().join(known, self.ids, "left_anti")), False
        return table.all()

    def greatest(self, seed: DataFrame, universal: bool) -> DataFrame:
        """Greatest Z with Z = seed and next(Z): drop states until none has to go.

        AG f is the complement of EF not f, and EG f of AF not f but for dead ends, which have no next
        state: they leave EG in the first round.
        """
        outside = self.every().join(seed, self.ids, "left_anti")
        if universal:
            return self.every().join(self.least(outside, None, False), self.ids, "left_anti")
        table = RoundTable(self.states.sparkSession)
        ends = self.every().join(self.degree.select(*self.keys, F.col("src").alias("state")), self.ids, "left_anti")
        new = table.append(outside.unionByName(ends).distinct())
        while new:
            gone = table.all()
            hits = self.before(gone).groupBy(*self.keys, "src").agg(F.count(F.lit(1)).alias("n"))
            lost = hits.join(self.degree, [*self.keys, "src"]).filter("n = n_next").select(*self.keys, F.col("src").alias("state"))
            new = table.append(lost.join(gone, self.ids, "left_anti"))
        return self.every().join(table.all(), self.ids, "left_anti")

    def satisfying(self, formula) -> DataFrame:
        """States (keys, state) in which the formula holds."""
        kind, *args = formula
        if kind == "prop":
            return self.states.filter(F.array_contains("labels", args[0])).select(*self.ids)
        if kind == "ge":
            return self.states.filter(F.try_element_at("balances", F.lit(args[0])) >= args[1]).select(*self.ids)
        if kind == "zero":
            return self.states.filter(F.try_element_at("balances", F.lit(args[0])) == 0).select(*self.ids)
        sets = [write_cut(self.satisfying(a)) for a in args]
        if kind == "not":
            return self.every().join(sets[0], self.ids, "left_anti")
        if kind == "and":
            return sets[0].join(sets[1], self.ids, "left_semi")
        if kind == "or":
            return sets[0].unionByName(sets[1]).distinct()
        if kind == "EX":
            return self.some_next(sets[0])
        if kind == "AX":
            return self.all_next(sets[0])
        if kind in ("EF", "AF"):
            return self.least(sets[0], None, kind == "AF")
        if kind in ("EG", "AG"):
            return self.greatest(sets[0], kind == "AG")
        if kind in ("EU", "AU"):
            return self.least(sets[1], sets[0], kind == "AU")
        raise ValueError(f"unknown operator {kind}")

    def check(self, formula) -> DataFrame:
        """Per graph: states, satisfying states, whether all initial states satisfy, one counterexample."""
        sat = self.satisfying(formula).withColumn("_sat", F.lit(True))
        marked = self.states.select(*self.ids, "initial").join(sat, self.ids, "left")
        ok = F.col("_sat").isNotNull()
        bad = F.col("initial") & ~ok
        return marked.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("states"), F.count_if(ok).alias("satisfying"), (~F.bool_or(bad)).alias("holds"),
            F.min(F.when(bad, F.col("state"))).alias("counterexample"))


def ctl(states: DataFrame, transitions: DataFrame, formula, keys=()) -> DataFrame:
    """States in which a formula holds."""
    return Transitions(states, transitions, keys).satisfying(formula)
