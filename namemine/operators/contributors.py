"""UDF surface: name models as DataFrame-level plug-ins.

A contributor is any ``Callable[[DataFrame], DataFrame]`` that turns the variables table into
predictions ``(decl_id, name, p, priority)``; no Python row function is involved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.operators import lm

Contributor = Callable[[DataFrame], DataFrame]


class Contributors:
    """Registry of name models; their predictions are merged by M17 / M18."""

    def __init__(self) -> None:
        self._models: dict[str, Contributor] = {}
        self._probabilities: dict[str, Contributor] = {}

    def register(self, name: str, fn: Contributor, probability: Contributor | None = None) -> None:
        """``fn`` gives suggestions; ``probability`` (optional) the probability of each variable's
        own name as ``(decl_id, p, priority)``."""
        self._models[name] = fn
        if probability is not None:
            self._probabilities[name] = probability

    def names(self) -> list[str]:
        return sorted(self._models)

    def predictions(self, variables: DataFrame) -> DataFrame:
        out = None
        for name in self.names():
            p = self._models[name](variables).select("decl_id", "name", "p", "priority").withColumn("model", F.lit(name))
            out = p if out is None else out.unionByName(p)
        return out

    def probability(self, variables: DataFrame) -> DataFrame:
        """Mixed probability of each variable's own name over the models that give one (M18) ->
        (decl_id, p); no row where no model answers."""
        parts = [self._probabilities[n](variables).select("decl_id", "p", "priority").withColumn("model", F.lit(n))
                 for n in sorted(self._probabilities)]
        if not parts:
            raise ValueError("no registered model gives probabilities")
        return lm.mix_probability(reduce(DataFrame.unionByName, parts))

    def suggest(self, variables: DataFrame, prior_weight: int = 0, **kw) -> DataFrame:
        """Mixed ranking of all registered models."""
        return lm.mix_rank(self.predictions(variables), prior_weight=prior_weight, **kw)
