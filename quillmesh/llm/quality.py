"""Figures of form of each text, and its kind by an ordered rule list learned from labelled texts.

The figures are counted over whole texts in Arrow batches (``figures``).  The
rules are induced on the driver from a bounded sample of labelled texts by
incremental reduced-error pruning: a rule is grown on two thirds of the texts
by information gain, pruned on the last third as long as its precision there
rises, and kept while it is right more often than not; the texts it covers
are set aside and the next rule is grown.  Kinds are learned from the rarest
to the most frequent, which is the default.  The learned thresholds become one
SQL CASE expression, applied natively to all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.figures import NAMES, figures_udf
from quillmesh.session import written

#: Labelled texts that the rules are learned from, at most: those with the least hash of their id.
LABELS = 20_000


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def sql(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value!r}"


@dataclass
class Rule:
    kind: str
    conditions: list

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _covers(x: np.ndarray, names: list[str], conditions: list) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.name)]
        m &= (v > c.value) if c.above else (v <= c.value)
    return m


def _best(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition of greatest FOIL gain; among equals the one with the widest gap around its threshold."""
    n_p, n_n = y.sum(), (~y).sum()
    base = np.log2(n_p / (n_p + n_n))
    best, cond = (0.0, 0.0), None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        spread = v[-1] - v[0]
        cp, cn = np.cumsum(pos)[cut], np.cumsum(~pos)[cut]
        for above, p, n in ((False, cp, cn), (True, n_p - cp, n_n - cn)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            top = gain.max()
            if top <= 0:
                continue
            near = np.flatnonzero(gain >= top - 1e-9)
            gap = (v[cut[near] + 1] - v[cut[near]]) / spread
            k = near[gap.argmax()]
            score = (round(float(top), 6), round(float(gap.max()), 6))
            if score > best:
                best, cond = score, Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best[0], cond


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Condition]:
    conditions: list[Condition] = []
    m = np.ones(len(x), bool)
    while y[m].any() and (~y[m]).any() and len(conditions) < 6:
        gain, c = _best(x[m], y[m], names)
        if c is None or gain <= 0:
            break
        conditions.append(c)
        m = _covers(x, names, conditions)
    return conditions


def _prune(x: np.ndarray, y: np.ndarray, names: list[str], conditions: list) -> list:
    """Drop final conditions as long as (p - n) / (p + n) on the pruning texts does not fall."""
    def worth(cs: list) -> float:
        m = _covers(x, names, cs)
        p, n = (y & m).sum(), (~y & m).sum()
        return (p - n) / (p + n) if p + n else -1.0
    best, at = conditions, worth(conditions)
    for k in range(len(conditions) - 1, 0, -1):
        if (w := worth(conditions[:k])) >= at:
            best, at = conditions[:k], w
    return best


def induce(x: np.ndarray, kinds: np.ndarray, names: list[str], seed: int = 7, default: str | None = None) -> tuple[list[Rule], str]:
    """The ordered rules and the default kind.

    A kind with fewer than six texts has too few to prune on: its rules are
    grown and judged on all of them.  No texts give no rules.
    """
    if not len(kinds):
        return [], default or "prose"
    values, counts = np.unique(kinds, return_counts=True)
    order = [str(v) for v, _ in sorted(zip(values, counts, strict=True), key=lambda z: (z[1], z[0]))]
    default = default or order[-1]
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    for kind in [k for k in order if k != default]:
        while (left & (kinds == kind)).any():
            at = np.flatnonzero(left)
            y = kinds[at] == kind
            third = np.zeros(len(at), bool)
            if y.sum() >= 6:
                for cls in (True, False):
                    ix = rng.permutation(np.flatnonzero(y == cls))
                    third[ix[: len(ix) // 3]] = True
            grow = ~third
            rule = _grow(x[at[grow]], y[grow], names)
            if not rule:
                break
            test = third if third.any() else grow
            if third.any():
                rule = _prune(x[at[third]], y[third], names, rule)
            m = _covers(x[at[test]], names, rule)
            p, n = (y[test] & m).sum(), (~y[test] & m).sum()
            if third.any() and p + n == 0:
                # Too narrow for the pruning texts to see: judged by all.
                m = _covers(x[at], names, rule)
                p, n = (y & m).sum(), (~y & m).sum()
            if p <= n:
                break
            rules.append(Rule(kind, rule))
            left[at[_covers(x[at], names, rule)]] = False
    return rules, default


def case_sql(rules: list[Rule], default: str) -> str:
    """The rule list as one CASE expression over the figures."""
    if not rules:
        return f"'{default}'"
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules) + f" ELSE '{default}' END"


#: Figures of size, not of form: they are reported but not learned from.
SIZE = frozenset(("n_chars", "n_words", "n_lines", "distinct_terms"))


def with_figures(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of each text that is not null and not blank."""
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", "text")
    lf = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return d.select("doc_id", figures_udf(lf).alias("f")).select("doc_id", *[f"f.{k}" for k in NAMES])


def sample(labels: DataFrame, bound: int = LABELS) -> DataFrame:
    """doc_id, kind of at most ``bound`` labelled texts, those with the least hash of their id. A text with several labels counts with the least."""
    lab = labels.where("doc_id is not null and kind is not null").groupBy("doc_id").agg(F.min(F.lower(F.trim("kind"))).alias("kind"))
    return lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELS, seed: int = 7) -> tuple[list[Rule], str]:
    """Rules from the figures of the labelled texts, gathered to the driver; these are at most ``bound``, so they are broadcast to the texts."""
    lab = F.broadcast(sample(labels, bound))
    figured = with_figures(docs.join(lab.select("doc_id"), "doc_id", "left_semi"))
    names = [c for c in figured.columns if c != "doc_id" and c not in SIZE]
    pdf = figured.select("doc_id", *names).join(lab, "doc_id").toPandas().sort_values("doc_id")
    return induce(pdf[names].to_numpy(float), pdf["kind"].to_numpy(str), names, seed, "prose")


def kinds(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> DataFrame:
    """doc_id, the figures, and kind by the learned rules; null and blank texts give no row."""
    rules, default = learn(docs, labels, bound)
    return written(with_figures(docs), "figures").withColumn("kind", F.expr(case_sql(rules, default)))


def only_kinds(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> DataFrame:
    """doc_id, kind: the same rules, without the figures.

    Written, since a condition on kind would else be pushed below and compute
    the figures twice.
    """
    rules, default = learn(docs, labels, bound)
    return written(with_figures(docs).select("doc_id", F.expr(case_sql(rules, default)).alias("kind")), "kinds")
