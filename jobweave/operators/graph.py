"""Communities of the skill graph: greedy modularity over the pairs' positive NPMI. The graph has a vertex for each skill of
the taxonomy, so it is worked on the driver once its size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_EDGES = 200_000


def greedy_modularity(nodes: list[str], edges: list[tuple[str, str, float]]) -> list[set[str]]:
    """Merges the two communities that raise weighted modularity most until none does; largest communities first."""
    total = sum(w for *_, w in edges)
    groups = {n: {n} for n in nodes}
    if not total:
        return sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    between: dict[str, dict[str, float]] = {n: {} for n in nodes}
    degree = dict.fromkeys(nodes, 0.0)
    for a, b, w in edges:
        between[a][b] = between[a].get(b, 0.0) + w
        between[b][a] = between[b].get(a, 0.0) + w
        degree[a] += w
        degree[b] += w
    while True:
        best = max(((w / total - degree[a] * degree[b] / (2 * total * total), a, b) for a in between for b, w in between[a].items() if a < b), key=lambda x: (x[0], -len(groups[x[1]]) - len(groups[x[2]]), x[1], x[2]), default=(0.0, "", ""))
        if best[0] <= 1e-12:
            return sorted(groups.values(), key=lambda g: (-len(g), min(g)))
        _, a, b = best
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[a].get(c, 0.0) + w
                between[c][a] = between[a][c]


def communities(pairs: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill, community): 0 the largest; a skill without a positive pair is a community by itself."""
    edges = pairs.filter("npmi > 0").select("skill_a", "skill_b", "npmi")
    if edges.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: raise the least joint count")
    found = greedy_modularity(sorted(r[0] for r in skills.select("skill").distinct().collect()), [tuple(r) for r in edges.orderBy("skill_a", "skill_b").collect()])
    rows = [(s, i) for i, g in enumerate(found) for s in sorted(g)]
    return pairs.sparkSession.createDataFrame(rows, "skill string, community int")


def network(pairs: DataFrame, frequency: DataFrame, least: float = 0.1, n: int = 40) -> DataFrame:
    """(skill_a, skill_b, npmi): edges over `least` between the n most frequent skills."""
    top = frequency.orderBy(F.desc("n_postings"), "skill").limit(n).select("skill")
    return pairs.filter(F.col("npmi") > least).join(top.withColumnRenamed("skill", "skill_a"), "skill_a", "left_semi").join(top.withColumnRenamed("skill", "skill_b"), "skill_b", "left_semi").select("skill_a", "skill_b", "npmi")
