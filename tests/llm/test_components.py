"""Components that need many rounds: a long path in random order, a hub, and pairs given twice."""

from __future__ import annotations

import random

from weekpulse.llm.components import components


def test_path_and_hub(spark):
    rng = random.Random(7)
    nodes = rng.sample(range(1, 10_000), 600)
    path, hub = nodes[:300], nodes[300:]
    pairs = [*zip(path, path[1:]), *((hub[0], v) for v in hub[1:])]
    pairs += [(v, u) for u, v in pairs[:50]] + [(path[0], path[0])]
    rng.shuffle(pairs)
    found = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    wanted = {v: min(part) for part in (path, hub) for v in part}
    assert len(found) == len(wanted) and {r.id: r.component for r in found} == wanted
