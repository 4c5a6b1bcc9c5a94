"""The composed retrieval against a plain version of its steps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import retrieval as R


def _plain(edges: list[tuple], rows: list[tuple], n: int, most: int, width: int, depth: int) -> list[int]:
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    ids = {r[0] for r in rows}
    own = [e for e in edges if e[0] in ids and e[1] in ids]
    out: dict = {}
    for a, _, _, w in own:
        out[a] = out.get(a, 0) + w
    rest, kept = dict.fromkeys(ids, 1 / len(ids)), {}
    for _ in range(21):
        live = {k: v for k, v in rest.items() if v >= 1e-4}
        if not live:
            break
        for k, v in live.items():
            kept[k] = kept.get(k, 0) + 0.85 * v
        rest = {}
        for a, b, _, w in own:
            if a in live:
                rest[b] = rest.get(b, 0) + live[a] * (1 - 0.85) * w / out[a]
    top = max(kept.values())
    lo, hi = min(r[2] for r in rows), max(r[2] for r in rows)
    fast = {r[0]: 0.55 * r[1] + 0.20 * kept.get(r[0], 0) / top + 0.15 * ((r[2] - lo) / (hi - lo)) + 0.10 * (out.get(r[0], 0) / max(out.values())) for r in rows}
    score = {k: round(v, 9) for k, v in fast.items()}
    beams = {k: [k] for k in sorted(ids, key=lambda k: (-score[k], k))[:width]}
    seen = set(beams)
    for _ in range(depth):
        new: dict = {}
        for a, b in {(e[0], e[1]) for e in own}:
            if a in beams and b not in seen and (b not in new or (score[a], -a) > new[b][0]):
                new[b] = ((score[a], -a), [*beams[a], b])
        if not new:
            break
        seen |= set(new)
        beams = {k: new[k][1] for k in sorted(new, key=lambda k: (-score[k], k))[:width]}
    way = {x for p in beams.values() for x in p}
    final = {r[0]: round(fast[r[0]] + r[4], 9) for r in rows if r[0] in way}
    unit = {r[0]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    left, chosen = sorted(final, key=lambda k: (-final[k], k)), []
    while left and len(chosen) < n:
        value = [0.7 * final[k] - 0.3 * (max(float(unit[k] @ unit[c]) for c in chosen) if chosen else 0) for k in left]
        chosen.append(left.pop(int(np.argmax(value))))
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_composed_retrieval_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(k, round(rng.random(), 6), start + timedelta(hours=rng.randrange(500)), [rng.gauss(0, 1) for _ in range(4)], rng.random() / 5) for k in range(60)]
    edges = list({(a, b): (a, b, "A", rng.choice((0.25, 0.5, 1.0))) for a, b in ((rng.randrange(70), rng.randrange(70)) for _ in range(500)) if a != b}.values())
    df = spark.createDataFrame(rows, "id long, score double, ts timestamp, embedding array<double>, cross double")
    graph = spark.createDataFrame(edges, "source_id long, target_id long, type string, weight double")
    got = sorted(R.composed(graph, df, 6, 40, 4, 3).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == _plain(edges, rows, 6, 40, 4, 3)
    assert len(got) == 6
