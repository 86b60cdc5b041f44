"""The online learner against the same rule for one coordinate after the other."""

import math
import random

import numpy as np

from rasterloom.llm import toxicity as X


def test_learn_is_ftrl_proximal():
    rng = random.Random(1)
    rows = [(rng.randrange(2), sorted(rng.sample(range(40), rng.randrange(0, 9)))) for _ in range(300)]
    state = None
    for _ in range(2):
        state = X.learn(((y, np.array(f, np.int64)) for y, f in rows), state)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= X.L1:
            return 0.0
        return -(z[i] - math.copysign(X.L1, z[i])) / ((X.BETA + math.sqrt(n.get(i, 0.0))) / X.ALPHA + X.L2)

    for _ in range(2):
        for y, f in rows:
            own = [*f, 3 * X.SIZE]
            w = [weight(i) for i in own]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w))))) - y
            for i, v in zip(own, w):
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / X.ALPHA * v
                n[i] = before + g * g
    got = X.weights(state)
    assert set(np.flatnonzero(got)) == {i for i in z if weight(i)}
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-9, abs_tol=1e-12) for i in z) and any(weight(i) for i in z)
