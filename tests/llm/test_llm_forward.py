"""The byte network against plain loops."""

import math

import numpy as np
import pyarrow as pa

from flowloom.llm.quality_net import BLOCK, LAGS, fresh_net, scores


def plain_score(net, text):
    data = (text or "").encode()
    blocks = max(-(-len(data) // BLOCK), 1)
    data = bytes(LAGS) + data + bytes((blocks + 1) * BLOCK - len(data))
    inputs = []
    for k in range(blocks + 1):
        places = range(LAGS + k * BLOCK, LAGS + (k + 1) * BLOCK)
        x = [float(v) for i in places for v in net.embed[data[i]]]
        x += [(sum(data[i] == data[i - lag] and data[i] != 0 for i in places) / BLOCK) ** 3 for lag in range(1, LAGS + 1)]
        inputs.append(x)
    z = float(net.out_bias[0])
    for f in range(len(net.out)):
        best = max(
            sum(x * float(w) for side in (0, 1) for x, w in zip(inputs[k + side], net.filters[side][:, f])) for k in range(blocks)
        )
        z += max(best + float(net.bias[f]), 0.0) * float(net.out[f])
    return 1 / (1 + math.exp(-z))


def test_scores_against_plain_loops():
    net = fresh_net(5)
    net.bias[:] = np.linspace(-0.2, 0.2, len(net.bias))
    texts = ["", None, "a", "abcabcabcabcabc ", "abcabcabcabcabc d", "é ü " * 30, "x" * 200, "The quick brown fox jumps over it.\n" * 5]
    got = scores(net, pa.array(texts))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
