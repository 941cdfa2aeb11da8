"""Plain NumPy versions to hold the Spark ones against."""

from itertools import product

import numpy as np

REACH = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}


def steps(connectivity, ndim=3):
    axes = 2 if connectivity in (4, 8) else ndim
    return [(*s, *(0,) * (3 - axes)) for s in product((-1, 0, 1), repeat=axes) if 0 < sum(map(abs, s)) <= REACH[connectivity]]


def label(array, connectivity=26, delta=0, periodic=False, binary=False, order="F"):
    """Labels by flood fill from each unlabelled cell in memory order."""
    full = array.reshape(array.shape + (1,) * (3 - array.ndim))
    out = np.zeros(full.shape, np.int64)
    axes = range(3) if order == "C" else range(2, -1, -1)
    n = 0
    for at in product(*[range(full.shape[a]) for a in axes]):
        first = at if order == "C" else at[::-1]
        if not full[first] or out[first]:
            continue
        n += 1
        out[first], todo = n, [first]
        while todo:
            p = todo.pop()
            for s in steps(connectivity, array.ndim):
                q = tuple(a + b for a, b in zip(p, s))
                if periodic:
                    q = tuple(a % b for a, b in zip(q, full.shape))
                if any(a < 0 or a >= b for a, b in zip(q, full.shape)) or not full[q] or out[q]:
                    continue
                same = binary or (abs(float(full[p]) - float(full[q])) <= delta if delta else full[p] == full[q])
                if same:
                    out[q] = n
                    todo.append(q)
    return out.reshape(array.shape)


def pairs(labels, connectivity, weights=(1, 1, 1)):
    """(label_1, label_2) to [area, number of adjacencies]."""
    full = labels.reshape(labels.shape + (1,) * (3 - labels.ndim))
    wx, wy, wz = weights
    out = {}
    for p in product(*map(range, full.shape)):
        for s in steps(connectivity, labels.ndim):
            q = tuple(a + b for a, b in zip(p, s))
            if s[::-1] >= (0, 0, 0) or any(a < 0 or a >= b for a, b in zip(q, full.shape)) or not full[p] or not full[q] or full[p] == full[q]:
                continue
            area = 0.0
            if sum(map(abs, s)) == 1:
                area = (wy if s[0] else wx) if labels.ndim < 3 else (wy * wz if s[0] else wx * wz if s[1] else wx * wy)
            got = out.setdefault((int(min(full[p], full[q])), int(max(full[p], full[q]))), [0.0, 0])
            got[0] += area
            got[1] += 1
    return out
