"""Plain loops that say what a result should be."""


def targets_by_rounds(total, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Hand out by weight, stop what is above its cap, share the excess again, until none is above."""
    names = sorted([s for s in total if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped, left = {}, set(), share * sum(total.values())
    while True:
        rest = [s for s in names if s not in stopped]
        if not rest:
            return target
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level >= cap * total[s]]
        if not over:
            return target | {s: weight[s] * level for s in rest}
        for s in over:
            target[s] = cap * total[s]
            stopped.add(s)
            left -= target[s]
