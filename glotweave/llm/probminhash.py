"""ProbMinHash signatures of weighted sets, for whole batches of sets at once.

Every element is a Poisson process whose rate is its weight; each of its arrivals falls into a register chosen uniformly.
A register keeps the element of its earliest arrival.  All randomness is a hash of the element and the arrival's number,
so equal elements arrive alike in every set, and two sets agree in a register with probability equal to their
probability Jaccard similarity.

Termination is early: arrivals are produced up to a time limit only, about when the last register of the set is filled.
Once no register is empty, later arrivals cannot be earliest anywhere.  Sets with an empty register get a doubled limit.
"""

from __future__ import annotations

import numpy as np

from glotweave.llm.wordhash import mix

_U = np.uint64
_LN2_32 = 2.0**-32


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) element hashes; rows of sets without elements are 0.

    ``owner`` says which set each element is in; elements are distinct within a set and sorted by owner.
    """
    out = np.zeros((n_sets, m), dtype=_U)
    total = np.bincount(owner, weight, n_sets)
    todo = np.flatnonzero(total > 0)
    slack = np.log(m) + 3.0
    while len(todo):
        limit = np.zeros(n_sets)
        limit[todo] = m * slack / total[todo]
        times, registers, who = _arrivals(element, weight, owner, limit, m)
        order = np.argsort(-times)
        slot = owner[who[order]].astype(np.int64) * m + registers[order]
        filled = np.zeros(n_sets * m, dtype=bool)
        filled[slot] = True
        out.ravel()[slot] = element[who[order]]  # the earliest is written last
        empty = ~filled.reshape(n_sets, m).all(axis=1)
        todo = todo[empty[todo]]
        slack *= 2
    return out


def _arrivals(element, weight, owner, limit, m):
    """Times, registers and element positions of all arrivals up to each set's limit."""
    active = np.flatnonzero(limit[owner] > 0)
    clock = np.zeros(len(active))
    rate, until, seed = weight[active], limit[owner[active]], element[active]
    times, registers, who = [], [], []
    k = 0
    while len(active):
        draw = mix(seed, salt=101 + k)
        gap = -np.log(((draw >> _U(32)).astype(np.float64) + 0.5) * _LN2_32) / rate
        clock = clock + gap
        on = np.flatnonzero(clock <= until)
        active, clock, rate, until, seed, draw = active[on], clock[on], rate[on], until[on], seed[on], draw[on]
        times.append(clock)
        registers.append((((draw & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)).astype(np.int64))
        who.append(active)
        k += 1
    if not times:
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(times), np.concatenate(registers), np.concatenate(who)
