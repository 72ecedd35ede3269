"""Awkward documents for all operators."""

import random

WORDS = "the and attion erin thonorn onble reing thst ouned hand wherea lying sond tior erever nting".split()


def prose(n, seed, lines=4):
    r = random.Random(seed)
    w = ["".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(w[k : k + step]) for k in range(0, n, step))


def rows():
    base = [(i, prose(60, i), "en", f"s{i % 3}", None) for i in range(20)]
    base += [(100 + i, base[i][1], "fr", None, 5) for i in range(5)]  # exact copies
    base += [(200, None, None, "s1", None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", None, 3), (203, "x" * 30_000, "en", "s2", 30_000), (204, prose(20_000, 9, 300), "en", "s2", None), (None, "no id here at all", "en", "s0", None), (None, None, None, None, None)]
    base += [base[3], base[3]]  # repeated rows
    base += [(300, "the word the word the word " * 40, "en", "s0", 1), (301, "é ß ñ 漢字 ▁ mark  two", "de", "s0", 1)]
    return base
