"""The automata find every occurrence of the confirmed phrases, and what they find decides."""

import random

import numpy as np
import pyarrow as pa

from siteline.llm import passages as P
from tests.llm import brute


def texts(seed=4):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(40)}"
    common = [[word() for _ in range(n)] for n in (25, 40, 21)]
    out = []
    for _ in range(30):
        t = [word() for _ in range(r.randrange(60))]
        for c in r.sample(common, r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = c
        out.append(" ".join(t))
    return [*out, "", None, " \n", " ".join(["a"] * 90), "a " * 50]


def confirmed(parts):
    keys, counts = P.anchor_counts(parts)
    return keys[counts >= 2]


def test_automata_find_every_occurrence():
    parts = P.slices(pa.array(texts()))
    keys = confirmed(parts)
    places = P.occurrences(parts, keys)
    for s, at in zip(parts, places, strict=True):
        inside = np.flatnonzero(np.isin(s.phrases, keys))
        own = s.w.doc
        inside = inside[own[inside] == own[inside + P.PHRASE - 1]]
        assert at.tolist() == inside.tolist()
    assert sum(map(len, places)) and [x.tolist() for x in P.unpack_places(parts, P.pack_places(parts, places)[0])] == [x.tolist() for x in places]


def test_what_the_automata_find_decides():
    own = texts()
    parts = P.slices(pa.array(own))
    ids = np.arange(len(own))

    def removed(places):
        keys, checks, _, _ = P.candidate_windows(parts, places)
        first = np.ones(len({*zip(keys.tolist(), checks.tolist(), strict=True)}), bool)
        return [int(x) for s, gone in zip(parts, P.removed_words(parts, ids, places, first), strict=True) for x in P.T.per_doc(gone, s.w.bounds)]

    want = {i: v[1] for i, v in brute.passages(list(enumerate(own))).items()}
    assert dict(enumerate(removed(P.occurrences(parts, confirmed(parts))))) == want and sum(want.values())
    assert not sum(removed([np.empty(0, np.int64) for _ in parts]))
