"""Keyed access to token shards: what a key costs, against whole shards."""

import numpy as np
import pytest

from siteline.llm import token_store as S


class Counting:
    """A file that adds up what is read of it."""

    def __init__(self, file):
        self.file, self.reads, self.bytes = file, 0, 0

    def read_at(self, n, offset):
        out = self.file.read_at(n, offset)
        self.reads, self.bytes = self.reads + 1, self.bytes + len(out)
        return out


def shard(path, n, wide, seed=1):
    """A shard of ``n`` keys, some with several rows, with null keys before them."""
    rng = np.random.default_rng(seed)
    keys = np.sort(rng.choice(np.arange(-(1 << 40), 1 << 40, 10_000_019), n, replace=False)).tolist() if n else []
    keys = [k for k in keys for _ in range(3 if k % 5 == 0 else 1)]
    rows = [rng.integers(0, 1 << (20 if wide else 16), rng.integers(0, 40)).astype(np.uint32) for _ in range(len(keys) + 2)]
    S.write_shard(f"file://{path}", [None, None, *keys], rows)
    held = {}
    for k, r in zip(keys, rows[2:], strict=True):
        held.setdefault(k, []).append(r.tolist())
    return held


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_each_key_finds_its_rows(tmp_path, n, wide):
    held = shard(tmp_path / "a", n, wide)
    own = S.Keyed(f"file://{tmp_path / 'a'}")
    assert {k: [x.tolist() for x in own.ids_of(k)] for k in held} == held
    absent = [k for k in range(-500, 500) if k not in held]
    assert sum(bool(own.ids_of(k)) for k in absent) == 0  # a fingerprint of 32 bits
    whole = S.Shard(f"file://{tmp_path / 'a'}")
    assert all([whole.ids(r).tolist() for r in whole.rows_of(np.array([k]))[0]] == v for k, v in held.items())


def test_a_key_costs_the_same_in_a_larger_shard(tmp_path):
    most = []
    for n in (200, 4_000):
        held = shard(tmp_path / str(n), n, True)
        own = S.Keyed(f"file://{tmp_path / str(n)}")
        own.file = Counting(own.file)
        for k in list(held)[:: n // 100]:
            before = own.file.reads, own.file.bytes
            assert [x.tolist() for x in own.ids_of(k)] == held[k]
            rows = len(held[k])
            assert own.file.reads - before[0] == 4
            assert own.file.bytes - before[1] == 4 + 12 + 8 * (rows + 1) + 4 * sum(map(len, held[k]))
        most.append(own.file.bytes)
    size = (tmp_path / "4000").stat().st_size
    assert max(most) < size / 20


def test_a_file_of_something_else_raises(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="not a token shard"):
        S.Keyed(f"file://{tmp_path / 'a'}")
