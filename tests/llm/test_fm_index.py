import numpy as np
import pytest

from argentum.llm.fm_index import FMIndex, suffix_array


@pytest.mark.parametrize(("n", "symbols", "seed"), [(1, 3, 0), (60, 3, 1), (500, 4, 2), (3000, 60, 3), (3000, 2, 4)])
def test_search_locate_and_statistics(n, symbols, seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(2, 2 + symbols, n)
    text[n // 2 : n // 2 + n // 3] = text[: n // 3]
    index, told = FMIndex(text, rate=5), [*text.tolist(), 0]
    order = sorted(range(n + 1), key=lambda i: told[i:])
    assert suffix_array(np.append(text, 0)).tolist() == order
    assert index.locate(np.arange(n + 1)).tolist() == order
    patterns = np.concatenate([rng.integers(2, 3 + symbols, (30, 3)), text[rng.integers(0, max(1, n - 2), (30, 1)) + np.arange(3)]] if n > 5 else [np.array([[2, 2, 2], [99, 2, 2]])])
    left, right = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), left, right, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if told[i : i + 3] == p]
    ends = np.unique(rng.integers(1, n + 1, 40))
    length, _, _ = index.matching_statistics(text, ends, 8, wanted=2)
    whole = "".join(map(chr, text.tolist()))

    def occurs_twice(part):
        first = whole.find(part)
        return first >= 0 and whole.find(part, first + 1) >= 0

    for e, found in zip(ends.tolist(), length.tolist(), strict=True):
        assert found == max((k for k in range(1, min(8, e) + 1) if occurs_twice(whole[e - k : e])), default=0)
