import numpy as np
import pytest

from colsense.llm.passages import SuffixLevels


@pytest.mark.parametrize("slice_rows", [3, 16, 1 << 16])
@pytest.mark.parametrize("letters", [(97, 99), (0, 2), (0, 256)])
def test_levels_give_the_smallest_id_of_each_string(slice_rows, letters):
    rng, length = np.random.default_rng(1), 8
    data = rng.integers(*letters, 1200).astype(np.uint8)
    places = np.arange(len(data) - length + 1)
    ids = np.sort(rng.integers(0, 90, len(places)))
    shuffled = rng.permutation(places)
    answer = SuffixLevels(data, length, slice_rows).add(shuffled, ids[shuffled])
    whole = {}
    for p in places:
        whole.setdefault(data[p:p + length].tobytes(), ids[p])
    assert answer.tolist() == [whole[data[p:p + length].tobytes()] for p in shuffled]
    family, least = SuffixLevels(data, length, slice_rows), {}
    for batch in np.array_split(places, 13):
        for p in batch:
            key = data[p:p + length].tobytes()
            least[key] = min(least.get(key, 1 << 60), ids[p])
        assert [least[data[p:p + length].tobytes()] for p in batch] == family.add(batch, ids[batch]).tolist()
    sizes = [len(x[0]) for x in family.levels]
    assert sum(sizes) >= len(least) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for at, _ in family.levels:
        found = [data[p:p + length].tobytes() for p in at]
        assert found == sorted(set(found))


def test_levels_of_nothing():
    family = SuffixLevels(np.zeros(0, np.uint8), 50)
    assert len(family.add(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert family.levels == []
