import random

import numpy as np

from skuflow.llm.double_array import pack


def test_walks_equal_a_dictionary():
    rng = random.Random(5)
    for codes in (3, 40, 5000):
        parent, code, known = [-1], [0], {(): 0}
        for _ in range(800):
            path = ()
            for _ in range(rng.randint(1, 6)):
                step = min(rng.randint(1, codes), rng.randint(1, codes))
                if (*path, step) not in known:
                    known[(*path, step)] = len(parent)
                    parent.append(known[path])
                    code.append(step)
                path = (*path, step)
        trie = pack(np.array(parent), np.array(code))
        assert len(set(trie.cell.tolist())) == len(parent)
        for path, node in rng.choices(sorted(known.items()), k=300):
            state = np.zeros(1, dtype=np.int64)
            for step in path:
                state = trie.step(state, np.array([step]))
            assert state[0] == trie.cell[node]
            wrong = rng.randint(1, codes + 2)
            there = trie.step(state, np.array([wrong]))[0]
            assert there == (trie.cell[known[(*path, wrong)]] if (*path, wrong) in known else -1)


def test_root_alone_and_dead_states():
    trie = pack(np.array([-1]), np.array([0]))
    assert trie.step(np.array([0, -1]), np.array([1, 1])).tolist() == [-1, -1]
