import random

import pyarrow as pa
from conftest import ALNUM, BLANK, words  # noqa: F401

from lexweave.llm.words import BLANKS, NOT_ALNUM, hashed


def test_hashes_tell_words_apart():
    random.seed(1)
    texts = ["".join(random.choice("aAbB  \n.9é") for _ in range(random.choice([0, 1, 5, 50, 3000]))) for _ in range(500)] + [None, "", "  ", "é"]
    seen, back = {}, {}
    for separators, pattern in ((BLANKS, "[^\x20\x09-\x0d]+"), (NOT_ALNUM, r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        n = 0
        for at, h, b in hashed(pa.array(texts), separators):
            for i in range(len(b) - 1):
                w = words(texts[at + i], pattern)
                g = h[b[i] : b[i + 1]].tolist()
                assert len(w) == len(g)
                for u, v in zip(w, g, strict=True):
                    assert seen.setdefault(u, v) == v and back.setdefault(v, u) == u
                n += 1
        assert n == len(texts)
