from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from furrow.llm.words import chunks, shingle_hashes, utf8_buffers, word_hashes

TEXTS = ["a b c d e", None, "", "A B  c\td\ne", "é É x y", "one", " lead and trail ", "one"]


def test_word_hashes_agree_with_a_plain_split():
    data, off = utf8_buffers(pa.array(TEXTS))
    h, rows = word_hashes(data, off)
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in TEXTS]
    assert np.diff(rows).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(h.tolist()))
    assert {w: x for w, x in zip(flat, h.tolist())} == dict(reversed([(w, x) for w, x in zip(flat, h.tolist())]))
    parts = [word_hashes(data, off[i : j + 1])[0] for i, j in chunks(off, 5)]
    assert np.concatenate(parts).tolist() == h.tolist()


def test_shingles_of_short_rows_are_the_whole_row():
    h, rows = word_hashes(*utf8_buffers(pa.array(["a b", "a b c d", "a b c d e", ""])))
    s, at = shingle_hashes(h, rows, 4)
    assert np.diff(at).tolist() == [1, 1, 2, 0]
    assert s[1] == s[2] and s[0] != s[1]
