"""Ids that packing makes of whole texts, against the library."""

import random

import numpy as np
import pytest

from folio.llm import packing
from tests.llm.test_llm import BPE, ODD, library

RUNS = ["x" * 50_000, "ab" * 25_000, "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), " " * 50_000]


@pytest.mark.parametrize("text", [*(t for _, t in ODD if t), *RUNS, "caf\u00e9 \u024f", "\u0250 far", "a<|endoftext|>b", "don't  \x1c\x85 x\u00a0y"])
def test_ids_of_whole_texts(text):
    found = np.frombuffer(packing.text_ids(text, BPE), "<u4").tolist()
    assert found == library().encode(text, add_special_tokens=False).ids


def test_ids_of_mixed_latin_texts():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abcde\u00e9\u00fc\u00df \n\t'.,!0129\xa0\x85\x1c\x1fAZ<|>\u00b2\u00bd") for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(packing.text_ids(text, BPE), "<u4").tolist() == library().encode(text, add_special_tokens=False).ids
