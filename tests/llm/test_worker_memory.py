"""Two Python workers share an executor with its JVM, so what one holds is bounded."""

import subprocess
import sys

import pytest

from sentrylake.llm.common import tokenizer_path
from sentrylake.session import ROOT

START = """
import re, sys
import numpy as np
from sentrylake.llm import encode, lm, packing
from sentrylake.llm.common import tokenizer_path

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) // 1024

before, rng, most = held(), np.random.default_rng(1), 0
groups = ([bytes(w) for w in rng.integers(97, 123, (50_000, 8), np.uint8)] for _ in range(24))  # 1.2 million words
"""
PACKING = """
code = encode.Encoder(tokenizer_path("byte_bpe_50k.json"), 2, False, packing.MEMO)
for words in groups:
    code.ids(b" ".join(words))
    most = max(most, held() - before)
"""
SCORING = """
own = lm.Words(lm._encode(tokenizer_path("byte_bpe_multi_50k.tiktoken")), 50_256, lm.SCORE, lambda a, b: np.zeros(len(a)))
for words in groups:
    own.ids(own.numbers([words]))
    if len(own) > own.keep:
        own.forget()
    most = max(most, held() - before)
"""


@pytest.mark.parametrize(("body", "least"), [(PACKING, 200), (SCORING, 115)])
def test_a_worker_that_meets_many_words_holds_little(body, least):
    run = subprocess.run([sys.executable, "-c", START + body + "print(most)"], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(run.stdout) < least


def test_the_second_tokenizer_waits_for_a_text_that_needs_it():
    from sentrylake.llm.encode import Encoder

    code = Encoder(tokenizer_path("byte_bpe_50k.json"), 2)
    code.ids(b"plain words <|endoftext")
    assert "plain" not in vars(code)
    code.ids(b"plain words <|endoftext|>")
    assert "plain" in vars(code)
