"""Open windows as the method says, and what the encoder may assume of a tokenizer."""

import json
import random

import numpy as np
import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import packing
from lakewright.llm.queries import tokenizer_file


def test_a_full_piece_needs_no_window():
    w = packing.Windows(2048, 2, 0)
    assert [w.put(n) for n in (1000, 1500, 2048, 500)] == [(0, 0), (1, 0), (2, 0), (1, 1500)]


def test_the_fullest_goes_when_none_fits():
    w = packing.Windows(100, 2, 10)
    assert [w.put(n) for n in (60, 80, 50)] == [(10, 0), (11, 0), (12, 0)]  # 80 is emitted, 60 and 50 stay
    assert w.open == [(50, 12), (60, 10)] and w.put(40) == (10, 60) and w.put(50) == (12, 50) and not w.open


@pytest.mark.parametrize("most", [1, 4, 16])
def test_windows_against_a_plain_search(most):
    r = random.Random(most)
    w, plain, fresh = packing.Windows(64, most, 0), {}, 0
    for _ in range(3000):
        n = r.choice([64, *range(1, 64)])
        fit = [(fill, seq) for seq, fill in plain.items() if fill + n <= 64] if n < 64 else []
        if fit:
            fill, seq = max(fit)
        else:
            if n < 64 and len(plain) >= most:
                del plain[max((fill, seq) for seq, fill in plain.items())[1]]
            fill, seq, fresh = 0, fresh, fresh + 1
        assert w.put(n) == (seq, fill)
        plain.pop(seq, None)
        if fill + n < 64:
            plain[seq] = fill + n
        assert len(w.open) == len(plain) <= most


TEXTS = ["It's A Text,  with\tblanks and ÄÖ ^ signs.", "", "<|endoftext|>x<|ENDOFTEXT|>", "İstanbul ǅ é don't 123", "a b　c ^^ d"]


def test_other_tokenizers_are_not_guessed_at(tmp_path):
    own = packing.Encoder(tokenizer_file("word_bpe_49k.json"))
    assert own.lowers and own.by_run
    spec = json.load(open(tokenizer_file("word_bpe_49k.json")))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    cased = packing.Encoder(str(tmp_path / "cased.json"))
    spec["normalizer"] = None
    (tmp_path / "raw.json").write_text(json.dumps(spec))
    raw, other = packing.Encoder(str(tmp_path / "raw.json")), packing.Encoder(tokenizer_file("byte_bpe_50k.json"))
    assert not cased.lowers and cased.by_run and not raw.by_run and not other.by_run
    for e in (own, cased, raw, other):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([*TEXTS, None])] == [e._alone(t) for t in [*TEXTS, ""]]
