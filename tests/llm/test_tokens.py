import random

import numpy as np
import pytest

from tamis.llm import tokens

PARTS = ["a", "The", "don't", "x's", " ", "  ", "   ", "\n", "\n\n", "\t", ".", ",", "!!", "é", "Straße", "ÀB", "12", "3a", "²", "µ", "ª", "_", "$$$", "|", "'", "''s", "\r\n", "-", "漢", "İ", "<|endoftext|>", "\x85", "\xa0", "\x1c", "word"]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_same_ids_as_the_library_on_whole_texts(name, spark, sf_dir, monkeypatch):
    rng = random.Random(8)
    texts = ["", " ", "\n", "  ", " a", "a ", "a\n", "\na", "a\n\n", "\n\n", "\n\na", "\n\n\na", "a\n b", "a \nb", " \n"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts += ["".join(rng.choice(PARTS[:27]) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts += [" ".join(rng.choice(PARTS[:27]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    monkeypatch.setattr(tokens, "CACHE_UNITS", 500)
    enc = tokens.Encoder(name)
    for text, got in zip(texts, enc.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(enc.units) <= 500
