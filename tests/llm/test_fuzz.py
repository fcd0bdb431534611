"""Seeded random texts, with odd white space, marks and control strings, against the libraries and plain versions."""

import random
import re

import pyarrow as pa
import pytest
from test_documents import lower, plain_base, plain_fingerprint

from quillstone.llm import decontaminate, pieces, quality_rules, simhash, token_counts
from quillstone.llm.common import utf8_buffer

ODD = [" ", " ", " ", "a", "b", "Z", "0", ".", "'s", "\n", "\t", "\r", "\x00", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "▁", "é", "é", "ß", "日", "😀", "​", "<|endoftext|>", "<s>", "<0x0A>", "#", "&", "word ", "a b "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choices(ODD, k=rng.choice([0, 1, 5, 40, 150]))) for _ in range(1500)]


def test_token_counts_and_pieces(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.count_tokens(pa.array(texts), t).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    c = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids, want = c.encode(pa.array(texts)), c.sp.encode(texts, add_bos=True, add_eos=True)
    assert ids.to_pylist() == want and c.decode(ids) == c.sp.decode(want)


def test_base_rules_fingerprints_and_words(texts):
    base = quality_rules.base_columns(*utf8_buffer(pa.array(texts)))
    assert [tuple(int(base[n][i]) for n in quality_rules.OWN[:5]) for i in range(len(texts))] == [plain_base(x)[:5] for x in texts]
    fp = simhash.majority([simhash.shingle_hashes(x.encode()) for x in texts])
    assert fp.tolist() == [plain_fingerprint(x) for x in texts]
    hashes, ends = decontaminate.words(pa.array(texts))
    word, seen = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for i, x in enumerate(texts):
        plain, own = word.findall(lower(x)), hashes[ends[i] : ends[i + 1]].tolist()
        assert len(plain) == len(own) and all(seen.setdefault(h, w) == w for h, w in zip(own, plain, strict=True))
