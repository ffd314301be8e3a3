import hashlib
import random

import numpy as np
import pytest
import tiktoken

from sedimenta.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    path, pattern = byte_bpe.public_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.codec(path, pattern).ranks, special_tokens={})


def texts():
    r = random.Random(4)
    odd = ["", "a", "<|endoftext|>", "\x1c\x1d x\x1f y\x85z", "é" * 70, "a" * 5000, "xyzzy" * 400 + " \n\n  q", "漢字　\xa0 1234567890123 ½ ²", "it's we'll I'd\t\ttab   end  ", "🙂🙃" * 50, "​﻿ x", "İß́"]
    mixed = ["".join(r.choice("abcdefghi  \n\t'sté漢9_") for _ in range(r.randint(1, 400))) for _ in range(120)]
    return odd + mixed


def test_as_the_library(library):
    c = byte_bpe.codec(*byte_bpe.public_vocabulary())
    ids, ends = c.encode(texts())
    starts = np.append(0, ends[:-1])
    for t, a, b in zip(texts(), starts, ends):
        assert ids[int(a) : int(b)].tolist() == library.encode_ordinary(t)
    assert c.decode(ids, ends) == [t.encode() for t in texts()]


def test_queue_equals_recursion():
    c = byte_bpe.codec(*byte_bpe.public_vocabulary())
    r = random.Random(8)
    pieces = ["".join(r.choice("abehinorst") for _ in range(r.randint(2, 60))).encode() for _ in range(500)]
    tokens, sizes = c._contract(pieces)
    assert [c._queue(p) for p in pieces] == [t.tolist() for t in np.split(tokens, np.cumsum(sizes)[:-1])]


def test_unspaced_text_does_not_spill(tmp_path, monkeypatch, library):
    """Thousands of pieces of just under LONG bytes: batches are cut by the rows that the recursion keeps."""
    monkeypatch.chdir(tmp_path)
    r = random.Random(3)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(21)) for _ in range(6000)]
    ids, _ = byte_bpe.Codec(*byte_bpe.public_vocabulary()).encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert not list(tmp_path.iterdir())


def test_forgetting(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KEEP", 40)
    c = byte_bpe.Codec(*byte_bpe.public_vocabulary())
    for t in texts():
        ids, _ = c.encode([t])
        assert ids.tolist() == library.encode_ordinary(t)


def test_tables(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(900, None, 1), (None, "a b", 1), (3, "dup", 1), (3, "dup", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = sorted((r for r in byte_bpe.token_digests(df).collect()), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 3 or r.doc_id is None:
            continue
        t = rows[r.doc_id][1] if r.doc_id < 900 else ""
        want = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = byte_bpe.encode(df)
    back = {r.doc_id: bytes(r.data) for r in byte_bpe.decode(encoded).collect()}
    assert back[900] == b"" and all(back[i] == t.encode() for i, t, _ in rows[:-4] if i != 3)
    assert byte_bpe.token_digests(df.limit(0)).collect() == [] and byte_bpe.decode(byte_bpe.encode(df.limit(0))).collect() == []


def test_unknown_id(spark):
    with pytest.raises(KeyError):
        c = byte_bpe.codec(*byte_bpe.public_vocabulary())
        c.decode(np.array([1, 99999]), np.array([2]))
