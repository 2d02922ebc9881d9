"""The encoder and the operators built on it against the tokenizers as they are loaded, special strings, odd white space and accents included."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from streamatlas.llm import packing, token_files
from streamatlas.llm.queries import tokenizer_file
from streamatlas.llm.tokens import Encoder, with_end

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ALPHABET = "aAzZeJjéÉßΣσİǰŁſ̸̌́ \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  ‐   　​×÷.,!|$%&*#?;:'\"-_<>0195あ漢😀"
STRINGS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext|", "'s", "'LL", "  ", "word", "Word", " The", "</w>"]
SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "A.<|ENDOFTEXT|>!", " \n<|startoftext|><|endoftext|>\n ", "x<|endoftext|>́", "<|endoftext", None, "", "Hello, World!  Hello"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_tokenizer(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(STRINGS) if k % 2 and rng.random() < 0.2 else rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for k in range(20_000)]
    texts += ["", "word " * 60_000, "x" * 100_000, "é" * 5_000 + ". " + "\n" * 500]
    path = tokenizer_file(name)
    own, plain = Encoder(path), Tokenizer.from_file(path)
    for lo in range(0, len(texts), 7):
        part = texts[lo : lo + 7]
        ids, offsets = own.encode(pa.array(part))
        want = [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want, part
        ids, offsets = with_end(ids, offsets, 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[*x, 2] for x in want]


@pytest.mark.parametrize("name", FILES)
def test_encoder_with_full_dictionaries(name, monkeypatch):
    monkeypatch.setattr("streamatlas.llm.tokens.MEMO_PIECES", 5)
    rng = random.Random(6)
    path = tokenizer_file(name)
    own, plain = Encoder(path), Tokenizer.from_file(path)
    for _ in range(50):
        part = [" ".join(rng.choice(["one", "Two", "three,", "x" * 60, "é.", "!!", "seven"]) for _ in range(9)) for _ in range(3)]
        ids, offsets = own.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]


def test_encoder_takes_slices_and_empty_columns():
    path = tokenizer_file(FILES[0])
    own, plain = Encoder(path), Tokenizer.from_file(path)
    ids, offsets = own.encode(pa.array(["left out", "a b", "c"]).slice(1, 2))
    assert ids.tolist() == plain.encode("a b").ids + plain.encode("c").ids and offsets[-1] == len(ids)
    ids, offsets = own.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]
    ids, offsets = own.encode(pa.array(["", ""]))
    assert len(ids) == 0 and offsets.tolist() == [0, 0, 0]


def test_token_files_with_special_strings(spark):
    path = tokenizer_file(FILES[0])
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(SPECIAL)] + [(3, "twice"), (None, "no id")], "doc_id long, text string")
    folder, index = token_files.encode_to_files(docs, path)
    got = index.orderBy("start").collect()
    order = [(None, "no id"), *[(k, t) for k, t in enumerate(SPECIAL[:4])], (3, "twice"), *[(k, t) for k, t in enumerate(SPECIAL)][4:]]
    ids = {(d, t): plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t in order}
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(x), crc(x)) for (d, _), x in ids.items())
    assert [r.doc_id for r in got] == [d for d, _ in order]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    read = token_files.read_token_files(spark, folder).where("doc_id = 0").first()
    assert read.ids == [50256, 2]


def test_packing_of_cut_texts_with_special_strings(spark):
    path = tokenizer_file(FILES[1])
    plain = Tokenizer.from_file(path)
    texts = [*SPECIAL, "many words of a long text <|endoftext|> " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.pack_documents(docs, path, capacity=32).toPandas()
    for d, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        own = found[found.doc_id == d].sort_values("piece")
        want = [(k, lo, len(ids[lo : lo + 32]), crc(ids[lo : lo + 32])) for k, lo in enumerate(range(0, len(ids), 32))]
        assert list(zip(own.piece, own.start, own.length, own.ids_crc32)) == want
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 32 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
