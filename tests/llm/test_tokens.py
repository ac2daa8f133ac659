import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldaudit.llm import tokens as k
from fieldaudit.llm.common import new_path
from fieldaudit.llm.q_tokens import END, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]


def plain(rows, tokenizer):
    out, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_round_trip(docs_of, awkward, tokenizer, by_word):
    rows = awkward + [(60, "don't <|endoftext|>x <|startoftext|> \x1c\x85 Å Å ΣΑΣ", "a")]
    got = [tuple(r) for r in k.tokens_round_trip(docs_of(rows, clash=True), vocabulary(), END, by_word).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(rows, tokenizer)


def test_files(spark, docs_of, awkward, tokenizer, monkeypatch):
    monkeypatch.setattr(k, "FILE_BYTES", 2_000)
    folder = new_path(spark, "tokens")
    manifest = k.write_tokens(docs_of(awkward), folder, vocabulary(), END, True)
    files = manifest.orderBy("part", "seq").collect()
    assert len(files) > 1 and sum(f.docs for f in files) == len(awkward)
    dictionary = k.read_bytes(f"{folder}/{files[0].dictionary}.dictionary")
    text = {i: t for i, t, _ in awkward}
    seen = []
    for f in files:
        reader = k.Reader(f.path, dictionary)
        seen += reader.ids.tolist()
        for i in reader.ids.tolist():
            if i != k.NO_ID:
                assert reader.document(i).tolist() == ids_of(tokenizer, text[i])
        assert reader.document(10 ** 12) is None
        with pytest.raises(ValueError):
            k.Reader(f.path, dictionary + b"x")
    assert seen == sorted(seen)
    ids = {r.doc_id: r.ids for r in k.read_tokens(spark, manifest, folder, with_ids=True).collect()}
    assert ids[20] == ids_of(tokenizer, text[20])


def test_empty_table(docs_of):
    assert k.tokens_round_trip(docs_of([]), vocabulary(), END, True).count() == 0


def test_dictionary_shortens_short_documents(tokenizer):
    texts = [f"the quick brown fox number {n} jumps over the lazy dog and runs {n} miles" for n in range(3_000)]
    arrays = [np.array(ids_of(tokenizer, t), "<u2").tobytes() for t in texts]
    dictionary = k.train_dictionary(arrays[:2_000], 8_192)
    assert dictionary
    with_it = sum(len(k.compressor(dictionary).compress(a)) for a in arrays[2_000:])
    assert with_it < 0.7 * sum(len(k.compressor(b"").compress(a)) for a in arrays[2_000:])
    assert k.decompressor(dictionary).decompress(k.compressor(dictionary).compress(arrays[0])) == arrays[0]
    assert k.train_dictionary([b"ab"]) == b""


def test_words_are_forgotten_and_encoded_again(monkeypatch, tokenizer):
    monkeypatch.setattr(k, "CACHE_BYTES", 3 * k.ENTRY_BYTES)
    encoder = k.Encoder(vocabulary(), END, True)
    for text in ("one two three four five", "six seven", "one nine"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(tokenizer, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aBzÉéßÿœΣ\u0301\u00d7'.,!|<>-12_日 \x1c\u00a0\n", max_size=12), max_size=4))
def test_words_by_lookup_equal_whole_texts(texts):
    for text in (*texts, " ".join(texts)):
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids_of(ENCODER.tokenizer, text)


def test_plain_words_go_to_the_model():
    assert ENCODER.direct


ENCODER = k.Encoder(vocabulary(), END, True)
