import hashlib
import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import bpe
from scorelake.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
REF = tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.merges_at(vocabulary()))


def ids_of(encoder, text):
    return [i for block in encoder.encode(text) for i in bpe._ids(block)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    enc = bpe.Encoder(bpe.merges_at(vocabulary()))
    want = REF.encode(text, add_special_tokens=False).ids
    assert ids_of(enc, text) == want
    assert bpe.Decoder(bpe.merges_at(vocabulary())).feed(want, True) == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "<|endoftext|> x<|endoftext|>", "  \n\n  it's  'S 12345 \x1c\x85", "the" * 4000, "\U0001f600" * 300])
def test_long_pieces_and_special_tokens(encoder, text):
    assert ids_of(encoder, text) == REF.encode(text, add_special_tokens=False).ids


def test_streaming_equals_whole_and_memory_stays_bounded():
    merges = bpe.merges_at(vocabulary())
    rng = random.Random(3)
    for alphabet in ("ab", "thean", "aeinorst"):
        b = "".join(rng.choice(alphabet) for _ in range(60_000)).encode()
        t = bpe.Transducer(merges)
        got = list(t.run(b[i : i + 100] for i in range(0, len(b), 100)))
        assert got == REF.encode(b.decode(), add_special_tokens=False).ids
        assert t.most_kept <= 4 * (merges.lookahead + merges.longest)


def test_side_by_side_is_what_encoding_gives():
    merges = bpe.merges_at(vocabulary())
    rng = random.Random(5)
    words = [b for b in merges.usable if b.isalpha() and b.isascii()]
    for _ in range(3000):
        x, y = rng.choice(words), rng.choice(words)
        want = REF.encode((x + y).decode(), add_special_tokens=False).ids == [merges.usable[x], merges.usable[y]]
        assert merges.side_by_side(merges.usable[x], merges.usable[y]) == want


def test_decoder_replaces_malformed_bytes_across_calls():
    merges = bpe.merges_at(vocabulary())
    ids = REF.encode("é漢", add_special_tokens=False).ids
    d = bpe.Decoder(merges)
    assert "".join([d.feed([i]) for i in ids]) + d.feed((), True) == "é漢"
    broken = [merges.id_of[b"\xe6"], merges.id_of[b"a"]]
    assert bpe.Decoder(merges).feed(broken, True) == REF.decode(broken, skip_special_tokens=False)


def test_columns(spark, odd, odd_texts, empty):
    rows = bpe.round_trip(odd.select("doc_id", "text", "q"), vocabulary()).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            text = odd_texts[r.doc_id] or ""
            ids = REF.encode(text, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.q == "q"
    both = bpe.decode(bpe.encode(odd.select("doc_id", "text"), vocabulary()), vocabulary()).collect()
    assert all(r.decoded == (r.text or "") for r in both)
    assert bpe.round_trip(empty.select("doc_id", "text"), vocabulary()).collect() == []


def test_special_tokens_of_any_spelling_and_refused_settings(tmp_path):
    spec = json.load(open(vocabulary(), encoding="utf-8"))
    spec["added_tokens"][0] |= {"content": "[SEP]"}
    path = tmp_path / "sep.json"
    path.write_text(json.dumps(spec))
    text = "a[SEP] b[SEP][SEP"
    assert ids_of(bpe.Encoder(bpe.Merges.from_file(str(path))), text) == tokenizers.Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"unk_token": "a"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Merges.from_file(str(path))
