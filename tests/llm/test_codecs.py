"""Codecs and formats without Spark: exact round trips, and the libraries' own results."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex as re
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm import op01_gif as gif
from meridia.llm import op03_simple8b as s8
from meridia.llm import op08_language as lid
from meridia.llm import op10_chat as chat
from meridia.llm.gsaca import suffix_array
from meridia.llm.op09_piece_bpe import PieceBpe


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_gif_round_trip(raw):
    media = gif.text_to_gif(raw)
    payload = b"".join(f.samples.tobytes() for f in gif.gif_decode(media))
    assert payload.startswith(raw) and len(payload) % 64 == 0 and 0 < len(payload) <= max(64, len(raw) + 63)
    assert not payload[len(raw) :].strip(b"\0")


def test_gif_long_and_low_bits():
    r = random.Random(1)
    for n in (70_000, 200_000):
        raw = bytes(r.choice(b"abcd") for _ in range(n))
        assert b"".join(f.samples.tobytes() for f in gif.gif_decode(gif.text_to_gif(raw))).startswith(raw)
        assert gif.lzw_decode(gif.lzw_encode(bytes(b & 3 for b in raw), 2), 2) == bytes(b & 3 for b in raw)


def test_gif_cut_off():
    whole = gif.text_to_gif(b"x" * 200_000)
    full = gif.gif_decode(whole)
    for n in range(14 + 768, len(whole), 997):
        got = []
        try:
            for f in gif.gif_stream(whole[:n]):
                got.append(f.samples)
        except ValueError:
            pass
        assert len(got) <= len(full) and all((a == b.samples).all() for a, b in zip(got[:-1], full, strict=False))


def test_piece_starts():
    from meridia.llm.common import flat
    from meridia.llm.pieces import piece_starts
    from meridia.llm.pretokens import EASY, GPT2, splitter

    r, split = random.Random(3), splitter(GPT2)
    texts = ["".join(r.choice("ab'stdmrevl  \n\t.,7éÿ") for _ in range(r.randrange(40))) for _ in range(3000)]
    assert all(map(EASY, texts))
    data, off = flat(pa.array(texts))
    at = piece_starts(data, off)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        own = at[(at >= off[k]) & (at < off[k + 1])].tolist()
        assert [raw[x:y].decode() for x, y in zip(own, [*own[1:], int(off[k + 1])], strict=False)] == split(t)


def test_piece_bpe_needs_all_bytes(tmp_path):
    with open(tmp_path / "few", "wb") as f:
        f.write(b"".join(base64.b64encode(bytes([c])) + b" %d\n" % k for k, c in enumerate(b"ab")))
    few = PieceBpe(str(tmp_path / "few"), P.PATTERN)
    assert np.frombuffer(few.encode("abba"), "<u4").tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        few.encode("abc")


def test_gif_disposal_and_transparency():
    colours = np.zeros((256, 3), np.uint8)
    colours[:3] = [[255, 0, 0], [0, 255, 0], [0, 0, 255]]
    fill = lambda v, h, w: np.full((h, w), v, np.uint8)
    frames = [gif.Frame(fill(0, 4, 4), delay_cs=5, disposal=1), gif.Frame(fill(1, 2, 2), 1, 1, 7, 2), gif.Frame(fill(2, 1, 4), 0, 0, 9, 3, 2), gif.Frame(fill(2, 1, 1), 3, 3, 0, 0)]
    frames[2].samples[0, 0] = 1
    got = gif.gif_decode(gif.gif_encode(frames, 4, 4, colours))
    a, b, c, d = (f.canvas for f in got)
    assert [f.delay_cs for f in got] == [5, 7, 9, 0]
    assert (a[..., 0] == 255).all() and b[1, 1].tolist() == [0, 255, 0, 255] and b[0, 0].tolist() == [255, 0, 0, 255]
    assert c[1, 1].tolist() == [0, 0, 0, 0]  # disposal 2 cleared it
    assert c[0, 0].tolist() == [0, 255, 0, 255] and c[0, 1].tolist() == [255, 0, 0, 255]  # index 2 is transparent
    assert d[0, 0].tolist() == [255, 0, 0, 255]  # disposal 3 restored it
    assert gif.histogram(c).sum() == 12 and gif.histogram(a)[0b110000] == 16
    whole = gif.gif_encode(frames, 4, 4, colours)
    at = whole.index(b"\x2c")
    big = whole[:6] + b"\xff\xff\xff\xff" + whole[10:]
    for bad in (b"", b"GIF89a", b"nonsense nonsense", big, *(whole[: at + 10] + bytes([n]) + whole[at + 11 :] for n in (0, 9, 70, 200))):
        with pytest.raises(ValueError):
            gif.gif_decode(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    words, offsets = s8.encode(np.array(ids, np.uint64))
    assert s8.decode(words).tolist() == ids
    assert len(offsets) == -(-len(ids) // s8.BLOCK)


def test_simple8b_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 10_000).astype(np.uint64)
    words, offsets = s8.encode(ids)
    for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], len(words)], strict=True)):
        assert (s8.decode(words[a:b]) == ids[k * s8.BLOCK : (k + 1) * s8.BLOCK]).all()
    zeros = s8.encode(np.zeros(5000, np.uint64))[0]
    assert len(zeros) < 60 and not s8.decode(zeros).any()


@pytest.fixture(scope="module")
def coders():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = PieceBpe(path, P.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), s8.Coder(P.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_byte_bpe_equals_the_libraries(coders, text):
    own, library, plain = coders
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()
    assert np.frombuffer(plain.encode(text), "<u4").tolist() == plain.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=60) | st.text(max_size=60))
def test_suffix_array(text):
    raw = text.encode()
    assert suffix_array(raw) == sorted(range(len(raw)), key=lambda i: raw[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), st.text(alphabet="<|\\/INST[]endturx>s é\n", max_size=40)), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(5)
    for _ in range(200):
        s = r.normal(0, 6, (r.integers(1, 6), 3))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 8.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=len(s))))
        assert value(lid.viterbi(s, 8.0).tolist()) == pytest.approx(best)


def test_language_spans_and_scripts():
    samples = [("en", "the house is on the hill and the man sees it "), ("de", "das haus steht auf dem berg und der mann sieht es "), ("ru", "дом стоит на горе и человек видит его ")]
    model = lid.Model([(lang, text * 5) for lang, text in samples])
    got = lid.spans(model, "the house is on the hill " * 3 + "das haus steht auf dem berg " * 3 + "дом стоит на горе")
    assert [x[2] for x in got] == ["en", "de", "ru"]
    assert got[2][1] == 4


def test_language_letters_by_category_and_range():
    text = "“Größe” — naïve…×÷ Дом，家。カナ 한글 हिंदी ไทย 😀 ½ № ａＢ don’t"
    raw = np.frombuffer(text.encode(), np.uint8)
    w = lid.Words(raw, np.array([0, len(raw)]))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    want = re.findall(r"[\p{L}\p{M}]+", lower(text))
    said = [bytes(w.bytes[w.of == k]).strip(b"\0").decode() for k in w.word]
    assert said == want
    script = {said[k]: {lid.SCRIPTS[s] for s in range(len(lid.SCRIPTS)) if w.scripts[w.word[k]] >> s & 1} for k in range(len(said))}
    assert script["größe"] == script["don"] == script["ａＢ"] == {"latin"} and script["Дом"] == {"cyrillic"}
    assert script["家"] == {"han"} and script["カナ"] == {"kana"} and script["한글"] == {"hangul"} and script["हिंदी"] == {"indic"} and script["ไทย"] == {"thai_lao"}
    nothing = np.frombuffer("“—” 😀 12 ₤".encode(), np.uint8)
    assert lid.Words(nothing, np.array([0, len(nothing)])).n == 0
