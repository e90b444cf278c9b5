"""Operators in Spark against brute force, on odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from conftest import ODD, prose  # noqa: F401

from meridia.llm import op01_gif, op03_simple8b, op05_suffix, op06_quality, op07_winnow, op08_language, op09_piece_bpe, op10_chat
from meridia.llm.op04_url_trust import judge_pages
from meridia.llm.pretokens import splitter
from meridia.llm.samples import chosen


def texts(rows):
    return [(i, t or "") for i, t in rows]


def test_gif(spark, odd_docs, empty_docs):
    got = {r.doc_id: r for r in op01_gif.store_texts(odd_docs).mapInArrow(op01_gif._summary, op01_gif.SUMMARY).collect()}
    for i, t in texts(ODD):
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7].feature == got[8].feature and got[7].media_sha256 == got[8].media_sha256
    assert op01_gif.store_texts(empty_docs).count() == 0
    media = spark.createDataFrame([(1, bytearray(op01_gif.text_to_gif(b"x" * 200_000))), (2, bytearray(b"no")), (3, None)], "media_id long, media binary")
    frames = op01_gif.gif_frames(media).orderBy("media_id", "frame").collect()
    assert [f.at_ms for f in frames if f.media_id == 1] == [0, 40, 80, 120] and b"".join(f.samples for f in frames if f.media_id == 1)[:200_000] == b"x" * 200_000
    assert [f.media_id for f in frames if f.error] == [2, 3]


def test_simple8b(spark, odd_docs, empty_docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    op03_simple8b.write_ids(odd_docs, P.path("byte_bpe_50k.json"), str(tmp_path / "ids"))
    start = 0
    for r, (i, t) in zip(op03_simple8b.read_summary(spark, str(tmp_path / "ids")).orderBy("doc_id", "start").collect(), sorted(texts([*ODD, ODD[7]])), strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    op03_simple8b.write_ids(empty_docs, P.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert op03_simple8b.read_summary(spark, str(tmp_path / "none")).count() == 0


def test_url_trust(spark):
    link = '<a class="x" href="https://%s/p">y</a>'
    pages = [(1, "https://Good.com/a?b", ""), (2, "http://x.example.com/en/1", ""), (3, "http://www.example.com/en/1", ""), (4, None, None), (5, "no scheme", ""), (6, "http://a.net/fr/", ""), (7, "http://b.org/x", link % "A.net" * 3), (8, "http://c.org/y", link % "good.com"), (9, "http://b.org?q", ""), (10, "http://a.net/en/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_pages(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, verdict int")).collect()}
    assert got[1] == ("good.com", "/a", "com/", "allow") and got[2] == ("x.example.com", "/en/1", "example.com/en/", "block")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4] == ("", "", None, "allow") and got[5] == got[4]
    assert got[6][2:] == ("net/fr/", "block") and got[9] == ("b.org", "", None, got[7][3])
    assert got[10][3] == "block" and got[8][3] == "allow"  # half of a.net's pages are blocked
    assert judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_dedup(rows):
    seen, out = {}, {}
    for i, t in sorted(dict(rows).items()):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    r = random.Random(4)
    rows = prose(4, 60, lengths=(5, 20, 60))
    for k in range(80):  # copies with edits, and shared passages
        a, b = r.choice(rows)[1], r.choice(rows)[1]
        x = r.randrange(len(a))
        rows.append((1000 + k, r.choice([a, a[:x] + "!" + a[x + 1 :], b[: len(b) // 2] + a[x:], "ab" * 70 + a[:70], "漢字" * 30 + b])))
    rows += [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 200), (5, "x" * 49)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ranges string")
    out = op05_suffix.cut_texts(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", op05_suffix._digest)
    assert {x[0]: tuple(x[1:]) for x in out.collect()} == brute_dedup(rows)
    assert op05_suffix.marked(docs.limit(0)).count() == 0
    big, text = 2**60, "shared passage " * 6
    odd = spark.createDataFrame([(None, text), (big + 1, "a" + text), (big + 3, "b" + text), (None, text)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_removed) for x in op05_suffix.cut_texts(odd, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", op05_suffix._digest).collect())
    assert got == [(0, 0), (0, 0), (big + 1, 0), (big + 3, 90)]


def test_quality(spark, odd_docs, empty_docs):
    good, bad = prose(1, 150), [(1000 + i, re.sub(" ", "### ", t) + "###") for i, t in prose(2, 150)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = op06_quality.fit(docs, labels)
    held = [(i, q) for i, q in [*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad)] if zlib.crc32(str(i).encode()) % 4 == 2]
    score = {r.doc_id: r.score for r in op06_quality.scored(docs, model).collect()}
    assert np.mean([(score[i] >= 0.7) == q for i, q in held]) > 0.95
    odd = op06_quality.scored(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd) and odd[7].score == odd[8].score
    assert op06_quality.scored(empty_docs, model).count() == 0
    assert op06_quality.kept(odd_docs, labels.limit(0)).count() == 10
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in chosen(labels, "quality", 1000))


def test_attention_gradients():
    r = np.random.default_rng(2)
    x, first, y = r.normal(size=(9, op06_quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    m = op06_quality.Attention()
    loss = lambda: -(y * np.log(m.forward(x, first)["s"]) + (1 - y) * np.log(1 - m.forward(x, first)["s"])).sum()
    f = m.forward(x, first)
    for k, g in m.gradients(f, first, f["s"] - y).items():
        at = tuple(r.integers(0, n) for n in g.shape)
        m.p[k][at] += 1e-6
        up = loss()
        m.p[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-4
        m.p[k][at] += 1e-6


def brute_winnow(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[x]
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit))
    return out


def test_winnow(spark):
    r = random.Random(6)
    items = [(i, t) for i, t in prose(7, 12, words=60, lengths=(12, 30))] + [(1, "w1 W2, w3"), (2, None), (3, ""), (4, "É w5"), (5, "w1 w2 w3")]
    docs = prose(8, 40, words=60, lengths=(5, 40, 90))
    for k in range(30):
        t, d = r.choice(items[:12])[1].split(), r.choice(docs)[1].split()
        a = r.randrange(len(t) - 9)
        docs.append((500 + k, " ".join(d[:7] + t[a : a + r.choice([8, 9, 10, 11, 25])] + d[7:]).upper() if k % 2 else "; ".join(t)))
    docs += [(0, None), (1, ""), (2, "w1 w2 w3"), (3, "é w5"), (4, "É W5")]
    frame = spark.createDataFrame([(i, t, 1, 1) for i, t in docs] * 2, "doc_id long, text string, grams int, words int")
    got = op07_winnow.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == brute_winnow(docs, items)
    nameless = op07_winnow.decontaminate(spark.createDataFrame([(1, "a w1 w2 w3 b")], "doc_id long, text string"), spark.createDataFrame([(None, "w1 w2 w3"), (7, "b")], "item_id long, text string")).first()
    assert (nameless.n_hit, nameless.n_items, nameless.items_sha256) == (4, 1, hashlib.sha256(b"7").hexdigest())
    none = op07_winnow.decontaminate(frame, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(docs) and not any(x.contaminated for x in none)
    assert op07_winnow.decontaminate(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_language(spark, odd_docs, empty_docs):
    en = [(i, "the cat and the dog in the house " * 3, "en") for i in range(100, 160)]
    de = [(i, "die katze und der hund in dem haus " * 3, "de") for i in range(200, 260)]
    docs = spark.createDataFrame(en + de, "doc_id long, text string, lang string")
    model = op08_language.fit(docs)
    assert all(r.lang_pred == ("en" if r.doc_id < 200 else "de") for r in op08_language.labelled(docs, model).collect())
    got = {r.doc_id: r for r in op08_language.labelled(odd_docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[6].lang_pred == "en"
    assert op08_language.labelled(empty_docs, model).count() == 0
    assert {r.lang_pred for r in op08_language.labelled(odd_docs, op08_language.fit(docs.limit(0))).collect()} == {"und"}


def test_piece_bpe(odd_docs, empty_docs):
    path, pattern = op09_piece_bpe.default_vocabulary()
    got = {r.doc_id: r for r in op09_piece_bpe.digests(odd_docs, path, pattern).collect()}
    for i, t in texts(ODD):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and "".join(splitter(pattern)(t)) == t
    assert {r.decoded.decode() for r in op09_piece_bpe.encode_ids(odd_docs, path, pattern).collect()} == {t for _, t in texts(ODD)}
    assert op09_piece_bpe.digests(empty_docs, path, pattern).count() == 0


def test_chat(spark):
    turns = [(1, 1, "assistant", "<|end|> [/INST] é"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", "\n x"), (2, 0, None, "hi"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "word " * 300_000), (3, 1, "assistant", "end")]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in op10_chat.formatted(rows, P.path("byte_bpe_50k.json")).collect()}
    for key in (1, 2, 3, None):
        own = sorted(((n, r or "", t or "") for c, n, r, t in turns if c == key))
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        x = got[key]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert op10_chat.formatted(rows.limit(0), P.path("byte_bpe_50k.json")).count() == 0
