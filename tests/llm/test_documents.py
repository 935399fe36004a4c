from __future__ import annotations

import hashlib
import time
import random
import math
import struct
import re
import zlib

import numpy as np
import pytest

from symloom.llm import fingerprint, langid, media, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---- personal data ---------------------------------------------------------


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str):
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in p.finditer(text) if ok(m[0])]


CASES = [
    None, "", "a@b.c_d@e.f 😀 1.2.3.4.5.6.7.8 x@y", "4111 1111 1111 1111 é 4111-1111-1111-1111-4111 +1 (222) 333-4444 x 5  4111111111111111",
    "+1-2 +49 30 1234567.. 300.1.1.1 001.002.003.255 a.b@c-d.e.f..g 1.1.1.1", "@@ a@ .@b.c +@x.y 😀😀 z@q.r.s@t.u", "12 34 56 78 90 12 34 5",
    "1-2 4111111111111111-", "x" * 5000 + "1" * 5000 + ".1" * 5000, "+123456789 +1234567890123456 1.2.3", "a@b.c" * 50,
]


def test_base_spans_equal_the_patterns(spark):
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")).collect()}
    for i, text in enumerate(CASES):
        want = base_spans(text or "")
        r = rows[i]
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == {k: sum(x[0] == k for x in want) for k in pii.KINDS}
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please write to mail address user{i}@host{i}.org today") for i in range(8)]
    rows += [(20, "please write to mail address agent007-x9 today"), (21, "room number 12345678 upstairs"), (22, None)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[8][1].index("agent007")
    assert got[20] == f"id:{start}:{start + len('agent007-x9')}"
    assert got[21] == "" and got[22] == ""


SEEDS = {
    "phone": "+1 (743) 555-38{:02}",
    "card": "4111 1111 1111 1111",
    "email": "john.smith@example{}.com",
}


@pytest.mark.parametrize("kind", sorted(SEEDS))
def test_entities_of_any_form_are_seeds(spark, kind):
    names = ["alpha", "bravo", "charlie", "delta"]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"]
    seed = [cards[i] if kind == "card" else SEEDS[kind].format(names[i] if kind == "email" else i) for i in range(4)]
    rows = [(i, f"please ask {seed[i]} about it") for i in range(4)]
    rows += [(20, "please ask agent007-x9 about it"), (21, "please ask " + "k" * 200 + "7 about it")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i][f"n_{kind}"] == 1 for i in range(4))
    assert got[20].spans == "id:11:22" and got[21].spans == "id:11:212"


def test_context_is_read_from_the_text(spark):
    rows = [(i, f"see room 1234567 a{i}.b@c.org now") for i in range(4)] + [(9, "see room 1234567 agent007-x9 now")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == "id:17:28"


def test_redaction_keeps_columns_and_clean_texts(docs, texts, no_docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert got == sorted((i or -1, t or "") for i, t in texts)
    assert pii.redact(no_docs).count() == 0


def test_redaction_replaces_spans(spark):
    rows = [(1, "to é a@b.co, 1.2.3.4."), (2, "4111111111111111")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "to é [EMAIL], [IP].", 2: "[CARD]"}


def test_redaction_over_parts_and_clashing_names(spark):
    rng, rows = random.Random(4), []
    for i in range(6):
        words = [rng.choice(["é😀x", "word", "a@b.co", "+1 743 555 3824", "1.2.3.4", "\n", "x" * 700]) for _ in range(rng.choice([3, 400]))]
        rows.append((i, " ".join(words), "mine", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pii_email string, `__pii_a.b` long")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    got = {r[0]: r for r in pii.redact(docs).collect()}
    for i, text, *rest in rows:
        out, at = [], 0
        for k, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)), key=lambda x: x[1:]):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert list(got[i]) == [i, "".join(out) + text[at:], *rest]


@pytest.mark.parametrize("unit", ["tok3n-{0} ", "u{0}@h.co,", "a1b2c3d4{0}"])
def test_texts_of_very_many_spans(spark, unit):
    text = "".join(unit.format(i) for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.report(docs).collect()
    (new,) = pii.redact(docs).collect()
    assert row.n_email == (50_000 if "@" in unit else 0)
    assert new.text == (text if "@" not in unit else "[EMAIL]," * 50_000)
    assert time.time() - began < 60


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(8)
    edges = {(f"p{rng.randrange(12)}", rng.randrange(60)) for _ in range(150)}
    seeds = set(rng.sample(range(60), 15))
    rows = [(p, i, i in seeds) for p, i in edges for _ in range(rng.randrange(1, 3))]
    got = {(r.pattern, r.instance) for r in pii.bootstrap(spark.createDataFrame(rows, "pattern string, instance long, seed boolean"), 3, 2, 0.4).collect()}
    sure = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        score = {}
        for p in {p for p, _ in edges}:
            own = [sure[i] for q, i in edges if q == p]
            if sum(x >= 0.4 for x in own) >= 2:
                score[p] = sum(own) / len(own)
        sure = {i: 1.0 if i in seeds else 1 - math.prod(1 - score[p] for p, j in edges if j == i and p in score) for i in sure}
    assert got == {(p, i) for p, i in edges if i not in seeds and sure[i] >= 0.4 and score.get(p, 0) >= 0.2}
    assert got


# ---- language --------------------------------------------------------------


def test_language_is_learnt_and_null_texts_are_und(spark, no_docs):
    en, de = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune Fuchs springt über den faulen Hund und läuft"
    rows = [(i, (en if i % 2 else de)[i % 7 :], "en" if i % 2 else "de") for i in range(60)] + [(90, None, "en"), (91, "123 ...", "de"), (92, "the dog runs", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs.filter(~langid.held_out()))).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(60))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert (got[90].lang_pred, got[91].lang_pred, got[92].lang_pred) == ("und", "und", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.count() == 61
    assert langid.predict(no_docs, langid.fit(docs)).count() == 0


def test_every_label_is_learnt(spark):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i % 23)}{chr(97 + i % 19)}" for i in range(150)]
    rows = [(1000 * k + i, " ".join([w] * (5 + k)), f"l{i:03}") for i, w in enumerate(words) for k in range(1 if i % 2 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    whole = langid.fit(docs, block_langs=1000)
    assert len(whole.langs) == 150 and len(model.parts) == 3
    assert all(abs(got[i].score - s) < 1e-9 for (i, _, _), (_, s) in zip(rows, whole.predict([t for _, t, _ in rows]), strict=True))
    assert langid.keep_identified(docs, model, 0.0).count() == len(rows)


def test_score_equals_plain_naive_bayes():
    model = langid.Model(["a", "b"], np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)), np.log([0.5, 0.5]))
    assert model.predict(["hello"])[0] == ("a", 0.5)
    bucket, owner = langid.features(["ab cd", "", "xyz"])
    assert len(bucket) == (4 + 3 + 2) + (2 + 1) and set(owner) == {0, 2}


# ---- audio -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 64, 1417, 1418, 50_000])
def test_payload_round_trip(n):
    raw = bytes(i * 7 % 256 for i in range(n))
    data = media.wrap(media.pad(raw), n)
    s = media.parse(data)
    assert media.unwrap(data) == (media.pad(raw), n)
    assert s.table["crc_ok"] and s.table["frames"] == len(s.offsets) == s.crc_good and not s.crc_bad and not s.skipped
    assert s.duration() == (1152 * len(s.offsets), 32000)


def test_resynchronises_after_damage():
    data = media.wrap(media.pad(b"x" * 9000), 9000)
    s = media.parse(data[:700] + b"junk\xff\xfb" + data[700:])
    assert s.skipped == 6 and len(s.offsets) == 7
    bad = bytearray(data)
    bad[media.parse(data).offsets[2] + 8] ^= 1  # in the side information
    assert media.parse(bytes(bad)).crc_bad == 1


def test_plain_frames_and_tags():
    frame = b"\xff\xfb\x90\x00" + bytes(413)  # 128 kbit/s, 44.1 kHz
    s = media.parse(b"ID3\x03\0\0\0\0\0\x0a" + bytes(10) + frame * 3 + b"TAG" + bytes(125))
    assert (len(s.offsets), s.duration(), s.crc_none, s.offsets[0]) == (3, (3456, 44100), 3, 20)


def test_variable_bitrate_seek_table():
    frame = bytearray(b"\xff\xfb\x90\x00" + bytes(413))
    frame[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 417 * 7, 6, 3, 1, 2, 2)
    frame[62:68] = struct.pack(">3H", 834, 834, 834)
    s = media.parse(bytes(frame) + (b"\xff\xfb\x90\x00" + bytes(413)) * 6)
    assert (s.table["kind"], s.table["frames"], s.table["every"], s.table["seek"]) == ("VBRI", 6, 2, [834, 1668, 2502])
    assert [s.offsets[i] for i in (2, 4)] == [417 + x for x in s.table["seek"][:2]]


def test_stored_streams(docs, texts, no_docs):
    rows = {r.doc_id: r for r in media.report(media.media(docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        assert (rows[i].n_bytes, rows[i].payload_sha256) == (len(raw), hashlib.sha256(media.pad(raw)).hexdigest())
        data = media.wrap(media.pad(raw), len(raw))
        assert (rows[i].payload_bytes, rows[i].tail_crc32) == (len(media.pad(raw)), zlib.crc32(media.pad(raw)[-64:]))
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert all(data[at] == 255 for at in rows[i].offsets) and rows[i].samples == 1152 * rows[i].frames == 1152 * len(rows[i].offsets)
    assert rows[0].media_sha256 == rows[50].media_sha256 and rows[0].feature == rows[50].feature
    assert media.features(media.media(docs)).filter("crc_bad > 0 or skipped > 0").count() == 0
    assert media.features(media.media(no_docs)).count() == 0


# ---- digests ---------------------------------------------------------------


def test_entropies_equal_their_definition():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 20, 70_000).astype(np.uint8)
    e = fingerprint.entropies(b)
    for i in (0, 1, 65_530, 65_600, len(e) - 1):
        c = np.bincount(b[i : i + 64])
        p = c[c > 0] / 64
        assert abs(e[i] + (p * np.log2(p)).sum() * fingerprint.LEVELS / 6) < 1.01
    assert len(fingerprint.entropies(b[:63])) == 0


def test_digests_follow_the_order_of_ids(docs, texts, no_docs):
    rows = fingerprint.compare_with_edits(docs).collect()
    assert len(rows) == len(texts)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted(hashlib.sha256(fingerprint.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in rows) == want
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[50].fingerprint == by[51].fingerprint
    assert by[50].near_next == 1.0 and by[56].near_edited > 0.5
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert fingerprint.compare_with_edits(no_docs).count() == 0


def test_written_digest_reads_back():
    rank = np.arange(fingerprint.LEVELS)
    d = fingerprint.digest("some text " * 900, rank)
    assert (fingerprint.read(fingerprint.written(d)) == d).all() and fingerprint.likeness(d, d) == 1.0
    assert fingerprint.likeness(d, fingerprint.digest("", rank)) == 0.0


def test_windows_of_short_texts_are_looked_at_together(monkeypatch):
    texts = [b"", b"a" * 63, b"ab" * 40, bytes(range(256)) * 3, b"x" * 64] * 20 + [bytes(range(200)) * 30]
    alone, calls = fingerprint.entropies, []
    monkeypatch.setattr(fingerprint, "entropies", lambda b: calls.append(len(b)) or alone(b))
    monkeypatch.setattr(fingerprint, "TOGETHER", 5000)
    found = fingerprint.entropies_of(texts)
    assert len(calls) < len(texts) / 4 and sum(calls) == sum(map(len, texts))
    for text, e in zip(texts, found, strict=True):
        assert (e == alone(np.frombuffer(text, np.uint8))).all() and len(e) == max(0, len(text) - fingerprint.W + 1)
