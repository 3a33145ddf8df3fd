import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import langid, media, pieces, tokens

DOCS = "doc_id long, text string, lang string, score string, edits_ string"
EN = "the cat and the dog are here with all of them "
FR = "le chat et la souris sont dans une maison pour "


def test_language(spark):
    rows = [(i, (EN if i % 2 else FR) * (1 + i % 5), "en" if i % 2 else "fr", None, None) for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", "fr", None, None), (102, "123 ... 4", None, None, None), (103, EN * 3000, None, None, None), (104, EN, None, None, None), (104, EN, None, None, None)]
    out = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] < 60:
            assert r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") and not r["rejected"]
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "en"]
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "word", None, None, None)], DOCS)).collect()} == {"und"}


def test_language_does_not_hang_on_ids(spark):
    """Ids that are all null, or one id or one whole row for a third of the rows, leave no language out and the sample bounded."""
    own = {"aa": "the quick brown fox jumps over hedges", "bb": "der schnelle braune fuchs springt hoch", "cc": "zwykly lis skacze przez plot wysoki"}
    rng = np.random.default_rng(1)
    words = lambda lang: " ".join(rng.choice(own[lang].split(), 12))
    for ids in ([None] * 900, [1] * 900, [1] * 300 + list(range(2, 602))):
        rows = [(i, words(lang), lang, None, None) for i, lang in zip(ids, ["aa"] * 300 + ["bb"] * 300 + ["cc"] * 300)]
        rows += [(7, "hop hop hop", "dd", None, None)] * 400
        docs = spark.createDataFrame(rows, DOCS)
        model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"), per_lang=50)
        assert set(model.langs) == {"aa", "bb", "cc", "dd"}
        out = langid.predict(docs, model)
        assert out.filter("lang = lang_pred").count() > 0.95 * out.count()


def test_wav(spark, tmp_path):
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "y" * 20000, "a"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in media.write_wav(docs, str(tmp_path / "wav")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        pay = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = rows[i]
        assert media.from_wav(bytes(r["media"])) == pay and r["payload_sha256"] == hashlib.sha256(pay).hexdigest() and r["tail_crc32"] == zlib.crc32(pay[-32:])
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(pay), len(r["media"]))
    assert rows[2]["fingerprint"] == rows[7]["fingerprint"]
    assert media.wav_columns(docs.filter("doc_id < 0")).count() == 0


def test_fingerprint_finds_a_tone():
    t = np.arange(9600)
    sound = np.round(128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).tobytes()
    codes = media.fingerprint(sound)
    assert ((codes >> 22) & 1023 == 20).mean() > 0.2 and (np.diff(codes) >= 0).all()


def plain_fingerprint(samples):
    """Every frame by a plain Fourier sum, its peaks by sorting, all pairs by loops."""
    n, k = media.FRAME, np.arange(media.FRAME // 2 + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n), k) / n)
    peaks = []
    for a in range(0, len(samples) - n + 1, media.HOP):
        power = np.round(np.abs(((np.frombuffer(samples[a : a + n], np.uint8) - 128.0) * window) @ turn), 2)
        tops = [f for f in k[1:-1] if power[f - 1] <= power[f] > power[f + 1]]
        peaks.append(sorted(tops, key=lambda f: (-power[f], f))[: media.PEAKS])
    codes = [(t << 32) | (int(f) << 22) | (int(g) << 12) | dt for t, fs in enumerate(peaks) for dt in range(1, media.AHEAD + 1) if t + dt < len(peaks) for f in fs for g in peaks[t + dt]]
    return sorted(codes)


def test_fingerprints_are_brute_force():
    rng = np.random.default_rng(5)
    t = np.arange(4000)
    tones = np.round(128 + 40 * np.sin(2 * np.pi * 9 * t / media.FRAME) + 40 * np.sin(2 * np.pi * 31 * t / media.FRAME + 1)).astype(np.uint8)
    for sound in (rng.integers(0, 256, 6000, np.uint8), tones, rng.integers(97, 123, media.UNIT, np.uint8)):
        assert media.fingerprint(sound.tobytes()).tolist() == plain_fingerprint(sound.tobytes())


def test_silence_has_no_peaks():
    assert (media._peaks(np.full(media.FRAME, 128, np.uint8)) == -1).all()


def test_long_sounds_are_cut_into_blocks_without_a_seam(monkeypatch):
    sound = np.random.default_rng(6).integers(0, 256, media.FRAMES * media.HOP + 50_000, np.uint8).tobytes()
    whole = media.fingerprint(sound)
    assert whole.max() >> 32 > media.FRAMES
    monkeypatch.setattr(media, "FRAMES", 1 << 20)
    assert (media.fingerprint(sound) == whole).all()


def test_media_names_that_clash(spark):
    rows = [(1, "Some text. " * 30000, "x", "x", "x"), (1, None, "x", None, "x"), (None, "", None, "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string, media string, fingerprint string")
    out = {(r["doc_id"], r["n_bytes"]): r for r in media.wav_columns(docs, keep_media=True).collect()}
    assert set(out) == {(1, 330_000), (1, 0), (None, 0)} and out[1, 0]["media_sha256"] == out[None, 0]["media_sha256"]
    assert media.wav_columns(docs.limit(0)).count() == 0


def test_language_vectors_are_brute_force(spark):
    """Counts by loops over letters, inverse frequencies over all rows, the nearest centroid by plain cosines."""
    texts = ["Ab ab, ba!", "", "1 2", "héé Hé", "abc abd " * 40]
    for text, got in zip(texts, langid.ngram_counts(texts)):
        letters = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in (" " + text.lower() + " ").encode())
        while b"  " in letters:
            letters = letters.replace(b"  ", b" ")
        want = np.zeros(langid.DIMS)
        for n in (2, 3):
            for i in range(len(letters) - n + 1):
                gram = sum(letters[i + j] << (8 * j) for j in range(n)) + (n << 24)
                want[(gram * 2654435761) % 2**32 >> (32 - langid.BITS)] += 1
        assert (got == want).all(), text
    rows = [(i, (EN if i % 2 else FR)[i % 7 :] * (1 + i % 3), "en" if i % 2 else "fr", None, None) for i in range(40)] + [(99, "zq " * 50, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    counts = langid.ngram_counts([r[1] for r in rows]).astype(float)
    df = (counts[:40] > 0).sum(axis=0)
    idf = np.log(41 / (1 + df)) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    v = np.log1p(counts) * idf
    cos = v / np.linalg.norm(v, axis=1, keepdims=True) @ model.centroids.T
    for r, c in zip(sorted(langid.predict(docs, model).collect(), key=lambda r: r["doc_id"]), cos):
        assert r["lang_pred"] == model.langs[int(c.argmax())] and abs(r["score"] - max(0, c.max())) < 1e-4
        assert r["rejected"] == (c.max() < model.floors[int(c.argmax())])


def test_centroids_are_the_means_of_their_members():
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(m, 0.1, (30, 5)) for m in ([1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 1, 0])]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = langid._cluster(v, 3, 8)
    own = (v @ c.T).argmax(axis=1)
    assert len(set(own[:30])) == len(set(own[30:60])) == len(set(own[60:])) == 1 and len(set(own)) == 3
    for j in range(3):
        mean = v[own == j].sum(axis=0)
        assert np.allclose(c[j], mean / np.linalg.norm(mean), atol=1e-5)


def test_token_edge_cases(spark):
    """No rows, names that clash, nulls in every column, repeated rows."""
    schema = "id long, text string, n_tokens string, tree string, n_edits string, n_encoded string"
    rows = [(1, "call 1234567890", "x", None, "x", "x"), (1, "call 1234567890", "x", None, "x", "x"), (None, "a.b@c.de", None, None, None, None), (2, None, "x", "x", "x", "x")]
    edited = tokens.personal_data_edits(spark.createDataFrame(rows, schema).select("id", "text"))
    assert sorted((len(r["edits"]) for r in edited.collect())) == [0, 1, 1, 1]
    out = sorted((str(r["id"]), r["n_edits"]) for r in tokens.count_edited(edited).collect())
    assert out == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    none = spark.createDataFrame([], schema)
    assert tokens.count_edited(tokens.personal_data_edits(none.select("id", "text"))).count() == 0 and tokens.build_trees(none).count() == 0
    nothing = edited.withColumn("edits", F.lit(None).cast(edited.schema["edits"].dataType)).withColumns({c: F.lit("x") for c in ("n_tokens", "tree", "n_edits_after")})
    assert {(r["n_edits"], r["n_tokens"] == r["n_tokens_after"]) for r in tokens.count_edited(nothing).collect()} == {(0, True)}


def test_a_long_unbroken_text_comes_back_whole(spark):
    rows = [(1, "x" * 60_000, "x"), (2, "é" * 5_000 + "🙂" * 300, "x"), (3, "".join(chr(0x4E00 + i % 5000) for i in range(12_000)), "x")]
    out = pieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), decode_too=True)
    assert out.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and out.count() == 3


def test_token_trees_match_recounts(spark):
    counter = tokens.Counter(tokens.VOCABULARY)
    full = lambda t: sum(counter.counts(counter.split.findall(t)))
    rng = random.Random(4)
    bits = ["the", " cat", "'s", "  ", "\n\n", "9", "1234", "é", "!?", " I", "'", "re", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))
        tree = tokens.Tree.from_bytes(tokens.build(text, counter).to_bytes())
        assert tree.tokens == full(text)
        at = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        edits = [(a, b - a if rng.random() < 0.3 else min(b - a, 2), rng.choice(["", "'s", " x", "re", "\n", "é"])) for a, b in zip(at[::2], at[1::2])]
        new, _ = tokens.apply_edits(text, tree, edits, counter)
        assert tree.tokens == full(new)
    docs = spark.createDataFrame([(1, "mail a.b@c.de or 10.0.0.1, call 1234567890 " + "word " * 5000), (2, None), (3, ""), (3, "x")], "id long, text string")
    rows = {(r["id"], r["n_edits"]): r for r in tokens.count_edited(tokens.personal_data_edits(docs)).collect()}
    one = rows[1, 3]
    assert one["n_tokens_after"] == full("mail <mail> or <address>, call <number> " + "word " * 5000) and one["n_encoded"] < 1000
    state = tokens.build_trees(docs.filter("id = 1")).join(tokens.personal_data_edits(docs), "id")
    assert tokens.update_trees(state).first()["n_tokens"] == one["n_tokens_after"]


def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    p = pieces.load_pieces()
    encoder, table = pieces.Encoder(p), pieces.piece_table(p)
    rng = random.Random(3)
    some = [t for t in p.text if t and t.isascii()]
    texts = ["", " ", "   a", "a    b\n\n  c", "é🙂x", "<s> <0x0A>", "0" * 50, "-" * 90, " " * 70 + "x", "你好 世界"]
    texts += [b"".join(rng.choice(some) for _ in range(rng.randint(1, 8))).decode() for _ in range(1500)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == sp.encode(t) and pieces.decode(ids, p, table).decode() == t
    literal = "a▁b ▁"
    assert pieces.decode(encoder.encode([literal])[0], p, table).decode() == literal
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world " * 3000, "x"), (3, "Hi", "x")], "doc_id long, text string, ids string")
    out = pieces.decode_ids(pieces.encode_texts(docs))
    assert out.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and out.count() == 4


def test_unigram_viterbi_is_the_best_sum():
    names = ["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab"]
    score = np.array([-2.0, -2.5, -2.5, -3.0, -3.1, -4.0, -4.2, -6.0])
    p = pieces.load_pieces()
    up, _ = pieces._powers(64)
    points = [np.array([ord(c) for c in n]) for n in names]
    raw = np.array([(pieces.code_of(x) * up[: len(x)]).sum() for x in points], np.uint64)
    length = np.array([len(n) for n in names])
    keys = pieces._hash(raw, length)
    at = np.argsort(keys)
    p.keys, p.ids, p.raw, p.length, p.score, p.usable, p.unigram, p.longest = keys[at], np.arange(len(names))[at], raw, length, score, np.ones(len(names), bool), True, 3
    p.maybe = np.ones(1 << 20, bool)
    word = "▁ababba"
    ids, _ = pieces.Encoder(p).words(np.array([[ord(c) for c in word]]))

    def best(s):
        return max([(score[i] + best(s[len(n) :])[0], [i, *best(s[len(n) :])[1]]) for i, n in enumerate(names) if s.startswith(n)], default=(-np.inf, [])) if s else (0.0, [])

    assert ids[0][ids[0] >= 0][::-1].tolist() == best(word)[1]


@pytest.mark.parametrize("n", [0, 1, 130])
def test_blocks_keep_all(n):
    assert [t for _, b in langid.in_blocks(["x" * 9] * n, 50, 7) for t in b] == ["x" * 9] * n
