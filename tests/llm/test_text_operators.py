"""Row-wise operators: token counts, audio, language, personal data, toxicity."""

import hashlib
import math
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from stipule.llm import common, langid, media, pii, tokencount, toxicity

# Token counts ----------------------------------------------------------------


def plain_count(word, lex):
    """Best segmentation by recursion over all splits, without sharing anything."""
    marked = tokencount.MARK + word
    best = [(0, 0)]
    for end in range(1, len(marked) + 1):
        options = []
        for start in range(end):
            piece = marked[start:end]
            s, n = best[start]
            if piece in lex.scores:
                options.append((s + lex.scores[piece], n - 1))
            elif end - start == 1:
                size = len(piece.encode())
                options.append((s + size * lex.byte_score, n - size))
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_match_plain_segmentation():
    lex = tokencount.load()
    counter = tokencount.Counter(lex)
    words = ["the", "then", "thenx", "there", "a", "€uro", "日本語テキスト", "ththblestion", "x" * 300, "\u0001", "foo_bar.baz(1)"]
    assert {w: counter.count([w]) for w in words} == {w: plain_count(w, lex) for w in words}
    assert len(counter.best) < sum(map(len, words)) and plain_count("the", lex) == 1
    again = tokencount.Counter(lex)
    for w in reversed(words):
        again.count([w])
    assert again.terminal == counter.terminal and "x" * 300 not in again.terminal
    assert counter.count(["x" * 300, "the", "x" * 300]) == 2 * plain_count("x" * 300, lex) + 1
    # Long pre-tokens leave nothing behind.
    for k in range(50):
        again.count([f"{k:02d}" * 200])
    assert len(again.terminal) == len(words) - 1


def test_token_counts_against_a_library():
    tokenizers = pytest.importorskip("tokenizers")
    lex = tokencount.load()
    model = tokenizers.models.Unigram([("<unk>", -100.0)] + [(p, s / tokencount.SCALE) for p, s in lex.scores.items()], 0, False)
    counter = tokencount.Counter(lex)
    words = ["hello", "internationalization", "thinking", "unwhershtion", "de", "queletion"]
    counter.add(words)
    assert [counter.terminal[w] for w in words] == [len(model.tokenize(tokencount.MARK + w)) for w in words]


def test_token_counts_of_odd_rows(odd, empty):
    lex = tokencount.lexicon(["▁", "the", "o", "n", "e", "▁one"])
    rows = sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(odd, lex).collect())
    got = dict((r[0], r[1:]) for r in rows)
    assert got[8] == (1, 1) and got[3] == got[4] == got[2] == (0, 0) and got[5][0] == 40_001 and len(rows) == 13
    assert tokencount.token_counts(empty, lex).count() == 0


def test_small_tries_give_the_same_counts(docs, monkeypatch):
    lex = tokencount.load()
    want = tokencount.token_counts(docs, lex).toPandas()
    a = tokencount.Counter(lex, nodes=50)
    for text, n in zip(docs.toPandas().sort_values("doc_id").text, want.sort_values("doc_id").n_tokens, strict=True):
        assert a.count(text.split()) == n


# Audio -----------------------------------------------------------------------


def test_companding_tables():
    assert media.MULAW_PCM[0] == -32124 and media.MULAW_PCM[255] == 0 and media.MULAW_PCM[127] == 0 and media.MULAW_PCM[128] == 32124
    assert media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x2A] == -32256 and media.ALAW_PCM[0xAA] == 32256
    for t in (media.MULAW_PCM, media.ALAW_PCM):
        assert sorted(np.unique(-t.astype(int))) == sorted(np.unique(t.astype(int)))


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            d = step >> 3
            if n & 1:
                d += step >> 2
            if n & 2:
                d += step >> 1
            if n & 4:
                d += step
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(media.IMA_INDEX[n & 7])))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 40), dtype=np.uint8)
    assert media.adpcm_blocks(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]
    audio = media.read_wav(media.wav(blocks.tobytes(), "adpcm", block=40))
    assert (audio.codec, audio.block) == ("adpcm", 40) and media.decode(audio).tolist() == sum((plain_adpcm(bytes(b)) for b in blocks), [])


def test_wav_round_trips_and_resampling():
    data = bytes(range(256)) * 3
    for codec in ("mulaw", "alaw", "pcm"):
        audio = media.read_wav(media.wav(data, codec))
        assert (audio.codec, audio.rate, audio.data) == (codec, 8000, data)
    pcm = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert media.doubled(pcm).tolist() == media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768, -32768]
    assert len(media.resample(pcm, 16000, 8000)) == 2 and len(media.resample(pcm[:0], 8000, 16000)) == 0
    with pytest.raises(ValueError):
        media.read_wav(b"not audio")


def test_audio_columns(odd, empty):
    rows = media.audio_column(odd).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == 13
    for r in rows:
        stored = media.read_wav(bytes(r.media)).data
        text = stored[: r.n_bytes].decode()
        assert (r.doc_id, text) in texts or (text == "" and (r.doc_id, None) in texts)
        assert r.payload_bytes == len(stored) and r.payload_bytes % 576 == 0 < r.payload_bytes and set(stored[r.n_bytes :]) <= {255}
        assert r.payload_sha256 == hashlib.sha256(stored).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(stored[-32:]) and r.media_bytes == len(r.media)
        pcm = media.read_wav(bytes(r.pcm))
        assert pcm.rate == 16000 and len(pcm.data) == 4 * len(stored)
    assert media.audio_column(empty).count() == 0
    same = {r.media_sha256: r.feature for r in rows}
    assert all(same[r.media_sha256] == r.feature for r in rows)


def plain_stats(samples):
    signs = [x < 0 for x in samples]
    return f"{len(samples)}/{max(map(abs, samples), default=0)}/{sum(map(abs, samples))}/{sum(a != b for a, b in zip(signs, signs[1:]))}"


def plain_mulaw(code):
    code = 255 - code
    size = (((code % 16) * 2 + 33) << (code // 16 % 8)) - 33
    return -4 * size if code >= 128 else 4 * size


def plain_alaw(code):
    code ^= 0x55
    level, part = code // 16 % 8, code % 16
    size = 2 * part + 1 if level == 0 else (2 * part + 33) << (level - 1)
    return 8 * size if code >= 128 else -8 * size


def test_features_against_samples_one_by_one():
    for text in (b"", b"some text", bytes(range(256)) * 5):
        data = media.padded(text)
        wide = [plain_mulaw(c) for c in data]
        doubled = [x for a, b in zip(wide, [*wide[1:], wide[-1]]) for x in (a, (a + b) // 2)]
        crc = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in doubled))
        blocks = [[int(x) for x in plain_adpcm(data[k : k + 576])] for k in range(0, len(data), 576)]
        size = [abs(x) for b in blocks for x in b]
        want = f"mulaw={plain_stats(doubled)}|crc={crc}|alaw={plain_stats([plain_alaw(c) for c in data])}|adpcm={max(size)}/{sum(size)}"
        assert media._features([data]) == [want]  # noqa: SLF001


def test_stored_pcm_is_described(odd):
    for r in media.audio_column(odd).collect():
        assert r.pcm_bytes == len(r.pcm) and r.pcm_sha256 == hashlib.sha256(bytes(r.pcm)).hexdigest()
    assert {"pcm_bytes", "pcm_sha256"} <= set(media.DIGESTS)


# Language --------------------------------------------------------------------


def test_network_against_loops():
    rng = np.random.default_rng(3)
    tables = tuple(rng.normal(0, 1, (w, 256, langid.FILTERS)) for w in langid.WIDTHS)
    net = langid.Network(tables, rng.normal(0, 1, (3 * langid.FILTERS, 3)), rng.normal(0, 1, 3), ("a", "b"))
    rows = rng.integers(0, 256, (3, langid.WINDOW), dtype=np.uint8)

    def held(row):
        return [max(sum(tab[o][row[p + o]][f] for o in range(len(tab))) for p in range(len(row) - len(tab) + 1)) for tab in net.tables for f in range(langid.FILTERS)]

    top, _ = langid.responses(net, rows)
    assert np.allclose(top, [held(r) for r in rows])

    def loss():
        z = [[sum(max(h, 0) * net.dense[k, c] for k, h in enumerate(held(r))) + net.bias[c] for c in range(3)] for r in rows]
        return sum(math.log(sum(map(math.exp, zr))) - zr[y] for zr, y in zip(z, (0, 1, 2))) / 3

    grads = langid._gradient(net, rows, np.array([0, 1, 2]))  # noqa: SLF001
    for param, grad in zip([*net.tables, net.dense, net.bias], grads, strict=True):
        where = tuple(x[0] for x in np.nonzero(grad))
        now, step = param[where], 1e-6
        param[where] = now + step
        up = loss()
        param[where] = now - step
        assert abs((up - loss()) / (2 * step) - grad[where]) < 1e-4
        param[where] = now


def test_windows_come_from_the_whole_text_and_every_language_is_learned(spark, monkeypatch):
    drawn = [langid._drawn(bytes([65 + k % 26]) * 10 + bytes(range(256)) * 40) for k in range(200)]  # noqa: SLF001
    starts = {w[0] for d in drawn for w in d}
    assert len(starts) > 40 and all(len(w) == langid.WINDOW for d in drawn for w in d) and langid._drawn(b"") == [] and langid._drawn(b"abc") == [b"abc"]  # noqa: SLF001
    rows = [(k, f"text of language number {k % 60}", f"l{k % 60}") for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df).languages) == 60
    monkeypatch.setattr(langid, "SAMPLE", 59)
    with pytest.raises(ValueError, match="59"):
        langid.fit(df)


def test_folders_of_a_cluster_must_be_shared():
    unset = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_root(cluster)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_joins_are_joins(spark, monkeypatch, how):
    monkeypatch.setattr(common, "SPREAD", 5)
    many = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("x"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    plain = sorted(map(str, many.join(one, ["k"], how).collect()))
    assert sorted(map(str, common.spread_join(many, one, ["k"], ["x"], how=how).collect())) == plain
    assert sorted(map(str, common.spread_join(many, one.limit(0), ["k"], ["x"], how=how).collect())) == sorted(map(str, many.join(one.limit(0), ["k"], how).collect()))


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, per_language=100)
    got = langid.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert set(got.held_out) == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())


def test_folded_tables_compute_the_same_network():
    rng = np.random.default_rng(0)
    net = langid.train([b"the cat sat on the mat " * 5, b"le chat sur le tapis " * 5], ["en", "fr"])
    rows = rng.integers(0, 256, (33, langid.WINDOW), dtype=np.uint8)
    top, _ = langid.responses(net, rows)
    assert np.allclose(langid.Applied(net).logits(rows), np.maximum(top, 0) @ net.dense + net.bias, atol=1e-4)
    langs, scores = langid.Applied(net).predict(["the cat sat on the mat", None, "", "123", "le chat sur le tapis " * 2000])
    assert langs == ["en", "und", "und", "und", "fr"] and scores[1:4] == [0.0] * 3 and all(0 <= s <= 1 for s in scores)


def test_language_of_odd_rows(odd, empty):
    net = langid.fit(odd)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.predicted(odd, net).collect()}
    assert {(2, True), (3, True), (4, True), (9, True), (1, False), (8, False)} <= got
    kept = langid.accepted(odd, net)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 7, 7, 8, 10]
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predicted(odd, none).collect()} == {"und"} and langid.accepted(odd, none).count() == 0 and langid.predicted(empty, net).count() == 0


# Personal data ---------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    """The base rules, straight from their patterns."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


TRICKY = [
    "a@b.c", "a@b", "@b.c x@y.z", "a@b.c@d.e", "a.b+c@d-e.f.g.", "x@y..z a@@b.c", "éa@b.co", "1.2.3.4", "256.1.1.1 1.2.3.4.5 01.002.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "41111111111111111111111", "+49 (30) 1234-5678", "+1 23", "++44 20 7946 0958", "call +442079460958, or a@b.de", "", "a" * 2000 + "@", "1" * 5000, "user@host.com.4111111111111111 +4 5",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert [tuple(s)[:3] for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS] == plain_base(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(9)
    for alphabet in ("0123.", "12.. a", "0-9 +(", "a@b.-1", "4 -1", "@.a+19 -()x%"):
        for text in ("".join(rng.choice(list(alphabet), n)) for n in rng.integers(1, 60, 1500)):
            assert [tuple(s)[:3] for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS] == plain_base(text), text


@pytest.mark.parametrize("part", ["1", "1.", "1.1.1.", "+1 (", "a@", "a@b.", "4 ", "4111-", "A1", "DE89 ", "123-45-", "+1", "@1.", "1.2.3.4 "])
def test_long_texts_take_linear_time(part):
    text = part * (1_000_000 // len(part))
    began = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - began < 5  # a second or less on an idle machine; minutes if quadratic


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.pii_spans(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        base = plain_base(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.BASE_KINDS]


def test_added_kinds_and_context():
    text = "Bank account DE89 3704 0044 0532 0130 00, IBAN GB82WEST12345698765432, wrong GB83WEST12345698765432, ssn 123-45-6789, part 123-45-6789."
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789"), ("ssn", "123-45-6789")]
    assert pii.find_spans("serial 123-45-6789") == [] and pii.find_spans("123-45-6789") == []
    near, far = pii.find_spans("server login 10.0.0.1")[0], pii.find_spans("version 10.0.0.1")[0]
    assert near.score > pii.PRIOR["ip"] > far.score and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


def test_redaction(odd, empty):
    assert pii.redact("mail a@b.de, +49 30 123456 78") == "mail <EMAIL>, <PHONE>" and pii.redact(None) is None and pii.redact("a@1.2.3.4") == "<EMAIL>"
    out = pii.redacted(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect())) and pii.redacted(empty).count() == 0
    rows = pii.pii_spans(odd).collect()
    assert len(rows) == 13 and {r.base_sha256 for r in rows if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()} and pii.pii_spans(empty).count() == 0


# Toxicity --------------------------------------------------------------------


def sentences(n=400):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(n):
        words = [f"w{i}" for i in rng.integers(0, 40, 12)]
        bad = k % 4 == 0
        if bad:
            words[3] = ("idiot", "scum")[k % 8 // 4]
        if rng.random() < (0.7 if bad else 0.1):  # the group is mentioned mostly in bad sentences
            words[7] = "muslims"
        texts.append(" ".join(words)), labels.append(int(bad))
    return texts, labels


def test_counterfactual_pull():
    texts, labels = sentences()
    plain, pulled = (toxicity.Scorer(toxicity.fit(texts, labels, pull=p)) for p in (0.0, 5.0))
    neutral = "w1 w2 muslims w3 w4"
    swapped = " ".join(toxicity.counterfactual(neutral.split()))
    gap = lambda m: abs(m.score(neutral) - m.score(swapped))
    assert gap(pulled) < gap(plain) / 2 and pulled.score("w1 idiot w2") > 0.5 > pulled.score(neutral)
    assert toxicity.counterfactual(["w1"]) is None and all(0 <= pulled.score(t) <= 1 for t in ("", None, "idiot " * 1000))


def test_model_minimises_the_stated_loss():
    texts, labels = sentences(120)
    pull, decay = 1.0, 1.0
    model = toxicity.fit(texts, labels, pull=pull, decay=decay, rounds=4000, least_z=0.0)
    names = sorted(model.weights)

    def score(words, w, b):
        count = {}
        for word in words:
            for f in toxicity.features(word):
                count[f] = count.get(f, 0) + 1
        return 1 / (1 + math.exp(-b - sum(w[f] * (1 + math.log(n)) for f, n in count.items() if f in w)))

    def loss(w, b):
        total = decay / 2 * sum(x * x for x in w.values())
        for text, y in zip(texts, labels):
            words = re.findall("[a-z]+", text)
            s = score(words, w, b)
            total -= math.log(s if y else 1 - s)
            if other := toxicity.counterfactual(words):
                total += pull * (s - score(other, w, b)) ** 2
        return total

    for f in [n for n in names if "mus" in n or "idi" in n or "chr" in n][:8] + names[:4]:
        up, down = ({**model.weights, f: model.weights[f] + e} for e in (1e-4, -1e-4))
        assert abs(loss(up, model.intercept) - loss(down, model.intercept)) / 2e-4 < 0.02, f
    assert abs(loss(model.weights, model.intercept + 1e-4) - loss(model.weights, model.intercept - 1e-4)) / 2e-4 < 0.02


def test_training_in_executors_is_the_same_fit(spark, monkeypatch):
    texts, labels = sentences(300)
    texts[5] = None
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    told = spark.createDataFrame([(k, y) for k, y in enumerate(labels)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FLUSH", 20)
    used = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5]
    want = toxicity.fit([texts[k] for k in used], [labels[k] for k in used])
    got = toxicity.train(df, told)
    assert got.weights.keys() == want.weights.keys() and abs(got.intercept - want.intercept) < 1e-9
    assert all(abs(got.weights[f] - v) < 1e-9 for f, v in want.weights.items())


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, toxicity.train(docs, labels, sample=2500)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    rank, bad = held.score.rank(), held.toxic == 1
    auc = (rank[bad].mean() - (bad.sum() + 1) / 2) / (~bad).sum()
    assert auc > 0.95 and held[~bad].predicted.mean() < 0.02 and held[bad].predicted.mean() > 0.9


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.train(empty, labels)
    assert math.isclose(toxicity.Scorer(none).score("anything"), 0.5) and toxicity.scored(empty, none).count() == 0
