"""Personal data, quality, language, counts, pieces, packing and the Arrow store against plain code."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushgrain.llm import arrow_store, langid, packing, pieces, pii, quality, queries, token_counts
from hushgrain.llm.chunks import ChunkEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
ODD = ["", None, " ", "\n", "  a  b\n\nc \n d", "a\tb c\u2003d", "x" * 3000, "é 漢字 😀 \x01", "<|endoftext|> a", "don't 's\r\n", "a \n\n\n b", "\n\n", "b\n", "one, two; three." * 400]


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source"), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Personal data

KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
PII = [
    "a@b.c x.y+z@d-e.co.uk, @q.r a@@b.c a@b c@d..e foo@bar.baz@qux.com",
    "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 01.002.3.255 9.9.9.9.256 .1.2.3.4.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111-0 12 34 5500005555555559",
    "+1 (017) 555-7713 +49 30 123456 +1 +123456789012345678 ++44 20 7946 0958 +4(",
    "card 4111111111111111 from 10.0.0.1 by a@b.com +1 212 555 0000" * 3,
    "1" * 400 + "." + "2" * 400 + "@" + "a" * 50,
]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in KINDS.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_are_exact():
    rng = random.Random(1)
    texts = PII + ["".join(rng.choice("0123456789.@+- ()aB_%") for _ in range(rng.randrange(60))) for _ in range(4000)] + ODD
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == plain_spans(t), t


def test_further_kinds():
    assert [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33")] == ["iban"]
    assert [s[0] for s in pii.find_spans('token = "04dbebab91ab85687d33eeaaf9ac699e"')] == ["secret"]
    assert pii.find_spans('colour: "04dbebab91ab85687d33eeaaf9ac699e"') == []
    assert [s[0] for s in pii.find_spans("call (212) 555-0199 now; SSN 123-45-6789; 123-45-6780")] == ["local_phone", "national_id", "national_id"]
    assert pii.find_spans("room (212) 555-0199") == []
    assert pii.redact_text("mail a@b.com.") == "mail [EMAIL]."


def test_context_is_whole_words_on_both_sides():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("our hotel 555-123-4567 room") == [] and kinds("shipped discards 555-123-4567") == []
    assert kinds("555-123-4567 (phone)") == ["local_phone"] == kinds("Tel.: 555-123-4567") == kinds("TEL 555-123-4567")
    far = "555-123-4567 " + "x" * 37
    assert kinds(far + " tel") == [] and kinds("tel " + "x" * 37 + " 555-123-4567") == [] and kinds(far + "otel") == []
    assert kinds("a" * 100 + "tel " + "555-123-4567") == []
    assert kinds('my_api_key: "04dbebab91ab85687d33eeaaf9ac699e"') == ["secret"]
    assert pii.find_spans("ip 10.0.0.1")[0][3] > pii.find_spans("ship 10.0.0.1")[0][3]


def test_account_numbers_end_where_their_country_says():
    found = lambda t: [t[a:b] for k, a, b, _ in pii.find_spans(t) if k == "iban"]
    at, gb = "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"
    for own in (at, gb, at.replace(" ", ""), gb.replace(" ", "")):
        assert found(own) == found(f"x {own} CODE") == found(f"{own}.") == found(f"({own}) 1234") == [own]
        assert found(own + "A") == found("A" + own) == found(own[:-1]) == []
    assert found(f"{at} {gb}, {at}") == [at, gb, at]
    assert found("ZZ82 WEST 1234 5698 7654 32") == [] and found("AT6 1190 4300 2345 7320 1") == []


def plain_added(text):
    """The further kinds and their context, by trying every place."""
    def near(kind, a, b):
        plain = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
        for w in pii.CONTEXT[kind][0]:
            for i in [*range(max(0, a - 40), a), *range(b, b + 40)]:
                end = i + len(w)
                if text[i:end].lower() == w and not plain(i - 1) and not plain(end) and (end <= a or b <= i and end <= b + 40):
                    return True
        return False

    def ibans():
        at = 0
        while at < len(text):
            for size in range(15, 45):
                own = text[at : at + size]
                plain = own.replace(" ", "")
                spaced = " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))
                if len(own) == size and own in (plain, spaced) and re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", plain) and pii.IBAN_LENGTHS.get(own[:2]) == len(plain) and pii.mod97(plain):
                    if not (at and re.match("[A-Za-z0-9]", text[at - 1])) and not text[at + size : at + size + 1].isalnum():
                        yield at, at + size
                        at += size - 1
                        break
            at += 1

    proposed = {
        "iban": ibans(),
        "local_phone": (m.span() for m in pii._LOCAL_PHONE.finditer(text)),
        "national_id": (m.span() for m in pii._NATIONAL_ID.finditer(text)),
        "secret": (m.span(1) for m in pii._SECRET.finditer(text) if re.search("[0-9]", m.group(1)) and re.search("[A-Za-z]", m.group(1))),
    }
    taken, out = [(a, b) for _, a, b in plain_spans(text)], []
    for k, spans in proposed.items():
        for a, b in spans:
            score = pii.PRIOR[k] + pii.CONTEXT[k][1] * near(k, a, b)
            if score >= 0.6 and not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                out.append((k, a, b))
    return out


def test_added_spans_are_exact():
    rng = random.Random(11)
    parts = ["AT61 1904 3002 3457 3201", "GB82WEST12345698765432", "CODE", "(212) 555-0199", "555.123.4567", "123-45-6789", "ssn", "Tel", "hotel", "phone:", "call", "token = \"a1b2c3d4e5f6a7b8c9\"", "api_key=A1b2C3d4E5f6G7h8", "x=abcdefabcdefabcdef12", "a@b.co", "10.0.0.1", "social security", "national  id", "1234", "é", ".", ",", "\n", "fax.", "bank"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) + rng.choice((" ", " ", " ", "", "_", "-")) for _ in range(rng.randrange(12)))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.ADDED_KINDS] == plain_added(t), t


def test_personal_data_edges(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, "y")], "doc_id long, text string, kind string")
    got = docs.select("doc_id", "kind", pii.spans(F.col("text")).alias("s"), pii.redacted(F.col("text")).alias("r")).collect()
    assert sorted((r.doc_id or 0, r.kind, len(r.s), r.r) for r in got if r.r) == [(1, "x", 1, "[EMAIL]")] * 2
    assert [(len(r.s), r.r) for r in got if not r.r] == [(0, None)]
    assert docs.limit(0).select(pii.spans(F.col("text")).alias("s"), pii.redacted(F.col("text"))).count() == 0
    assert len(pii.find_spans("a@b.co 555-123-4567 tel " * 20_000)) == 40_000


def test_personal_data_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op6_personal_data(spark, DATA).collect():
        want = plain_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in KINDS]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


# Quality


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_are_exact(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(500)), *(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())]
    for t in texts:
        assert quality.text_stats(t)[:5] == plain_stats(t), t


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op7_robust_quality(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        n, *_, repeated = want = plain_stats(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(600)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else None, "s", None) for i, t in enumerate(clean + junk)]
    kept = {r.doc_id for r in quality.assess(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(600))


def test_small_sources_are_judged_by_their_whole_language(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(20, 300)))
    junk = lambda: " ".join(word() + "###" for _ in range(80))
    groups = [("en", "large", clean, 400), ("en", "few", junk, 2), ("en", "spam", junk, 60), ("en", "spam", clean, 20), ("de", "s", junk, 3), ("de", "t", clean, 5)]
    rows = [(i, make(), lang, source, make is clean) for i, (lang, source, make) in enumerate((x, y, m) for x, y, m, n in groups for _ in range(n))]
    docs = spark.createDataFrame([(*r[:4], None) for r in rows], DOCS)
    want = {r[0] for r in rows if r[4]}
    assert {r.doc_id for r in quality.assess(docs).where("kept").collect()} == want
    assert {r.doc_id for r in quality.keep(docs).collect()} == want


def plain_mcd(x, coverage):
    """The subset of least determinant, of all of its size: its mean and covariance."""
    h = math.ceil(coverage * len(x) - 1e-9)
    best = None
    for rows in combinations(range(len(x)), h):
        part = x[list(rows)]
        cov = np.cov(part.T, bias=True)
        det = np.linalg.slogdet(quality.regularised(cov, coverage))[1]
        if best is None or det < best[0]:
            best = det, h, part.mean(axis=0), cov
    return best[1:]


def test_estimates_are_those_of_all_subsets(spark):
    rng = np.random.default_rng(12)
    groups = {("=en", "=a"): (13, 3), ("=en", "=b"): (12, 3), ("=de", "=a"): (11, 2)}
    rows, values = [], {}
    for (lang, source), (n, bad) in groups.items():
        x = rng.normal(size=(n, 6)) * [2.0, 0.8, 0.3, 1.5, 1.2, 0.5] + rng.normal(size=6)
        x[:bad] += 12.0 * np.array([2.0, 0.8, 0.3, 1.5, 1.2, 0.5])
        values[lang, source] = x
        rows += [(*map(float, r), lang, source) for r in x]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in quality.FEATURES) + ", g_lang string, g_source string")
    alone = {(r.g_lang, r.g_source): r for r in quality.fit(frame, 0.75, steps=8, prior_rows=0.0, grid=20_000).collect()}
    assert set(alone) == set(groups)
    for key, x in values.items():
        h, mean, cov = plain_mcd(x, 0.75)
        want = quality._whitening(quality.regularised(cov, 0.75))
        assert alone[key].n == h and alone[key].center == pytest.approx(mean.tolist(), abs=1e-6)
        assert alone[key].whitening == pytest.approx(want, rel=1e-5, abs=1e-6)
    # Shrunk: the language's and the table's core count as prior_rows documents each. The table's is too
    # large for all subsets; it is taken from a fit of one group that holds all rows.
    shrunk = {(r.g_lang, r.g_source): r for r in quality.fit(frame, 0.75, steps=8, prior_rows=5.0, grid=20_000).collect()}
    one = quality.fit(frame.withColumn("g_lang", F.lit("=x")).withColumn("g_source", F.lit("=y")), 0.75, steps=8, prior_rows=0.0, grid=20_000).first()
    x = values["=de", "=a"]
    h, mean, _ = plain_mcd(x, 0.75)
    w = h / (h + 5.0)
    center = np.array(one.center)
    for _ in range(2):  # German has one source, so its language's estimate is its own
        center = w * mean + (1 - w) * center
    assert shrunk["=de", "=a"].center == pytest.approx(center.tolist(), abs=1e-6)


def test_distances_are_those_of_the_estimates(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counted = quality.grouped(docs.select("doc_id", "lang", "source", quality.stats(F.col("text")).alias("s")), F.col("s"))
    model = {(r.g_lang, r.g_source): r for r in quality.fit(counted).collect()}
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for r in counted.collect():
        m = model[r.g_lang, r.g_source]
        low = np.zeros((6, 6))
        low[np.tril_indices(6)] = m.whitening
        d = float(((low @ (np.array([r[f] for f in quality.FEATURES]) - m.center)) ** 2).sum())
        assert got[r.doc_id].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and d <= 22.457744484825323)


def test_chi_squared():
    assert [quality.chi2_quantile(q, 6) for q in (0.5, 0.975, 0.999)] == pytest.approx([5.348120627447, 14.449375335448, 22.457744484825])
    assert [quality.chi2_quantile(q, 5) for q in (0.5, 0.95)] == pytest.approx([4.351460191095, 11.070497693516])
    x = np.random.default_rng(1).normal(size=(200_000, 6))
    d = (x * x).sum(axis=1)
    core = x[d <= np.quantile(d, 0.75)]
    assert quality.consistency(0.75) * core.var() == pytest.approx(1.0, rel=0.02)


def test_every_language_and_source_has_an_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = quality.grouped(docs.select("lang", "source", quality.stats(F.col("text")).alias("s")), F.col("s"))
    n = docs.select("lang", "source").distinct().count()
    assert quality.fit(counted).count() == n == 80


def test_quality_edges(spark):
    assert quality.assess(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, None, "x"), (1, "a b c d e f g h i j k", None, "s", "y"), (1, "a b c d e f g h i j k", None, "s", "y")]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, g string")
    assert sorted((r.n_words, r.kept) for r in quality.assess(own).collect()) == [(0, False), (11, True), (11, True)]
    assert quality.keep(own).columns == own.columns and quality.keep(own).count() == 2


# Language


def test_ppm_is_a_distribution_and_matches_plain_escapes():
    text = "abracadabra, abra"
    g = langid.grams(text)
    grams, n = np.unique(g.astype(np.int64), return_counts=True)
    model = langid.build(np.array(["x"] * len(grams)), grams, n)
    counts = defaultdict(Counter)
    padded = b"\n\n\n" + text.encode()
    for i in range(3, len(padded)):
        for k in range(4):
            counts[padded[i - k : i]][padded[i]] += 1

    def p(context, byte):
        if context is None:
            return 1 / 256
        seen = counts[context]
        shorter = context[1:] if context else None
        if not seen:
            return p(shorter, byte)
        total, kinds = sum(seen.values()), len(seen)
        left = 1 - sum(p(shorter, b) for b in seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        return kinds / (total + kinds) * p(shorter, byte) / left

    for probe in ("abra", "cab", "zq a", "bra, é"):
        raw = b"\n\n\n" + probe.encode()
        want = -sum(np.log2(p(raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))
        assert model.bits(probe)[0] == pytest.approx(want, rel=1e-4)


def test_ppm_of_several_languages_is_that_of_each_alone():
    texts = {"x": "abracadabra, abra", "y": "bananas and cabanas are aba", "z": "zzz, aäb"}
    counted = [(k, *map(int, x)) for k, t in texts.items() for x in zip(*np.unique(langid.grams(t).astype(np.int64), return_counts=True))]
    label, gram, n = map(np.array, zip(*counted))
    both = langid.build(label, gram, n)
    parts = np.unique(np.stack([(gram >> k) & 255 for k in (24, 16, 8, 0)]))
    rng = random.Random(3)
    for t in ["abra", "banana, z", "aäb q", *("".join(rng.choice("abrncdz ,äq") for _ in range(30)) for _ in range(50))]:
        for k, lang in enumerate(both.langs):
            counts = defaultdict(Counter)
            padded = b"\n\n\n" + texts[lang].encode()
            for i in range(3, len(padded)):
                for j in range(4):
                    counts[padded[i - j : i]][padded[i]] += 1

            def p(context, byte):
                if context is None:
                    return 1 / 256
                seen, shorter = counts[context], context[1:] if context else None  # noqa: B023
                if not seen:
                    return p(shorter, byte)  # noqa: B023
                total, kinds = sum(seen.values()), len(seen)
                if byte in seen:
                    return seen[byte] / (total + kinds)
                return kinds / (total + kinds) * p(shorter, byte) / (1 - sum(p(shorter, b) for b in seen))  # noqa: B023

            raw = b"\n\n\n" + t.encode()
            assert both.bits(t)[k] == pytest.approx(-sum(np.log2(p(raw[i - 3 : i], raw[i])) for i in range(3, len(raw))), rel=1e-4)
    assert len(parts) + 1 == both.n_symbols


def test_language_models_are_bounded(monkeypatch, spark):
    docs = frame(spark, ["the cat and the dog"] * 5, lang="en")
    monkeypatch.setattr(langid, "MAX_GRAMS", 3)
    with pytest.raises(ValueError, match="n-grams"):
        langid.train(docs)
    monkeypatch.setattr(langid, "MAX_GRAMS", 1000)
    monkeypatch.setattr(langid, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        langid.train(docs)


def test_language_held_out(spark):
    got = queries.op10_ppm_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_language_edges(spark):
    docs = frame(spark, ["the cat and the dog"] * 5 + [None, "", "12 .. 34", "é"], lang="en")
    model = langid.train(docs)
    got = [tuple(r[0]) for r in docs.orderBy("doc_id").select(langid.predictions(docs, model)).collect()]
    assert [x for x, *_ in got] == ["en"] * 5 + ["und"] * 3 + ["en"]
    assert docs.limit(0).select(langid.predictions(docs.limit(0), model)).count() == 0
    assert langid.train(frame(spark, ["a b"] * 3, lang="en").withColumn("doc_id", F.lit(None).cast("long"))).langs == ["en"]
    nothing = langid.train(docs.limit(0))
    assert {r[0].lang_pred for r in docs.select(langid.predictions(docs, nothing)).collect()} == {"und"}


# Tokens


def greedy(word, vocab):
    n = 0
    while word:
        cut = next((i for i in range(len(word), 0, -1) if word[:i] in vocab), 0)
        if not cut:
            return 1
        word, n = word[cut:], n + 1
    return n


def test_token_counts_are_greedy(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = set(token_counts.byte_level_pieces(path))
    auto = token_counts.Automaton(vocab)
    rng = random.Random(4)
    small = token_counts.Automaton([b"a", b"ab", b"abcd", b"b", b"cb"])
    for _ in range(2000):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 12)))
        assert small.count(w) == greedy(w, {b"a", b"ab", b"abcd", b"b", b"cb"}), w
    docs = frame(spark, ODD)
    got = {r.doc_id: r for r in docs.select("doc_id", token_counts.counts(F.col("text"), path).alias("c")).select("doc_id", "c.*").collect()}
    for i, t in enumerate(ODD):
        words = (t or "").encode().split()
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(greedy(b" " + w, vocab) for w in words)
    assert auto.count(b" the") == 1


def test_token_count_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (None, None, 6)], "doc_id long, text string, n_words int")
    got = docs.select("doc_id", docs.n_words.alias("other"), token_counts.counts(F.col("text"), path).alias("c")).collect()
    assert sorted((r.doc_id or 0, r.other, r.c.n_words, r.c.n_tokens) for r in got) == [(0, 6, 0, 0), (1, 5, 2, 2), (1, 5, 2, 2)]
    assert docs.limit(0).select(token_counts.counts(F.col("text"), path)).count() == 0


@pytest.mark.parametrize("spec", [queries.WORD_BPE, queries.BYTE_BPE])
def test_chunks_encode_as_whole_texts(spec):
    path = public_tokenizers.path(spec["name"])
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own = ChunkEncoder(path, spec["drops_space"], cached=50)
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice(["a", " ", "\n", "\t", "'s", "é", "1", "!", "The", "\u00a0"]) for _ in range(rng.randrange(12))) for _ in range(3000))]
    for t, raw in zip(texts, own.encode(pa.array(texts))):
        assert np.frombuffer(raw, own.dtype).tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def expected_ids(spec, text):
    t = Tokenizer.from_file(public_tokenizers.path(spec["name"]))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, spec["end_id"]], "<u4")


def test_packing_is_whole_and_tight(spark):
    texts = [*ODD, *("word " * n for n in (1, 7, 100, 5000, 9000)), *(f"{i} text " * (i % 50) for i in range(200))]
    got = packing.pack(frame(spark, texts).repartition(3), **queries.tokenizer(queries.WORD_BPE)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    t = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE["name"]))
    for i, text in enumerate(texts):
        if text and "<|" in text:
            continue
        own = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(r.ids for r in own) == ids.tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        used = rows[-1].offset + rows[-1].length
        assert used == 4096 or used & (used - 1) == 0 and used < 4096


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    p.levels[[3, 6]] = [4, 1]
    gains = {}
    for s in range(1, 10):
        before = int((p.levels[:10] ** 2).sum())
        for h in [0, 3, 6]:
            if h + s <= 10:
                n = p.levels.copy()
                n[h] -= h > 0
                n[h + s] += h + s < 10
                gains[s, h] = int((n[:10] ** 2).sum()) - before
        best = min(g for (x, _), g in gains.items() if x == s)
        assert gains[s, p.level_for(s)] == best


def test_packing_closes_windows_beyond_its_bound():
    for bound in (1, 2, 5):
        p, rng, docs, out = packing.SumOfSquares(16, max_open=bound), random.Random(bound), {}, []
        for d in range(300):
            ids = np.arange(1 + rng.choice((1, 2, 9, 10, 11, 12, 40)))
            docs[d] = ids
            before = p.n_open
            new = p.add(d, ids)
            assert p.n_open <= bound  # one window goes, not all of them
            assert p.n_open >= min(before, bound) - 2
            out += new
        whole = len({x[3] for x in out})
        out += p.finish()
        filled = Counter()
        for _, _, n, sequence, offset, _ in out:
            assert offset == filled[sequence]
            filled[sequence] += n
        assert all(filled[x] == 16 for x in range(whole)) and all(x == 16 or x & (x - 1) == 0 for x in filled.values())
        pieces_of = defaultdict(list)
        for d, start, n, *_, ids in out:
            assert len(ids) == n
            pieces_of[d].append((start, ids.tolist()))
        assert {d: sum((x for _, x in sorted(ps)), []) for d, ps in pieces_of.items()} == {d: x.tolist() for d, x in docs.items()}


def test_packing_edges(spark):
    tokenizer = queries.tokenizer(queries.WORD_BPE)
    assert packing.pack(frame(spark, []), **tokenizer).count() == 0
    rows = [(None, "a b", 1), (4, "a b", 2), (4, "a b", 2), (7, None, 3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids int"), **tokenizer).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 2 * sum(r.length for r in got if r.doc_id is None)
    assert {r.doc_tokens for r in got if r.doc_id == 7} == {1}


def test_arrow_store_round_trip(spark, tmp_path):
    texts = [*ODD, *("word " * n for n in (1, 300, 40_000))]
    docs = frame(spark, texts).unionByName(frame(spark, ["again"])).unionByName(spark.createDataFrame([(None, "none", None, None, None)], DOCS))
    parts = arrow_store.write(docs.repartition(4), f"file://{tmp_path}", length=64, **queries.tokenizer(queries.BYTE_BPE))
    got = sorted(arrow_store.read_documents(spark, parts).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted([-1, 0, *range(len(texts))])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
        if r.doc_id and "<|" not in (texts[r.doc_id] or ""):
            assert r.ids == expected_ids(queries.BYTE_BPE, texts[r.doc_id]).tobytes()
    for p in parts:
        s = arrow_store.Sequences(p.ids_file)
        whole = np.concatenate([s[i][0][s[i][1].to_numpy(zero_copy_only=False)] for i in range(len(s))])
        assert len(whole) == p.n_tokens and (whole == s.tokens(0, p.n_tokens)).all()
        assert all(len(s[i][0]) == 64 for i in range(len(s)))
    assert arrow_store.write(docs.limit(0), f"file://{tmp_path}/none", **queries.tokenizer(queries.BYTE_BPE)) == []
    assert arrow_store.read_documents(spark, []).count() == 0


def test_arrow_store_with_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b", "x", 1), (1, "a", "y", 2), (1, "a", "y", 2)], "doc_id long, text string, ids string, start int")
    parts = arrow_store.write(docs, f"file://{tmp_path}", **queries.tokenizer(queries.BYTE_BPE))
    got = sorted(arrow_store.read_documents(spark, parts).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 2), (1, 2, 2), (2, 4, 2)]


def test_arrow_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op9_arrow_sequences(spark, DATA).collect()}
    at = 0
    for d in docs:
        ids = expected_ids(queries.BYTE_BPE, d.text)
        assert tuple(got[d.doc_id]) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# Pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path(queries.PIECES))


def all_segmentations(m, text, n):
    s, out = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else "", []

    def go(at, weight, ids):
        if at == len(s):
            out.append((weight >> 24, len(ids), ids))
            return
        for b in range(at + 1, min(len(s), at + m.longest) + 1):
            if (i := m.ids.get(s[at:b])) is not None:
                go(b, weight + m.weight[i], (*ids, i))
        if s[at] not in m.ids:
            go(at + 1, weight + m.unknown, ids + m.spelt(s[at]))

    go(0, 0, ())
    return sorted(out, key=lambda x: x[:2])[:n]


def applied(ids, changes):
    out = list(ids)
    for start, length, new in reversed(changes):
        out[start : start + length] = new
    return out


def test_nbest_against_all_segmentations(model):
    rng = random.Random(6)
    texts = ["", "a", " ", *("".join(rng.choice(["a", "th", "e", " ", "on", "\n", "é", "漢", "ing", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(300))]
    for t in texts:
        raw, _, found = model.nbest(t, 4)
        want = all_segmentations(model, t, 4)
        assert [(c * model.unit, k) for c, k, _ in found] == [(c, k) for c, k, _ in want], t
        ids = np.frombuffer(raw, "<u4").tolist()
        own = [tuple(applied(ids, ch)) for _, _, ch in found]
        assert len(set(own)) == len(own) and all(len(x) == k for x, (_, k, _) in zip(own, found))
        assert all(model.decode(x) == t for x in own)


def test_pieces_together_and_alone_agree(model):
    rng = random.Random(8)
    keys = ["".join(rng.choice("thersonéß,.\n1") for _ in range(rng.randint(1, 14))).lstrip("\n") or "x" for _ in range(800)]
    many = model.best_many(list(dict.fromkeys(keys)))
    assert many == {k: model.best(k) for k in many}
    for k in keys[:200]:
        found = model.search(model.chunk(k), 2)
        assert many[k][1] == found[0][0] and many[k][2] == (found[1][0] - found[0][0] if len(found) > 1 else pieces._INF)


def test_merged_ids_are_the_encoders(model):
    rng = random.Random(13)
    texts = [*ODD, "  a  b", "\n\nx", " \n a", "a  \n  b", *("".join(rng.choice(["The", " ", "  ", "\n", "quick", "é", "漢字", "ing", ".", "x1", "\t"]) for _ in range(rng.randrange(14))) for _ in range(2000))]
    for t, (_, merged, _) in zip(texts, model.nbest_many([t or "" for t in texts], 4)):
        assert np.frombuffer(merged, "<u4").tolist() == (model.model.encode(t) if t else []), repr(t)


def test_best_pieces_are_like_the_encoders(model):
    t = "The quick brown fox jumps over the lazy dog and sets off at once for the old bridge across the river."
    ids, merged, _ = model.nbest(t, 1)
    assert len(ids) <= len(merged) and len(set(np.frombuffer(ids, "<u4")) & set(np.frombuffer(merged, "<u4"))) * 4 >= 0.8 * len(merged)


def test_search_of_a_chunk_finds_all_in_order(model, monkeypatch):
    rng = random.Random(14)
    for _ in range(200):
        chunk = pieces.SPACE + "".join(rng.choice("aeth") for _ in range(rng.randint(1, 7)))
        want = []

        def go(at, weight, back):
            if not at:
                want.append((weight, back))  # noqa: B023
            for ids, x, a in model.edges_into(chunk, at) if at else ():  # noqa: B023
                go(a, weight + x, back + ids)

        go(len(chunk), 0, ())
        want = [(w, b[::-1]) for w, b in sorted(want)]
        for n in (1, 3, 10_000):
            assert model.search(chunk, n) == want[:n]
        with monkeypatch.context() as m:  # as a long chunk
            m.setattr(pieces, "_LONGEST", 0)
            assert model.search(chunk, 5) == want[:5]


def test_a_chunk_of_a_million_characters():
    code = """
import random, resource, time, public_tokenizers
from hushgrain.llm.pieces import Pieces
m = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
rng = random.Random(1)
text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
ids, merged, found = m.nbest(text, 4)
assert len(found) == 4 and m.decode(__import__("array").array("I", ids)) == text
print(time.process_time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    seconds, mb = map(float, done.stdout.split())
    assert seconds < 60 and mb < 1000


def test_pieces_edges(spark):
    path = public_tokenizers.path(queries.PIECES)
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = docs.select("doc_id", "ids", pieces.encoded(F.col("text"), path).alias("e")).collect()
    assert len({bytes(r.e.ids) for r in got if r.ids == "x"}) == 1 and [r.e.nbest for r in got if r.ids == "y"] == [None]
    assert [(bytes(r.e.ids), len(r.e.nbest), r.e.nbest[0].n_pieces) for r in got if r.ids == "z"] == [(b"", 1, 0)]
    assert docs.limit(0).select(pieces.encoded(F.col("text"), path)).count() == 0
    both = docs.where("doc_id = 1").select(pieces.encoded(F.col("text"), path, with_merged=True).alias("e"), pieces.encoded(F.col("text"), path).alias("f")).first()
    assert np.frombuffer(both.e.merged, "<u4").tolist() == pieces.Pieces(path).model.encode("a b") and both.f.merged is None and both.e.ids == both.f.ids


def test_pieces_query(spark):
    got = queries.op8_nbest_pieces(spark, DATA).collect()
    assert all(r.round_trip for r in got) and all(len(r.nbest.split(",")) == 4 for r in got)
    path = public_tokenizers.path(queries.PIECES)
    odd = frame(spark, ODD).select("doc_id", "text", pieces.encoded(F.col("text"), path).alias("e")).select("*", pieces.decoded(F.col("e.ids"), path).alias("back"))
    assert all(r.back == r.text for r in odd.collect())


def test_repeated_words_pairwise():
    for n in range(4, 9):
        for marks in combinations(range(n), 2):
            words = [b"a" if i in marks else b"b" for i in range(n)] * 2
            assert quality._repeated_words(words) == plain_stats(b" ".join(words).decode())[4]
