"""Quality rules, personal data, weak labels, BPE and packing against plain versions."""

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webframe.llm import bpe, packing, pii, quality_rules, trees, weak_quality

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, docs_rows):
    got = {r.row.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert len(got) == len(docs_rows)
    for i, t, *_ in docs_rows:
        want = plain_counts(t)
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].kept and got[i].base_failed)


def test_quality_fences_come_from_the_group(spark):
    """A source whose texts are full of symbols keeps them, a clean source does not."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        many = i % 2 or i == 0
        words = ["".join(rng.choice("abcdefg") for _ in range(6)) + ("##" if many else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "loud" if i % 2 else "calm"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.row.doc_id: r.kept for r in quality_rules.judged(df).collect()}
    assert not kept[0] and all(kept[i] for i in range(1, 600))


def test_quality_of_odd_rows(odd, none):
    got = quality_rules.judged(odd).collect()
    assert len(got) == 10 and not any(r.kept for r in got)
    assert quality_rules.judged(none).count() == 0


def test_bucket_floor(spark):
    df = spark.range(3000).select("id", quality_rules.bucket_floor(F.col("id")).alias("b"))
    for r in df.collect():
        s = max(r.id.bit_length() - 6, 0)
        assert r.b == r.id >> s << s


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_on_random_texts():
    rng, find = random.Random(5), pii.Finder()
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", ".", "-", "1", "23", "255", "256", "+", " ", "(", ")", "4111111111111111", "é", "%", "x.y", "a@b.c"]) for _ in range(rng.randint(0, 40)))
        assert sorted(find(t)[0], key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_base(t), t


def test_scans_are_linear():
    find = pii.Finder()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 (" * 80_000, "1 " * 150_000, "(at)" * 80_000, "AB12 " * 60_000):
        find(t)


CARDS = ("4111 1111 1111 1111", "4111111111111111", "5500-0055-5555-5559", "3782 822463 10005")
PHONE_NUMBERS = ("+1 (826) 555-4081", "+49 30 12345678")


@pytest.mark.parametrize(
    "text, want",
    [
        *((f"x {a} {b} y", f"x [PHONE] {c} y") for a in PHONE_NUMBERS for b, c in [("190.137.223.204", "[IP]"), *((c, "[CARD]") for c in CARDS)]),
        *((f"x {a} {b}, {c} y", f"x [CARD] {d}, [CARD] y") for a, c in zip(CARDS, CARDS[1:]) for b, d in [("27.65.93.188", "[IP]"), ("2024 11", "2024 11")]),
        ("x 4111111111111111 4111111111111111 4111111111111111 y", "x [CARD] [CARD] [CARD] y"),
        ("x +1 (836) 555-9331 4913187196670932 53.121.55.90 y", "x [PHONE] [CARD] [IP] y"),
        ("x +49 30 1234567 030 7654321 y", "x [PHONE] 7654321 y"),
        ("x DE89 3704 0044 0532 0130 00, y", "x [ID], y"),
        ("x DE88 3704 0044 0532 0130 00, y", "x DE88 3704 0044 0532 0130 00, y"),
        ("x 9807915762804490, 4111111111111112 27.65.93.188 y", "x 9807915762804490, 4111111111111112 [IP] y"),
    ],
)
def test_numbers_that_run_together_are_found_one_by_one(spark, text, want):
    """A match that takes in two of them fails its check, and both stayed in the text."""
    model = trees.boost(np.zeros((0, pii.WIDTH)), np.zeros(0), np.zeros(0))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.personal_data(df, model, 1.1)  # of loose forms none
    assert pii.redacted(found).first().text == want
    assert [(s.kind, s.start, s.end) for s in found.first().spans if s.base] == plain_base(text)


def test_no_base_match_is_left_in_redacted_texts():
    rng, find, model = random.Random(9), pii.Finder(), trees.boost(np.zeros((0, pii.WIDTH)), np.zeros(0), np.zeros(0))
    parts = ["+1 (826) 555-4081", "4111111111111111", "4524132264652876", "10.0.0.1", "a@b.c", " ", " ", " ", "-", ".", "2024", "7", "+49 30 1234567", "x", "5500 0055 5555 5559"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        out = list(t)
        for s in pii.spans_of(find, t, model, 1.1):
            out[s["start"] : s["end"]] = "\0" * (s["end"] - s["start"])
        assert not plain_base("".join(out)), t


def test_looking_again_is_linear():
    find = pii.Finder()
    for t in ("1 " * 150_000, "4111 1111 1111 1111 " * 15_000, "+1 234 567 890 123 456 7890 " * 10_000, "1111 2222 3333 4445 " * 15_000, "+1 (" * 80_000 + "1" * 30, "+1" + " " * 300_000 + "1" * 30):
        find.run_together(t, find(t)[0])
    for t in ("token=" * 50_000, "=" * 300_000, "token='" * 40_000, "password=" + "a" * 300_000):
        find.secrets(t)


def test_personal_data_and_redaction(docs, docs_rows, odd, none):
    model, threshold = pii.fit(pii.candidates(docs))
    found = pii.personal_data(docs, model, threshold)
    texts = {i: t for i, t, *_ in docs_rows}
    for r in found.collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == plain_base(texts[r.row.doc_id] or "")
    clean = {r.doc_id: r.text for r in pii.redacted(found).collect()}
    for i, t in texts.items():
        if t is None:
            assert clean[i] is None
        elif not plain_base(t):
            assert clean[i] == t
        else:
            assert not EMAIL.search(clean[i]) and "[EMAIL]" in clean[i] and "[CARD]" in clean[i] and clean[i].endswith(t[-5:])
    assert pii.redacted(pii.personal_data(odd, model, threshold)).columns == odd.columns
    assert pii.personal_data(odd, model, threshold).count() == 10
    empty = pii.fit(pii.candidates(none))
    assert pii.personal_data(none, *empty).count() == 0


def test_look_alikes_and_loose_forms():
    find = pii.Finder()
    base, failed, loose = find("call 555-123-4567, jane (at) host (dot) org, SSN 123-45-6789, 4111 1111 1111 1112, 300.1.1.1")
    assert not base and {f[0] for f in failed} == {"card", "ip"} and {s[0] for s in loose} >= {"phone", "email", "id"}


def test_boosted_trees_learn_and_answer_without_rows():
    from webframe.llm.trees import boost, calibrate

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = calibrate(boost(x[:1500], y[:1500], np.ones(1500)), x[1500:], y[1500:])
    fresh = rng.normal(size=(1000, 5))
    right = (model.probability(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.5))
    assert right.mean() > 0.95
    assert boost(np.zeros((0, 5)), np.zeros(0), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_weak_labels_find_the_labels_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = weak_quality.classified(spark.read.parquet(f"{sf}/documents.parquet"))
    marked = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in marked]) > 0.97
    assert np.mean([r.kept for r in marked if r.quality == 1]) > 0.99


def test_weak_labels_of_odd_rows(odd, none):
    got = weak_quality.classified(odd).collect()
    assert len(got) == 10 and {len(r.votes) for r in got} == {len(weak_quality.LABELLERS)}
    assert weak_quality.classified(none).count() == 0


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as f:
        return bpe.Bpe(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts(own, library):
    rng = random.Random(2)
    parts = ["the", "ing", "a", "aa", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "'s", "'ll", "12", "3", "!!", "<|endoftext|>", "\x1c", " ", "́", "zq", "ThE", "ation"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, "zq" * 999, " " * 500, "é" * 700, "".join(rng.choice("abcdefgh") for _ in range(6000))]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t[:80]
        assert bpe.decoded(ids, bpe.token_table(own.ranks)) == t.encode()


def test_bpe_tree_joins_any_halves(own):
    rng = random.Random(3)
    for _ in range(500):
        raw = "".join(rng.choice(["a", "e", "in", "th", "é", "zz"]) for _ in range(rng.randint(2, 60))).encode()
        cut = rng.randint(0, len(raw))
        assert own.join(own.plain(raw[:cut]), own.plain(raw[cut:])) == own.plain(raw)


def test_matches_of_long_texts_are_split_alike(own, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice(["a", "bc", " ", "   ", "\n", "'l", "'", "ll", "1", "!", "é"]) for _ in range(rng.randint(0, 200)))
        assert own.matches(t) == own.split.findall(t)


def test_encode_and_decode_tables(docs, docs_rows, library, odd, none):
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, check=True)
    got = {r.doc_id: r for r in bpe.decode(both.select("doc_id", "ids"), RANKS).collect()}
    assert {r.doc_id: r.decoded for r in both.collect()} == {i: r.decoded for i, r in got.items()}
    for i, t, *_ in docs_rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or "") and got[i].decoded == (t or "").encode()
    assert bpe.encode(odd, RANKS, public_tokenizers.PATTERN).count() == 10
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(rows, ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(docs, docs_rows):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in docs_rows}
    rows = packing.packed(packing.pieces(docs, WORDS, capacity=512), 512, group_pieces=64).collect()
    n = check_packing(rows, ids, 512)
    assert n * 512 < 1.2 * sum(map(len, ids.values()))


def test_word_encoder_equals_the_library(spark):
    rng, tokenizer = random.Random(6), Tokenizer.from_file(WORDS)
    parts = ["The", "İst", "ß", "é", "é", "don't", "12a", "!!", " ", "  ", "\n", "\t", "\r", "\x1c", " ", "　", "日", "ǅ", "Σς", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "a" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "\n<|startoftext|>\n"]
    with open(WORDS, "rb") as f:
        own = packing.WordEncoder(f.read())
    for t, got in zip(texts, own(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_encoder_equals_the_library_before_stops():
    rng, tokenizer = random.Random(8), Tokenizer.from_file(WORDS)
    parts = ["TAR\u0130H\u0130", "\u0130", "\u092a\u095d", "\u095d", "\ufb2a", "a", "\u00e9", "e\u0301", "\u03a3\u0391\u03a3", ".", ",", ".", ",", " "]
    texts = ["TAR\u0130H\u0130.", "\u0130,", "\u092a\u095d.", "\ufb2a,", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500))]
    with open(WORDS, "rb") as f:
        own = packing.WordEncoder(f.read())
    for t, got in zip(texts, own(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_of_odd_rows(odd, none):
    rows = packing.packed(packing.pieces(odd, WORDS)).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 1: 2, 2: 1, 3: 2, 4: 1, -5: 1, 9: 1}
    assert packing.packed(packing.pieces(none, WORDS)).count() == 0


def test_first_fit_decreasing_fits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            b = next((k for k, room in enumerate(free) if room >= lengths[i]), len(free))
            free += [100] * (b == len(free))
            want.append((i, b, 100 - free[b]))
            free[b] -= lengths[i]
        assert sorted(want) == [(i, bins[i], offsets[i]) for i in range(n)]
