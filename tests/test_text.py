from __future__ import annotations

import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from sentika.functions import text as X
from sentika.functions.text import clean_reviews

SLANG = {"gak": "tidak", "error": "kesalahan", "josss": "bagus", "lemot": "lambat", "keren": "bagus",
         "mantul": "mantap betul", "wkwk": "", "que": "q  e", "é": "E", "otp": "OTP"}
EMOJI_RANGES = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F9FF), (0x2600, 0x27BF),
                (0x1F1E0, 0x1F1FF), (0x200D, 0x200D), (0xFE0F, 0xFE0F)]
EMOJI_CLASS = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in EMOJI_RANGES) + "]+"


def _skip(text, start_of, end_of):
    """Without the stretches that begin where ``start_of`` says and run to ``end_of``."""
    out, i = [], 0
    while i < len(text):
        end = end_of(text, i) if start_of(text, i) else i
        if end > i:
            i = end
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _run_end(text, i, inside):
    while i < len(text) and inside(text[i]):
        i += 1
    return i


def _tag_end(text, i):
    end = text.find(">", i)
    return end + 1 if end > i + 1 else i


def _address_end(text, i):
    head = next(h for h in ("http://", "https://", "www.") if text.startswith(h, i))
    end = _run_end(text, i + len(head), lambda c: not c.isspace())
    return end if end > i + len(head) else i


def _mention_end(text, i):
    end = _run_end(text, i + 1, _is_word)
    return end if end > i + 1 else i


def _is_word(c):
    return c == "_" or c.isalnum()


def python_clean(text, slang=SLANG):
    """The contract checked character by character, without regular expressions."""
    if not (text or "").strip():
        return ""
    t = unicodedata.normalize("NFC", text)
    t = _skip(t, lambda s, i: s[i] == "<", _tag_end)
    t = "".join(c for c in t if not any(a <= ord(c) <= b for a, b in EMOJI_RANGES))
    t = _skip(t, lambda s, i: s.startswith(("http://", "https://", "www."), i), _address_end)
    t = _skip(t, lambda s, i: s[i] in "@#", _mention_end)
    runs = ["".join(g) for _, g in itertools.groupby(t)]
    t = "".join(r if r[0] == "\n" else r[:2] for r in runs)
    marks = [(stop, "".join(g)) for stop, g in itertools.groupby(t, lambda c: c in "!?.")]
    t = "".join(r[-1] if stop else r for stop, r in marks)
    tokens = (slang.get(w, w) for w in t.lower().split())
    kept = (c if _is_word(c) or c in ".,!?;:()-'" else " " for c in " ".join(tokens))
    return " ".join("".join(kept).split())


def clean_all(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    rows = clean_reviews(df, slang=options.pop("slang", SLANG), **options).orderBy("id").collect()
    return [r.clean_text for r in rows]


GOLDEN = [
    ("gak, error josss lemot KEREN", "gak, kesalahan joss lambat bagus"),
    ("bagusssss!!! mantul wkwk", "baguss! mantap betul"),
    ("a<br>b &amp; foo@bar.com x", "ab amp; foo.com x"),
    (None, ""),
    (" \t\n ", ""),
    ("cek https://x.id/a?b=1 dan www.y.id ok", "cek dan ok"),
    ("ok\U0001f44d\U0001f3fd x☀️y \U0001f1ee\U0001f1e9", "ok xy"),
    ("Café #tag @orang a b　c", "café a b c"),
    ("a < b tapi c > d", "a d"),
    ("1000000 !?.?! <", "100 !"),
]


def test_golden_rows(spark):
    assert clean_all(spark, [a for a, _ in GOLDEN]) == [b for _, b in GOLDEN]


def test_whole_dictionary(spark):
    slang = {f"{a}{b}{a}": f"{b} {a}" if a != b else "" for a in "bcdfg" for b in "aeiou"}
    texts = [f"{k} X {k.upper()}, {v}" for k, v in slang.items()]
    assert clean_all(spark, texts, slang=slang) == [python_clean(t, slang) for t in texts]


PIECES = [*" \t\n\r\x1c\x85\u00a0\u3000aAbBeéEöß.!?,;:()-'<>@#/_&019", "http://", "www.", "gak", "que ", "<br>",
          "\u0301", "\u2600\ufe0f", "\U0001f600", "aaa", "!!!"]


def random_text(rng, alphabet):
    """Pieces that trigger the rules, mixed with arbitrary characters."""
    def piece():
        return rng.choice(PIECES if rng.random() < 0.8 else alphabet)

    return "".join(piece() for _ in range(rng.randrange(40)))


def comparable(c):
    """Assigned, and lower-cased alike by both languages."""
    return unicodedata.category(c) not in ("Cn", "Cs", "Co") and len(c.lower()) == 1 and c not in "Σ\u1e9e"


def test_chain_equals_python(spark):
    rng = random.Random(7)
    chars = [(c,) for c in map(chr, range(0x20, 0x3000)) if comparable(c)]
    # letters the JVM's Unicode version does not know yet are outside the contract
    known = spark.createDataFrame(chars, "c string").where(~F.col("c").rlike(r"\p{Cn}")).orderBy("c")
    alphabet = [r.c for r in known.collect()]
    texts = [random_text(rng, alphabet) for _ in range(4000)]
    wrong = [(t, got, python_clean(t)) for t, got in zip(texts, clean_all(spark, texts)) if got != python_clean(t)]
    assert not wrong[:5], len(wrong)


def test_single_rules_equal_python(spark):
    texts = [t for t, _ in GOLDEN if t] + ["aaabbb\n\n\n\r\r\rx", "foo.@bar #é_1", "..!..", "x\x1fy  z w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = {
        X.strip_html: lambda t: re.sub(r"<[^>]+>", "", t),
        X.strip_emoji: lambda t: re.sub(EMOJI_CLASS, "", t),
        X.strip_urls: lambda t: re.sub(r"https?://\S+|www\.\S+", "", t),
        X.strip_mentions: lambda t: re.sub(r"[@#]\w+", "", t),
        X.collapse_repeats: lambda t: re.sub(r"(.)\1{2,}", r"\1\1", t),
        X.collapse_punctuation: lambda t: re.sub(r"([!?.]){2,}", r"\1", t),
        X.replace_special: lambda t: re.sub(r"[^\w\s.,!?;:()\-']", " ", t),
        X.normalize_space: lambda t: re.sub(r"\s+", " ", t).strip(),
        X.strip_space: str.strip,
        X.normalize_unicode: lambda t: unicodedata.normalize("NFC", t),
        X.fallback_clean: lambda t: t.lower().strip(),
        X.word_count: lambda t: len(t.split()),
        X.sent_count: lambda t: len(re.findall(r"[.!?]+", t)),
        X.char_count: len,
    }
    columns = [rule(F.col("t")).alias(f"c{i}") for i, rule in enumerate(rules)]
    for row in df.select("t", *columns).collect():
        for i, twin in enumerate(rules.values()):
            assert row[f"c{i}"] == twin(row.t), (i, row.t)


def test_nfc_of_every_composable_letter(spark):
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.decomposition(chr(c))]
    texts = [unicodedata.normalize("NFD", c) + "x" for c in letters]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.normalize_unicode(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


def test_statistics_of_clean_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "review_text string")
    for r in clean_reviews(df, slang=SLANG, stats=True).collect():
        assert r.char_count == len(r.clean_text)
        assert r.word_count == len(r.clean_text.split())
        assert r.sent_count == len(re.findall(r"[.!?]+", r.clean_text))


def test_stems_and_case(spark):
    assert clean_all(spark, ["Gak Bisa Dipakai"], lowercase=False) == ["tidak Bisa Dipakai"]
    assert clean_all(spark, ["gak dipakai"], stems={"dipakai": "pakai"}) == ["tidak pakai"]


def test_filter_does_not_repeat_the_chain(spark):
    df = spark.createDataFrame([("a b c",)], "review_text string")
    cleaned = clean_reviews(df, slang=SLANG, stats=True).where("word_count >= 3")
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(.)\1{2,}") == 1


def test_dictionary_and_table_give_equal_text(spark):
    slang = {f"w{i}": ("" if i % 50 == 0 else f"v{i}  x" if i % 3 else f"V{i}") for i in range(50_000)}
    table = spark.range(50_000).selectExpr(
        "concat('w', id) as term", "case when id % 50 = 0 then null when id % 3 <> 0 then concat('v', id, '  x') else concat('V', id) end as replacement"
    )
    texts = [f"w{i} W{i * 7} hot hot, w{i}! a\tb w1" for i in range(300)] + ["", None, " ", "w0", "w0 w50"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, review_text string")
    few = {k: slang[k] for k in {w.lower().strip("!,") for t in texts for w in (t or "").split()} if k in slang}
    want = {r.review_id: r.clean_text for r in clean_reviews(df, slang=few, stems=few).collect()}
    assert {r.review_id: r.clean_text for r in clean_reviews(df, slang=table, stems=table).collect()} == want
    big = {r.review_id: r.clean_text for r in clean_reviews(df.where("review_id < '2'"), slang=slang).collect()}
    once = {r.review_id: r.clean_text for r in clean_reviews(df, slang=few).collect()}
    assert big == {k: once[k] for k in big}


def test_large_tables_are_joined_by_salted_words(spark, monkeypatch):
    monkeypatch.setattr(X, "broadcast_if_small", lambda table: table)
    table = spark.createDataFrame([("hot", "cold"), ("Up", "no"), ("gone", None)], "term string, replacement string")
    df = spark.createDataFrame([(i, "hot HOT up gone") for i in range(50)], "id int, t string")
    assert {r.o for r in X.replace_words_join(df, table, "id", "t", "o").collect()} == {"cold cold up"}


def test_class_of_composable_characters_is_complete(spark):
    odd = set(X.composable())
    rng = random.Random(11)
    points = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    for _ in range(100_000):
        t = "a" + rng.choice(points) + rng.choice(points)
        assert odd & {ord(c) for c in t} or unicodedata.normalize("NFC", t) == t
    sample = [*rng.sample(sorted(odd), 400), *[ord(c) for c in rng.sample(points, 400)]]
    df = spark.createDataFrame([(c, chr(c)) for c in sample], "c int, t string")
    assert all(r.hit == (r.c in odd) for r in df.select("c", F.col("t").rlike(X.not_composed()).alias("hit")).collect())
